"""Overlapping chunks of a session: ranges, membership, and carrying identities from one chunk to the next."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import masks
from .matching import optimal
from .reid import Gallery


def check_chunking(chunk: int, overlap: int) -> None:
    if chunk <= 0 or not 0 <= overlap < chunk:
        raise ValueError("overlap must be from 0 to below chunk")


def ranges(totals: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """session, chunk_index, start, end (exclusive) covering totals(session, n); the last is cut off."""
    check_chunking(chunk, overlap)
    stride = chunk - overlap
    # the last chunk is the first that reaches the end
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - chunk) / stride)).cast("long")
    rows = totals.filter("n > 0").withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("chunk_index") * stride
    return rows.select("session", "chunk_index", start.alias("start"), F.least(start + chunk, F.col("n")).alias("end"))


def memberships(df: DataFrame, totals: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """df with chunk_index and local_frame: a row for each chunk that holds the frame, ceil(chunk / stride) at most.

    A chunk has to bring more than the overlap, so a session no longer than that has none.
    """
    check_chunking(chunk, overlap)
    stride = chunk - overlap
    f = F.col("frame")
    first = F.greatest(F.lit(0), F.ceil((f - chunk + 1) / stride)).cast("long")
    last = F.least(F.floor(f / stride).cast("long"), F.greatest(F.lit(0), F.ceil((F.col("n") - chunk) / stride)).cast("long"))
    spread = df.join(totals.filter(F.col("n") > overlap), "session").withColumn("chunk_index", F.explode(F.when(last >= first, F.sequence(first, last)))).drop("n")
    return spread.withColumn("local_frame", f - F.col("chunk_index") * stride)


def fresh(df: DataFrame, overlap: int) -> DataFrame:
    """Rows that the previous chunk has not given out already."""
    return df.filter((F.col("chunk_index") == 0) | (F.col("local_frame") >= overlap))


def redetections(df: DataFrame, every: int) -> DataFrame:
    """df (memberships()' rows) with redetect_window, the part of `every` frames of a chunk, and redetect, whether people are looked for
    anew there: at the first frame of each part. ValueError for an `every` under 1.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    part = F.floor(F.col("local_frame") / every).cast("long")
    return df.withColumn("redetect_window", part).withColumn("redetect", F.col("local_frame") % every == 0)


def velocities(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, vx, vy: medians of the centroid's steps over the frames between; nothing for a single observation."""
    w = W.partitionBy(*keys).orderBy("frame")
    rows = df.select(*keys, "frame", x.alias("_x"), y.alias("_y")).filter("_x is not null and _y is not null")
    gap = F.col("frame") - F.lag("frame").over(w)
    steps = rows.select(*keys, ((F.col("_x") - F.lag("_x").over(w)) / gap).alias("sx"), ((F.col("_y") - F.lag("_y").over(w)) / gap).alias("sy")).filter("sx is not null")
    return steps.groupBy(*keys).agg(F.median("sx").alias("vx"), F.median("sy").alias("vy"))


def overlap_scores(chunks: DataFrame, overlap: int, stride: int, pixels: bool = False) -> DataFrame:
    """session, chunk_index, prev_id, curr_id, mean_iou, shared: how local ids of a chunk's head lie over those of the previous one's tail.

    chunks: session, chunk_index, local_frame, local_id, box, or with pixels the masks' runs rle. The mean is over the
    frames that hold both.
    """
    from gaitline.functions.geometry import box_iou

    if pixels:
        chunks = chunks.withColumn("box", F.col("rle"))
    head = chunks.filter(F.col("local_frame") < overlap).select("session", "chunk_index", F.col("local_frame").alias("at"), F.col("local_id").alias("curr_id"), F.col("box").alias("b"))
    tail = chunks.filter(F.col("local_frame") >= stride).select("session", (F.col("chunk_index") + 1).alias("chunk_index"), (F.col("local_frame") - stride).alias("at"), F.col("local_id").alias("prev_id"), F.col("box").alias("a"))
    both = tail.join(head, ["session", "chunk_index", "at"])
    if pixels:
        met = masks.with_shared(both, "a", "b")
        union = masks.area(F.col("a")) + masks.area(F.col("b")) - F.col("inter")
        iou = F.coalesce(F.try_divide(F.col("inter"), union), F.lit(0.0))
        return met.groupBy("session", "chunk_index", "prev_id", "curr_id").agg(F.avg(iou).alias("mean_iou"), F.count(F.lit(1)).alias("shared"))
    return both.groupBy("session", "chunk_index", "prev_id", "curr_id").agg(F.avg(box_iou(F.col("a"), F.col("b"))).alias("mean_iou"), F.count(F.lit(1)).alias("shared"))


def anchor_scores(prev: DataFrame, curr: DataFrame, keys: list[str], speed: DataFrame | None = None) -> DataFrame:
    """keys, prev_id, curr_id, best_iou: the largest overlap over all frame pairs of two sides, as the boxes lie or moved on by
    the earlier side's velocity. prev, curr: keys, frame, id, box; speed: keys, id, vx, vy.
    """
    from gaitline.functions.geometry import box_iou

    a = prev.select(*keys, F.col("id").alias("prev_id"), F.col("frame").alias("fa"), F.col("box").alias("a"))
    if speed is not None:
        a = a.join(speed.select(*keys, F.col("id").alias("prev_id"), "vx", "vy"), [*keys, "prev_id"], "left")
    else:
        a = a.withColumn("vx", F.lit(None).cast("double")).withColumn("vy", F.lit(None).cast("double"))
    b = curr.select(*keys, F.col("id").alias("curr_id"), F.col("frame").alias("fb"), F.col("box").alias("b"))
    both = a.join(b, keys).withColumn("k", F.col("fb") - F.col("fa"))
    moved = F.struct(*((F.col("a")[c] + F.col(v) * F.col("k")).alias(c) for c, v in (("x0", "vx"), ("y0", "vy"), ("x1", "vx"), ("y1", "vy"))))
    still, shifted = box_iou(F.col("a"), F.col("b"), border=1), F.when(F.col("vx").isNotNull(), box_iou(moved, F.col("b"), border=1))
    return both.groupBy(*keys, "prev_id", "curr_id").agg(F.max(F.greatest(still, shifted)).alias("best_iou")).filter("best_iou > 0")


def carry_ids(scores: DataFrame, locals_: DataFrame, least: float, max_ids: int | None = None, gallery: dict | None = None) -> DataFrame:
    """session, chunk_index, local_id, global_id: global ids through all chunks of a session, from 0.

    scores: overlap_scores(); locals_: session, chunk_index, local_id, first_seen (local frame), pos. A chunk's ids take those of
    the previous chunk by optimal assignment on mean overlap, kept from `least` up; the others get fresh ids in order
    of appearance, until the next id would reach max_ids. Chunks of a session follow one another, so a session is
    one group: ids, not frames, are what it holds.

    gallery: options of reid.Gallery; locals_ then has vec array<double>, an id's embedding in its chunk, or NULL. Before an id gets a
    fresh number it may take that of a lost one that it is like; ids lost for too many chunks are forgotten.
    """
    links = scores.select("session", "chunk_index", F.lit(0).alias("kind"), F.col("prev_id").alias("a"), F.col("curr_id").alias("b"), F.col("mean_iou").alias("s"), F.lit(0).cast("long").alias("o"))
    order = (F.col("first_seen") * 1_000_000 + F.col("pos")).cast("long")
    none = F.lit(None).cast("array<double>")
    links = links.withColumn("vec", none)
    seen = locals_.select("session", "chunk_index", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("a"), F.col("local_id").alias("b"), F.lit(0.0).alias("s"), order.alias("o"), (none if gallery is None else F.col("vec")).alias("vec"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, int] = {}
        lost = None if gallery is None else Gallery(**gallery)
        nxt, out = 0, []
        for c, rows in pdf.groupby("chunk_index", sort=True):
            links_, here = rows[rows["kind"] == 0], rows[rows["kind"] == 1].sort_values(["o", "b"])
            links_ = links_[links_["a"].isin(known.keys())]
            mine: dict[int, int] = {}
            if len(links_):
                # by global ids on the earlier side
                ga = links_["a"].map(known)
                x, i = np.unique(ga, return_inverse=True)
                y, j = np.unique(links_["b"], return_inverse=True)
                m = np.zeros((len(x), len(y)))
                m[i, j] = links_["s"]
                mine = {int(y[q]): int(x[p]) for p, q in optimal(1.0 - m) if m[p, q] >= least and m[p, q] > 0}
            vecs = {} if lost is None else {int(b): None if v is None else np.array(v, float) for b, v in zip(here["b"], here["vec"])}
            for b in here["b"]:
                if b in mine:
                    continue
                again = None if lost is None else lost.match(vecs[int(b)])
                if again is not None:
                    lost.revive(again)
                    mine[int(b)] = again
                elif max_ids is None or nxt < max_ids:
                    mine[int(b)] = nxt
                    nxt += 1
            if lost is not None:
                for b, gid in mine.items():
                    lost.observe(gid, vecs.get(b))
                for gid in set(known.values()) - set(mine.values()):
                    lost.lose(gid, int(c))
                lost.forget(int(c))
            out += [(key[0], c, b, g) for b, g in mine.items()]
            known = mine
        return pd.DataFrame(out, columns=["session", "chunk_index", "local_id", "global_id"])

    kind = dict(scores.dtypes)["session"]
    return links.unionByName(seen).groupBy("session").applyInPandas(run, f"session {kind}, chunk_index long, local_id long, global_id long")
