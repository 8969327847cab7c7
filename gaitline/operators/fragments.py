"""Merging fragments of identities: bounds, signatures of trusted frames, two assignment passes, groups, merged masks.

Tables: masks(run, id, frame, box, ...) with a row for each non-empty frame; signals(run, id, frame, usable, vec, hue) with the
appearance of a frame, NULL where it has none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaitline.functions import geometry as G

from .masks import united
from .matching import optimal

MIN_FRAMES, THRESHOLD, SAMPLES, RADIUS = 8, 0.6, 5, 200
#: Fixed value: cost of a pair that can't be; below it lies any real cost.
IMPOSSIBLE = 10.0


def bounds(masks: DataFrame, min_frames: int = MIN_FRAMES) -> DataFrame:
    """run, id, first, last, real_frames, short: short ids are no candidates but stay in the output."""
    found = masks.groupBy("run", "id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("real_frames"))
    return found.withColumn("short", F.col("real_frames") < min_frames)


def mean_vectors(rows: DataFrame, keys: Sequence[str], *names: str) -> DataFrame:
    """keys and, for each name, the element-wise mean of the present vectors; NULL where a key has none.

    Elements are averaged by place, so what is shuffled is one partial sum for each place and task.
    """
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names))
    flat = rows.select(*keys, F.explode(each).alias("_e")).select(*keys, F.col("_e.name").alias("_name"), F.posexplode_outer("_e.v").alias("_k", "_x"))
    means = flat.groupBy(*keys, "_name", "_k").agg(F.avg("_x").alias("_x"))
    held = lambda n: F.array_sort(F.collect_list(F.when((F.col("_name") == n) & F.col("_k").isNotNull(), F.struct("_k", "_x"))))
    lists = means.groupBy(*keys).agg(*(held(n).alias(n) for n in names))
    return lists.select(*keys, *(F.when(F.size(n) > 0, F.transform(n, lambda p: p["_x"])).alias(n) for n in names))


def unit(vec: Column) -> Column:
    norm = F.sqrt(G.dot(vec, vec))
    return F.when(norm > 1e-9, F.transform(vec, lambda x: x / norm))


def shares(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 1e-9, F.transform(hist, lambda x: x / total))


def finalize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vec, hue: mean signature, brought back to length 1 and sum 1; NULL where no frame has the signal."""
    return mean_vectors(rows, keys, "vec", "hue").select(*keys, unit(F.col("vec")).alias("vec"), shares(F.col("hue")).alias("hue"))


def edge_signatures(signals: DataFrame, limits: DataFrame, side: str, samples: int = SAMPLES) -> DataFrame:
    """run, id, vec, hue from the first `samples` usable frames, walking in from an id's start or end."""
    usable = signals.filter("usable and (vec is not null or hue is not null)").join(limits.filter("not short").select("run", "id"), ["run", "id"])
    order = F.asc("frame") if side == "start" else F.desc("frame")
    picked = usable.withColumn("_k", F.row_number().over(W.partitionBy("run", "id").orderBy(order))).filter(F.col("_k") <= samples)
    return finalize(picked, ["run", "id"])


def evenly_spaced(first: Column, last: Column, n: int) -> Column:
    """n frames from first to last, ends included, rounded half to even; all of a shorter span."""
    span = (last - first + 1).cast("long")
    if n <= 1:
        return F.array(first)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(first + i * (span - 1) / (n - 1)).cast("long")))
    return F.when(span <= n, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array_sort(spread))


def pooled_frames(signals: DataFrame, limits: DataFrame, samples: int = SAMPLES, radius: int = RADIUS) -> DataFrame:
    """run, id, frame: for each evenly spaced target the nearest usable frame not taken by an earlier target (later one of equal
    distance first). The walk over targets is sequential, so an id's usable frames near its targets are one group:
    samples * (2 * radius + 1) rows at most.
    """
    gap = F.greatest(F.lit(1), F.floor((F.col("last") - F.col("first") + 1) / samples))
    reach = F.least(F.greatest(F.lit(1), F.floor(gap / 2)), F.lit(radius)).cast("long")
    slots = limits.filter("not short").select("run", "id", reach.alias("reach"), F.posexplode(evenly_spaced(F.col("first"), F.col("last"), samples)).alias("slot", "target"))
    usable = signals.filter("usable and (vec is not null or hue is not null)").select("run", "id", "frame")
    near = slots.join(usable, ["run", "id"]).filter(F.abs(F.col("frame") - F.col("target")) <= F.col("reach"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        for _, rows in pdf.groupby("slot", sort=True):
            off = rows["frame"] - rows["target"]
            for f in rows["frame"].iloc[np.lexsort((off < 0, off.abs()))].tolist():
                if f not in taken:
                    taken.add(f)
                    break
        out = pdf[["run", "id"]].head(1)
        return pd.DataFrame({"run": out["run"].iloc[0], "id": out["id"].iloc[0], "frame": sorted(taken)})

    kinds = dict(near.dtypes)
    return near.select("run", "id", "slot", "target", "frame").groupBy("run", "id").applyInPandas(run, f"run {kinds['run']}, id {kinds['id']}, frame {kinds['frame']}")


def _assign(costs: DataFrame, rows: DataFrame, columns: DataFrame, a: str, b: str) -> DataFrame:
    """Optimal assignment of a run's whole matrix: pairs not in costs are impossible and dear, and are not returned.

    A run is one group: its ids, not its frames.
    """
    parts = costs.select("run", F.lit(2).alias("kind"), F.col(a).alias("x"), F.col(b).alias("y"), "cost")
    parts = parts.unionByName(rows.select("run", F.lit(0).alias("kind"), F.col("id").alias("x"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("double").alias("cost")))
    parts = parts.unionByName(columns.select("run", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("x"), F.col("id").alias("y"), F.lit(None).cast("double").alias("cost")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = sorted(pdf.loc[pdf["kind"] == 0, "x"].astype(int)), sorted(pdf.loc[pdf["kind"] == 1, "y"].astype(int))
        i, j = {x: k for k, x in enumerate(xs)}, {y: k for k, y in enumerate(ys)}
        m = np.full((len(xs), len(ys)), IMPOSSIBLE)
        for x, y, c in pdf.loc[pdf["kind"] == 2, ["x", "y", "cost"]].itertuples(index=False):
            m[i[int(x)], j[int(y)]] = c
        found = [(pdf["run"].iloc[0], xs[p], ys[q], 1.0 - m[p, q]) for p, q in optimal(m) if m[p, q] < IMPOSSIBLE]
        return pd.DataFrame(found, columns=["run", a, b, "similarity"])

    kind = dict(costs.dtypes)["run"]
    return parts.groupBy("run").applyInPandas(run, f"run {kind}, {a} long, {b} long, similarity double")


def fragment_pairs(limits: DataFrame, ends: DataFrame, starts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """run, from_id, into_id, similarity, accepted: which id a starting id continues. An id that starts at frame 0 continues none."""
    real = limits.filter("not short")
    late = real.filter("first > 0")
    a = real.select("run", F.col("id").alias("from_id"), F.col("last").alias("_end")).join(ends.select("run", F.col("id").alias("from_id"), F.col("vec").alias("va"), F.col("hue").alias("ha")), ["run", "from_id"], "left")
    b = late.select("run", F.col("id").alias("into_id"), F.col("first").alias("_start")).join(starts.select("run", F.col("id").alias("into_id"), F.col("vec").alias("vb"), F.col("hue").alias("hb")), ["run", "into_id"], "left")
    pairs = a.join(b, "run").filter("from_id <> into_id and _end < _start")
    similar = G.fragment_similarity(G.embedding_similarity(F.col("va"), F.col("vb")), F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), G.histogram_similarity(F.col("ha"), F.col("hb"))))
    costs = pairs.select("run", "from_id", "into_id", (1.0 - similar).alias("cost"))
    return _assign(costs, real, late, "from_id", "into_id").withColumn("accepted", F.col("similarity") >= threshold)


def group_pairs(limits: DataFrame, groups: DataFrame, pooled: DataFrame, orphans: DataFrame, starts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """run, orphan_id, group_id, similarity, accepted: which group an unmatched start belongs to.

    groups: run, id, canonical. A group can take an orphan if no member is there at the same time, one ended before it,
    and it isn't a member.
    """
    real = limits.filter("not short").select("run", "id", "first", "last")
    members = groups.join(real, ["run", "id"]).select("run", F.col("canonical").alias("group_id"), F.col("id").alias("member"), F.col("first").alias("mf"), F.col("last").alias("ml"))
    spans = orphans.join(real, ["run", "id"]).select("run", F.col("id").alias("orphan_id"), "first", "last")
    both = spans.join(members, "run")
    clash = F.max(((F.col("mf") <= F.col("last")) & (F.col("ml") >= F.col("first"))) | (F.col("member") == F.col("orphan_id")))
    fit = both.groupBy("run", "orphan_id", "group_id").agg(clash.alias("clash"), F.max(F.col("ml") < F.col("first")).alias("ended")).filter("not clash and ended").select("run", "orphan_id", "group_id")
    fit = fit.join(pooled.select("run", F.col("id").alias("group_id"), F.col("vec").alias("va"), F.col("hue").alias("ha")), ["run", "group_id"], "left").join(starts.select("run", F.col("id").alias("orphan_id"), F.col("vec").alias("vb"), F.col("hue").alias("hb")), ["run", "orphan_id"], "left")
    similar = G.fragment_similarity(G.embedding_similarity(F.col("va"), F.col("vb")), F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), G.histogram_similarity(F.col("ha"), F.col("hb"))))
    costs = fit.select("run", "orphan_id", "group_id", (1.0 - similar).alias("cost"))
    ids = groups.select("run", F.col("canonical").alias("id")).distinct()
    return _assign(costs, orphans.select("run", "id"), ids, "orphan_id", "group_id").withColumn("accepted", F.col("similarity") >= threshold)


def canonical_ids(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """run, id, canonical: the smallest id that accepted merges reach; merges of a run are one group."""
    rows = ids.select("run", F.col("id").alias("a"), F.col("id").alias("b")).unionByName(edges.select("run", "a", "b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(pdf["a"], pdf["b"]):
            p, q = sorted((root(int(a)), root(int(b))))
            parent[q] = p
        out = [(x, root(x)) for x in sorted(parent)]
        return pd.DataFrame({"run": pdf["run"].iloc[0], "id": [x for x, _ in out], "canonical": [c for _, c in out]})

    kind = dict(rows.dtypes)["run"]
    return rows.groupBy("run").applyInPandas(run, f"run {kind}, id long, canonical long")


def merge(masks: DataFrame, signals: DataFrame, min_frames: int = MIN_FRAMES, threshold: float = THRESHOLD, samples: int = SAMPLES) -> dict[str, DataFrame]:
    """Both passes: {"bounds", "pairs", "group_pairs", "canonical"}; all ids, short ones too, are in canonical."""
    limits = bounds(masks, min_frames)
    ends, starts = (edge_signatures(signals, limits, side, samples) for side in ("end", "start"))
    pairs = fragment_pairs(limits, ends, starts, threshold)
    edges = pairs.filter("accepted").select("run", F.col("from_id").alias("a"), F.col("into_id").alias("b"))
    groups = canonical_ids(limits.select("run", "id"), edges)
    late = limits.filter("not short and first > 0").select("run", "id")
    orphans = late.join(edges.select("run", F.col("b").alias("id")), ["run", "id"], "left_anti")
    frames = pooled_frames(signals, limits, samples)
    pooled = finalize(signals.join(frames, ["run", "id", "frame"]).join(groups, ["run", "id"]).select("run", F.col("canonical").alias("g"), "vec", "hue"), ["run", "g"]).withColumnRenamed("g", "id")
    second = group_pairs(limits, groups, pooled, orphans, starts, threshold)
    more = second.filter("accepted").select("run", F.col("group_id").alias("a"), F.col("orphan_id").alias("b"))
    return {"bounds": limits, "pairs": pairs, "group_pairs": second, "canonical": canonical_ids(limits.select("run", "id"), edges.unionByName(more))}


def merged_masks(masks: DataFrame, canonical: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """keys, id, frame, rle: the masks (rle) of a group's members united pixel by pixel, frame by frame."""
    rows = masks.join(canonical, [*keys, "id"]).drop("id").withColumnRenamed("canonical", "id")
    return united(rows, [*keys, "id", "frame"])


def densify(masks: DataFrame, totals: DataFrame) -> DataFrame:
    """Every frame 0..n-1 of every id of a run, box NULL where empty; totals: run, n. For exports only."""
    ids = masks.select("run", "id").distinct().join(totals, "run")
    spine = ids.filter("n > 0").select("run", "id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))).alias("frame"))
    return spine.join(masks.select("run", "id", "frame", "box"), ["run", "id", "frame"], "left")
