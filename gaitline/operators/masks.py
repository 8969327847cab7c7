"""Masks as runs: rle array<struct<start, len>> over the pixels of a frame row by row, sorted, apart and not empty.

United masks are islands of runs, by windows within a frame. Overlaps of pairs and parts of a mask are worked out in numpy for a
whole Arrow batch at once: every mask gets a span of one long axis of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

RLE = "array<struct<start:bigint,len:int>>"


def run(start: Column, length: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), length.cast("int").alias("len"))


def from_box(box: Column, width: Column) -> Column:
    """The runs of a half-open box: one for each row; none for an empty box."""
    rows = F.transform(F.sequence(box["y0"], box["y1"] - 1), lambda y: run(y * width + box["x0"], box["x1"] - box["x0"]))
    return F.when((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), rows).otherwise(F.array().cast(RLE))


def area(rle: Column) -> Column:
    """Pixels; 0 for an empty mask, NULL for a missing one."""
    return F.aggregate(rle, F.lit(0).cast("long"), lambda s, r: s + r["len"])


def bounds(rle: Column, width: Column) -> Column:
    """Half-open box of a mask whose runs end with their rows; NULL for an empty one."""
    x0, x1 = F.transform(rle, lambda r: r["start"] % width), F.transform(rle, lambda r: r["start"] % width + r["len"])
    first, last = rle[0]["start"], F.element_at(rle, -1)["start"]
    box = F.struct(F.array_min(x0).cast("int").alias("x0"), F.floor(first / width).cast("int").alias("y0"), F.array_max(x1).cast("int").alias("x1"), (F.floor(last / width) + 1).cast("int").alias("y1"))
    return F.when(F.size(rle) > 0, box)


def united(masks: DataFrame, keys: Sequence[str], rle: str = "rle") -> DataFrame:
    """keys, rle: the pixels of any mask of a group; a group of empty masks has no row.

    The runs of a group, such as the members of one identity in one frame, have to fit a task.
    """
    runs = masks.select(*keys, F.explode(rle).alias("_r")).select(*keys, F.col("_r.start").alias("_s"), (F.col("_r.start") + F.col("_r.len")).alias("_e"))
    order = W.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("_s") <= reach, 0).otherwise(1)
    marked = runs.withColumn("_new", new).withColumn("_k", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    islands = marked.groupBy(*keys, "_k").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    return islands.groupBy(*keys).agg(F.array_sort(F.collect_list(run(F.col("_s"), F.col("_e") - F.col("_s")))).alias("rle"))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, start, length) of all runs of a batch."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    runs = column.flatten()
    return np.repeat(np.arange(len(size)), size), runs.field("start").to_numpy(zero_copy_only=False).astype(np.int64), runs.field("len").to_numpy(zero_copy_only=False).astype(np.int64)


def shared(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Pixels that both masks of each pair have."""
    (ma, sa, la), (mb, sb, lb) = _flat(a), _flat(b)
    out = np.zeros(len(a), np.int64)
    if not len(sa) or not len(sb):
        return out
    span = int(max((sa + la).max(), (sb + lb).max())) + 1
    sa, sb = sa + ma * span, sb + mb * span
    upto = np.concatenate(([0], np.cumsum(lb)))

    def covered(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(sb, x, "right") - 1
        return np.where(k >= 0, upto[k] + np.minimum(x - sb[k], lb[k]), 0)

    np.add.at(out, ma, covered(sa + la) - covered(sa))
    return out


def parts(column: pa.ListArray, width: np.ndarray) -> np.ndarray:
    """Connected parts of each mask; pixels that touch at a corner are connected."""
    mask, start, length = _flat(column)
    out = np.zeros(len(column), np.int64)
    if not len(start):
        return out
    # runs cut where their rows end
    w = np.asarray(width, np.int64)[mask]
    first, last = start // w, (start + length - 1) // w
    rows = last - first + 1
    own = np.repeat(np.arange(len(start)), rows)
    y = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(rows) - rows, rows)
    x0 = np.maximum(start[own] - y * w[own], 0)
    x1 = np.minimum(start[own] + length[own] - y * w[own], w[own])
    # one axis: a row of a mask is a line, its neighbours are the lines before and after
    line = mask[own] * (int(last.max()) + 2) + y
    span = int(w.max()) + 2
    lo, hi = line * span + x0, line * span + x1
    # runs of the next line whose ends reach over this one's start and whose starts lie up to this one's end
    begin, end = np.searchsorted(hi, lo + span, "left"), np.searchsorted(lo, hi + span, "right")
    n = np.maximum(end - begin, 0)
    u = np.repeat(np.arange(len(lo)), n)
    v = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    keep = line[v] == line[u] + 1
    u, v = u[keep], v[keep]
    label = np.arange(len(lo))
    while True:
        before = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == before).all():
            break
    np.add.at(out, mask[own][label == np.arange(len(lo))], 1)
    return out


def with_shared(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with inter long appended: pixels that the masks in columns a and b share; pair them by frame and box first."""
    i, j = pairs.columns.index(a), pairs.columns.index(b)
    schema = T.StructType([*pairs.schema.fields, T.StructField("inter", T.LongType())])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(shared(x.column(i), x.column(j)))], [*x.schema.names, "inter"])

    return pairs.mapInArrow(run_, schema)


def with_parts(masks: DataFrame, rle: str = "rle", width: str = "w", out: str = "parts") -> DataFrame:
    """masks with the number of connected parts appended; 0 for an empty mask."""
    i, j = masks.columns.index(rle), masks.columns.index(width)
    schema = T.StructType([*masks.schema.fields, T.StructField(out, T.LongType())])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(parts(x.column(i), x.column(j).to_numpy(zero_copy_only=False)))], [*x.schema.names, out])

    return masks.mapInArrow(run_, schema)


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """keys, a_id, b_id, inter, iou: pairs of masks (keys, id, w, rle) of the same frame that share pixels. Boxes are compared before."""
    def side(df: DataFrame, name: str, x: str) -> DataFrame:
        return df.select(*keys, F.col("id").alias(name), F.col("rle").alias(f"_r{x}"), bounds(F.col("rle"), F.col("w")).alias(f"_b{x}")).filter(F.col(f"_b{x}").isNotNull())

    both = side(a, a_id, "a").join(side(b, b_id, "b"), list(keys))
    p, q = F.col("_ba"), F.col("_bb")
    near = both.filter((p["x0"] < q["x1"]) & (q["x0"] < p["x1"]) & (p["y0"] < q["y1"]) & (q["y0"] < p["y1"])).drop("_ba", "_bb")
    found = with_shared(near, "_ra", "_rb").filter("inter > 0")
    union = area(F.col("_ra")) + area(F.col("_rb")) - F.col("inter")
    return found.select(*keys, a_id, b_id, "inter", (F.col("inter") / union).alias("iou"))


def usable(box: Column, n_parts: Column, height: Column, width: Column, margin: int = 1) -> Column:
    """Whether a frame's mask can stand for a person: not empty, in one part, and not at the frame's border."""
    inside = (box["x0"] > margin) & (box["y0"] > margin) & (box["x1"] - 1 < width - 1 - margin) & (box["y1"] - 1 < height - 1 - margin)
    return F.coalesce(box.isNotNull() & (n_parts == 1) & inside, F.lit(False))
