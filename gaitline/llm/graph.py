"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import through_disk

MAX_ROUNDS = 60
#: Edges to a file at least: few edges need few tasks.
FILE_EDGES = 50_000


def _written(edges: DataFrame, n: int | None = None) -> DataFrame:
    """edges through the shared folder; n: about how many there are, where that is known."""
    return through_disk(edges if n is None else edges.coalesce(max(4, 2 * n // FILE_EDGES)), "edges")


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("c", "m").alias("m"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1] or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: each node of the edges with the least node of its component. Nodes of an integer type, no nulls.

    The neighbours of a node never meet in one task: its least neighbour is aggregated, then joined back.
    Rounds end when nothing changes; each cuts its lineage in the shared folder.
    """
    now = _written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = down.join(near, F.col("u") == F.col("c"))
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = _written(small.filter("u <> v").distinct(), mark[0])
        last, mark = mark, _mark(now)
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
    raise RuntimeError("components did not settle")
