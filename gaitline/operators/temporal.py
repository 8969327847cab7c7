"""As-of joins: the last row of another stream at or before each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, tolerance: int | None = None) -> DataFrame:
    """left with `value` of the right row with the largest time at or before its own, of equal keys; NULL beyond the tolerance.

    Both sides are interleaved in one sort and the value is carried forward: one shuffle, no pairs. Right rows of
    equal time: the largest value.
    """
    rows = left.withColumn("_side", F.lit(1)).withColumn("_v", F.struct(F.lit(None).cast(dict(right.dtypes)[value]).alias("v"), F.lit(None).cast(dict(right.dtypes)[time]).alias("t")))
    other = right.select(*keys, F.col(time), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v"), F.col(time).alias("t")).alias("_v"))
    both = rows.unionByName(other, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(time, "_side", "_v.v").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w)
    out = both.withColumn("_last", last).filter("_side = 1")
    ok = F.lit(True) if tolerance is None else F.col(time) - F.col("_last.t") <= tolerance
    return out.select(*left.columns, F.when(ok, F.col("_last.v")).alias(value))
