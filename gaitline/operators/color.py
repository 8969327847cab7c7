"""Colour and appearance from pixel rows and vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import folded

#: Bins over hues 0..180, least saturation and pixels.
BINS, LEAST_SAT, LEAST_PIXELS = 16, 0.15, 25


def hue_histogram(pixels: DataFrame, keys: Sequence[str], hue: str, sat: str, least: int = LEAST_PIXELS) -> DataFrame:
    """keys, bin, share: saturations summed by hue, as shares; none with fewer than `least` coloured pixels. Empty bins have no row."""
    seen = pixels.filter(F.col(sat) > LEAST_SAT).select(*keys, F.least(F.floor(F.col(hue) / (180.0 / BINS)), F.lit(BINS - 1)).cast("long").alias("bin"), F.col(sat).alias("_s"))
    bins = seen.groupBy(*keys, "bin").agg(F.sum("_s").alias("s"), F.count(F.lit(1)).alias("n"))
    total = bins.groupBy(*keys).agg(F.sum("s").alias("total"), F.sum("n").alias("pixels")).filter(F.col("pixels") >= least)
    return bins.join(total, list(keys)).select(*keys, "bin", F.try_divide(F.col("s"), F.col("total")).alias("share"))


def region_mean(pixels: DataFrame, keys: Sequence[str], hue: str, sat: str, least: int = 9) -> DataFrame:
    """keys, mean_h, mean_s in 0..1 of the pixels of a region; none with fewer than `least`."""
    g = pixels.groupBy(*keys).agg(F.avg(hue).alias("h"), F.avg(sat).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") >= least).select(*keys, (F.col("h") / 180).alias("mean_h"), (F.col("s") / 255).alias("mean_s"))


def embedding_ema(df: DataFrame, keys: Sequence[str], vec: str, order: str, keep: float = 0.9) -> DataFrame:
    """keys, vec: running mean of unit vectors in order, brought back to length 1 at each step; missing vectors are passed over."""
    kinds = dict(df.dtypes)
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(vec).alias("_v"))

    def step(state: list, row: dict) -> list[tuple]:
        if row["_v"] is not None:
            new = np.array(row["_v"], np.float64)
            if not state:
                state.append(new)
            else:
                mixed = keep * state[0] + (1 - keep) * new
                size = np.sqrt((mixed * mixed).sum())
                if size >= 1e-9:
                    state[0] = mixed / size
        return []

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", vec array<double>"
    return folded(rows, keys, ["_o"], list, step, lambda state, last: [(*(last[k] for k in keys), state[0].tolist() if state else None)], schema, [*keys, "vec"])
