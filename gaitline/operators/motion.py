"""Per-track motion: speeds, energies, sliding windows, symmetry, excursion, activity, blinks, derivatives.

Input rows are one frame of one track, with the track's key columns and an order column. All windows of a track share
one partitioning and order, so Spark plans one exchange and one sort for however many features are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from gaitline.functions import geometry as G
from gaitline.functions.skeleton import CLINICAL_MOVING, CLINICAL_POINTS, KP, LIMBS

TRACK = ("session", "track_id")


def track(keys: Sequence[str] = TRACK, order: str = "frame") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def window_rows(window_s: float, fps: float) -> int:
    """Frames of a feature window: at least 8."""
    return max(8, int(window_s * fps))


def joint_speeds(kp: Column, before: Column, fps: float) -> Column:
    """Speed of each joint in units a second; NULL in a track's first frame and where a point is missing."""
    return F.zip_with(kp, before, lambda p, q: G.distance(p, q) * fps)


def with_speeds(df: DataFrame, fps: float, keys: Sequence[str] = TRACK) -> DataFrame:
    return df.withColumn("speeds", joint_speeds(F.col("kp"), F.lag("kp").over(track(keys)), fps))


def energy(speeds: Column) -> Column:
    """Sum of squared speeds; missing joints don't count, and a frame without any, such as the first, is 0."""
    return F.coalesce(F.aggregate(speeds, F.lit(0.0), lambda s, v: s + F.coalesce(v * v, F.lit(0.0))), F.lit(0.0))


def strict_energy(speeds: Column) -> Column:
    """As the live path has it: one missing joint makes the step missing."""
    return F.aggregate(speeds, F.lit(0.0), lambda s, v: s + v * v)


def movement_energy(df: DataFrame, fps: float, keys: Sequence[str] = TRACK) -> DataFrame:
    return with_speeds(df, fps, keys).withColumn("movement_energy", energy(F.col("speeds")))


def sliding(df: DataFrame, step: Column, rows: int, threshold: float, keys: Sequence[str] = TRACK) -> DataFrame:
    """window_energy: mean of the steps inside a full window of `rows` frames (there are rows - 1); activity: share above threshold.

    Rows whose window isn't full are left out. A step is missing in a track's first frame.
    """
    steps = track(keys).rowsBetween(-(rows - 2), 0)
    full = F.count(F.lit(1)).over(track(keys).rowsBetween(-(rows - 1), 0)) == rows
    named = df.withColumn("step", step)
    out = named.select(*df.columns, F.avg("step").over(steps).alias("window_energy"), F.avg((F.col("step") > threshold).cast("double")).over(steps).alias("activity"), full.alias("_full"))
    return out.filter("_full").drop("_full")


def symmetry(df: DataFrame, fps: float, keys: Sequence[str] = TRACK) -> DataFrame:
    """One row a track: |left - right| / (left + right) of the limbs' mean speeds; NULL where nothing moves."""
    spread = with_speeds(df, fps, keys)
    means = spread.groupBy(*keys).agg(*(F.avg(F.col("speeds")[KP[f"{s}_{n}"]]).alias(f"{s}_{n}") for n in LIMBS for s in ("left", "right")))
    si = lambda n: F.try_divide(F.abs(F.col(f"left_{n}") - F.col(f"right_{n}")), F.when(F.col(f"left_{n}") + F.col(f"right_{n}") > 1e-8, F.col(f"left_{n}") + F.col(f"right_{n}")))
    return means.select(*keys, *(si(n).alias(f"{n}_symmetry") for n in LIMBS))


def excursion(df: DataFrame, normalize: bool = True, keys: Sequence[str] = TRACK) -> DataFrame:
    """One row a track: range of the hips' height, in mean torso lengths if normalized."""
    y, torso = G.hip_center(F.col("kp"))["y"], G.torso_length(F.col("kp"))
    found = df.groupBy(*keys).agg((F.max(y) - F.min(y)).alias("span"), F.avg(F.when(torso > 1e-6, torso)).alias("torso"))
    value = F.try_divide(F.col("span"), F.col("torso")) if normalize else F.col("span")
    return found.select(*keys, value.alias("vertical_excursion"))


def activity_ratio(df: DataFrame, value: Column, threshold: float, keys: Sequence[str] = TRACK) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((value > threshold).cast("double")).alias("activity_ratio"))


def blink_rate(df: DataFrame, ratio: str, rows: int, window_s: float, threshold: float = 0.2, keys: Sequence[str] = TRACK) -> DataFrame:
    """Closings (ratio falls under the threshold) inside each full window, a minute. Frames without the ratio don't count."""
    seen = df.filter(F.col(ratio).isNotNull())
    closed = F.col(ratio) < threshold
    edge = (closed & ~F.lag(closed).over(track(keys))).cast("int")
    full = F.count(F.lit(1)).over(track(keys).rowsBetween(-(rows - 1), 0)) == rows
    marked = seen.select(*df.columns, F.coalesce(edge, F.lit(0)).alias("_edge"), full.alias("_full"))
    rate = F.sum("_edge").over(track(keys).rowsBetween(-(rows - 2), 0)) / window_s * 60
    return marked.select(*df.columns, rate.alias("blink_rate_per_min"), "_full").filter("_full").drop("_full")


def clinical(df: DataFrame, keys: Sequence[str] = TRACK, forget_s: float | None = None) -> DataFrame:
    """97 columns: 38 normalized coordinates, 27 derived values, 32 velocities and accelerations by elapsed time (1 ms at least).

    forget_s: after a longer gap a track's derivatives begin anew.
    """
    base = df.withColumn("_n", G.normalized(F.col("kp")))
    coords = {f"{n}_{a}": F.col("_n")[n][a] for n in CLINICAL_POINTS for a in "xy"}
    base = base.select(*df.columns, "_n", *(c.alias(k) for k, c in coords.items()))
    base = base.select("*", *(c.alias(k) for k, c in G.derived(F.col("_n")).items())).drop("_n")
    w, moving = track(keys), [f"{n}_{a}" for n in CLINICAL_MOVING for a in "xy"]
    base = base.withColumn("_dt", F.greatest(F.col("t_s") - F.lag("t_s").over(w), F.lit(1e-3)))
    # greatest() skips the first row's missing step, so it is put back
    known = F.lag("t_s").over(w).isNotNull()
    base = base.withColumn("_dt", F.when(known if forget_s is None else known & (F.col("t_s") - F.lag("t_s").over(w) <= forget_s), F.col("_dt")))
    base = base.select("*", *(((F.col(m) - F.lag(m).over(w)) / F.col("_dt")).alias(f"{m}_vel") for m in moving))
    return base.select("*", *(((F.col(f"{m}_vel") - F.lag(f"{m}_vel").over(w)) / F.col("_dt")).alias(f"{m}_acc") for m in moving)).drop("_dt")


def synchrony(a: DataFrame, b: DataFrame, window: int, step: int, keys: Sequence[str] = ("session",), value: str = "v", order: str = "frame") -> DataFrame:
    """keys, frame_start, frame_end (exclusive), synchrony: correlation of two signals in hopping windows.

    Signals are paired by frame, as far as the shorter goes; a partial last window is dropped. Missing values count as
    the mean. A constant side gives NULL. Each frame goes to the windows that hold it, ceil(window / step) at most.
    """
    pairs = a.select(*keys, order, F.col(value).alias("_a")).join(b.select(*keys, order, F.col(value).alias("_b")), [*keys, order])
    last = pairs.groupBy(*keys).agg((F.max(order) + 1).alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col(order) - window + 1) / step)).cast("long")
    final = F.floor(F.col(order) / step).cast("long")
    starts = F.when(final >= first, F.sequence(first, final))
    spread = pairs.join(last, list(keys)).withColumn("_k", F.explode(starts)).withColumn("frame_start", F.col("_k") * step).filter(F.col("frame_start") + window <= F.col("_n"))
    g = spread.groupBy(*keys, "frame_start").agg(F.covar_pop("_a", "_b").alias("c"), F.stddev_pop("_a").alias("sa"), F.stddev_pop("_b").alias("sb"))
    moving = (F.col("sa") >= 1e-8) & (F.col("sb") >= 1e-8)
    return g.select(*keys, "frame_start", (F.col("frame_start") + window).alias("frame_end"), F.when(moving, F.try_divide(F.col("c"), F.col("sa") * F.col("sb"))).alias("synchrony"))


def proximity(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("session",), equal: bool = False) -> DataFrame:
    """Distance of two tracks' hips, frame by frame; frames that either lacks are left out.

    equal: the tracks must have as many frames as each other; an error, when it is computed, where they don't.
    """
    left = a.select(*keys, "frame", G.hip_center(F.col("kp")).alias("_a"))
    right = b.select(*keys, "frame", G.hip_center(F.col("kp")).alias("_b"))
    out = left.join(right, [*keys, "frame"]).select(*keys, "frame", G.distance(F.col("_a"), F.col("_b")).alias("proximity"))
    if not equal:
        return out
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_na"), (right, "_nb"))]
    both = counts[0].join(counts[1], list(keys), "full")
    same = F.when(F.col("_na").eqNullSafe(F.col("_nb")), True).otherwise(F.raise_error(F.lit("sequences of unequal length")))
    return out.join(both.select(*keys, same.alias("_same")), list(keys)).filter("_same").drop("_same")


def strictly_later(time: Column, window: WindowSpec) -> Column:
    """max(time, last one + 1) along the window: what is above its own number by the most so far, and the number."""
    n = F.row_number().over(window).cast("long")
    return F.max(time - n).over(window.rowsBetween(W.unboundedPreceding, 0)) + n


def ema(df: DataFrame, value: str, alpha: float, keys: Sequence[str] = TRACK, order: str = "frame") -> DataFrame:
    """Exponential average at each track's end: alpha of the past, the rest of the new; missing values are passed over.

    The fold is a sum with weights by the place from the end, so a track's rows are added up where they lie.
    """
    one = W.partitionBy(*keys)
    held = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.row_number().over(one.orderBy(order)).alias("_i"), F.count(F.lit(1)).over(one).alias("_m"))
    weight = F.pow(F.lit(float(alpha)), F.col("_m") - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(1.0 - alpha)
    found = held.groupBy(*keys).agg(F.sum(F.col("_v") * weight).alias("ema"))
    return df.select(*keys).distinct().join(found, list(keys), "left")
