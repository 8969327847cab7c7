"""How well identities persist between two runs: correspondence, switches, chunk boundaries, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import masks
from .matching import assign, overlaps

FRAME = ["session", "frame"]
LEAST_IOU = 0.1


def same_lengths(oracle: DataFrame, baseline: DataFrame) -> DataFrame:
    """session, n: number of frames of each session, of two tables (session, n) with a row for each id or each session.

    An error, when it is computed, where the ids of a run differ in length, the runs do, or one lacks a session.
    """
    each = oracle.select("session", F.lit(0).alias("run"), "n").unionByName(baseline.select("session", F.lit(1).alias("run"), "n"))
    ends = each.groupBy("session").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("run").alias("runs"))
    message = F.concat(F.lit("runs of unequal length in session "), F.coalesce(F.col("session").cast("string"), F.lit("null")))
    return ends.select("session", F.when((F.col("lo") == F.col("hi")) & (F.col("runs") == 2), F.col("lo")).otherwise(F.raise_error(message)).alias("n"))


def correspondence(oracle: DataFrame, baseline: DataFrame, least: float = LEAST_IOU, lengths: DataFrame | None = None, pixels: bool = False) -> DataFrame:
    """session, frame, oracle_id, baseline_id, iou: optimal one-to-one matches by overlap, of at least `least`; every oracle row
    is returned, NULL where unmatched. The assignment is over all overlaps, then the threshold applies.

    pixels: by the masks' runs (rle) instead of boxes. lengths: same_lengths() of the two runs; an error if they are not of one video, and frames beyond it go.
    """
    if lengths is not None:
        oracle = oracle.join(lengths, "session").filter("frame < n").drop("n")
    pairs = (masks.overlaps if pixels else overlaps)(oracle, baseline, FRAME, "oracle_id", "baseline_id")
    found = assign(pairs, FRAME, "oracle_id", "baseline_id", "iou").filter(F.col("iou") >= least)
    return oracle.select(*FRAME, F.col("id").alias("oracle_id")).join(found, [*FRAME, "oracle_id"], "left")


def switch_events(corr: DataFrame, entity: str, other: str, chunk: int) -> DataFrame:
    """Where an entity goes to another that it has never had: last frame of the one, first of the other, and whether in another chunk.

    Frames without a match are no event.
    """
    seen = corr.filter(F.col(entity).isNotNull() & F.col(other).isNotNull())
    by_time = W.partitionBy("session", entity).orderBy("frame", other)
    first = F.row_number().over(W.partitionBy("session", entity, other).orderBy("frame"))
    rows = seen.select("session", F.col(entity).alias("entity_id"), F.col(other).alias("to_id"), F.col("frame").alias("new_seen_frame"), F.lag(other).over(by_time).alias("from_id"), F.lag("frame").over(by_time).alias("last_seen_frame"), first.alias("nth"))
    crossing = F.floor(F.col("last_seen_frame") / chunk) != F.floor(F.col("new_seen_frame") / chunk)
    return rows.filter((F.col("nth") == 1) & (F.col("from_id") != F.col("to_id"))).select("session", "entity_id", "from_id", "to_id", "last_seen_frame", "new_seen_frame", crossing.alias("cross_chunk"))


def boundary_checks(corr: DataFrame, total_frames: DataFrame, chunk: int) -> DataFrame:
    """For each boundary k*chunk and oracle id: its last match before and first from there on, each within one chunk.

    total_frames: session, n. Only the two chunks beside a boundary can matter, so each row goes to at most four boundaries.
    """
    seen = corr.filter("baseline_id is not null").select("session", "frame", "oracle_id", "baseline_id")
    bounds = total_frames.select("session", F.ceil(F.col("n") / chunk).cast("long").alias("chunks"))
    k = F.floor(F.col("frame") / chunk).cast("long")
    spread = seen.join(bounds, "session").withColumn("k", F.explode(F.sequence(F.greatest(k - 1, F.lit(1)), k + 2))).filter("k < chunks").withColumn("boundary_frame", F.col("k") * chunk)
    b, f = F.col("boundary_frame"), F.col("frame")
    before, after = (f < b) & (b - f <= chunk), (f >= b) & (f - b <= chunk)
    sides = spread.groupBy("session", "boundary_frame", "oracle_id").agg(
        F.max_by("baseline_id", F.when(before, f)).alias("before_baseline_id"), F.max(F.when(before, f)).alias("_b"), F.min_by("baseline_id", F.when(after, f)).alias("after_baseline_id"), F.min(F.when(after, f)).alias("_a")
    )
    kept = sides.filter("_a is not null and _b is not null").drop("_a", "_b")
    return kept.withColumn("correct", F.col("before_baseline_id") == F.col("after_baseline_id"))


def report(corr: DataFrame, total_frames: DataFrame, chunk: int) -> DataFrame:
    """One row a session: fragmentations and swaps, across and within chunks, and the boundaries' accuracy (NULL for none)."""
    count = lambda c, name: F.count_if(c).alias(name)
    frag = switch_events(corr, "oracle_id", "baseline_id", chunk).groupBy("session").agg(count(F.lit(True), "fragmentation_count"), count(F.col("cross_chunk"), "cross_chunk_fragmentation_count"))
    swap = switch_events(corr, "baseline_id", "oracle_id", chunk).groupBy("session").agg(count(F.lit(True), "swap_count"), count(F.col("cross_chunk"), "cross_chunk_swap_count"))
    checks = boundary_checks(corr, total_frames, chunk).groupBy("session").agg(count(F.col("correct"), "correct_boundary_matches"), count(F.lit(True), "total_boundaries_checked"))
    out = total_frames.select("session").join(frag, "session", "left").join(swap, "session", "left").join(checks, "session", "left").na.fill(0)
    out = out.withColumn("intra_chunk_fragmentation_count", F.col("fragmentation_count") - F.col("cross_chunk_fragmentation_count")).withColumn("intra_chunk_swap_count", F.col("swap_count") - F.col("cross_chunk_swap_count"))
    return out.withColumn("boundary_accuracy", F.try_divide(F.col("correct_boundary_matches"), F.col("total_boundaries_checked")))


def churn(df: DataFrame, keys: list[str], track: str = "track_id") -> DataFrame:
    """keys, track, frames, first_frame, last_frame."""
    return df.groupBy(*keys, track).agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def lifespans(tracks: DataFrame, keys: list[str], short: int = 15) -> DataFrame:
    """Of churn()'s rows: number of tracks, shortest, upper median, longest, those under `short` frames and their share."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("frames", "first_frame", "last_frame"))
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    rows = tracks.select(*keys, "frames", rank.alias("r"), n.alias("n"))
    upper = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("frames")))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("tracks"), F.min("frames").alias("shortest"), upper.alias("upper_median"), F.max("frames").alias("longest"), F.count_if(F.col("frames") < short).alias("short_tracks"), F.avg((F.col("frames") < short).cast("double")).alias("short_share"))
