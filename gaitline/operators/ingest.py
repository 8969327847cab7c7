"""Ingest rules: what tables must look like, and how model outputs become them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitline.functions.skeleton import BLAZEPOSE_OF_COCO


def blazepose_to_coco(lm: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """17 joints in pixels of the frame from 33 landmarks relative to a crop; a missing visibility counts as 1."""
    joint = lambda p: F.struct((x1 + p["x"] * width).alias("x"), (y1 + p["y"] * height).alias("y"), F.coalesce(p["visibility"], F.lit(1.0)).alias("conf"))
    return F.array(*(joint(lm[k]) for k in BLAZEPOSE_OF_COCO))


def keep_class(df: DataFrame, column: str = "class_id", wanted: int = 0) -> DataFrame:
    """Rows of one detector class (0: person); reaches the scan as a filter."""
    return df.filter(F.col(column) == wanted)


def only_for(value: Column, track_id: Column, target: int | None) -> Column:
    """A signal for the target track alone; other rows keep their row with NULL. Without a target all have it."""
    return value if target is None else F.when(track_id == target, value)


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """df with `prefix` before all column names but those to keep."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


MISSING = ("raise", "null")


def total_frames(requested: DataFrame, frames: DataFrame, missing: str = "raise") -> DataFrame:
    """session, n of the sessions requested, by the last frame of each in frames(session, frame).

    A session without frames is an error when it is computed, or has NULL. ValueError for another rule.
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    known = frames.groupBy("session").agg((F.max("frame") + 1).alias("n"))
    found = requested.select("session").distinct().join(known, "session", "left")
    if missing == "null":
        return found
    message = F.concat(F.lit("no frames of session "), F.coalesce(F.col("session").cast("string"), F.lit("null")))
    return found.select("session", F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.raise_error(message)).alias("n"))


def at_frames(df: DataFrame, requested: DataFrame, keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """Rows of df at the requested (keys, frame); one row of NULLs where there is none, as past the end."""
    return requested.select(*keys, "frame").join(df, [*keys, "frame"], "left")


MODES, BACKENDS = ("pose", "segmentation", "both"), ("boxes", "chunked")


@dataclass(frozen=True)
class SessionOptions:
    """Options of a run, checked when made: ValueError says what doesn't fit.

    backend: how segments are tracked, by boxes frame by frame or in chunks; the chunks' options count for the latter only.
    """

    mode: str = "pose"
    backend: str = "boxes"
    fps: float = 15.0
    window_s: float = 3.0
    chunk_size: int = 600
    overlap: int = 50
    redetect_every: int | None = None
    max_people: int | None = None
    single: bool = False
    target: int | None = None
    reidentify: bool = False
    segmentation: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.backend not in BACKENDS:
            raise ValueError(f"backend must be one of {BACKENDS}")
        if self.backend != "boxes" and not self.segments():
            raise ValueError("a segment backend needs a mode with segmentation")
        if not self.fps > 0 or not self.window_s > 0:
            raise ValueError("fps and window_s must be positive")
        if self.chunk_size <= 0 or not 0 <= self.overlap < self.chunk_size:
            raise ValueError("chunk_size must be positive and overlap from 0 to below it")
        if self.redetect_every is not None and not 1 <= self.redetect_every <= self.chunk_size:
            raise ValueError("redetect_every must be from 1 to chunk_size")
        if self.max_people is not None and self.max_people < 1:
            raise ValueError("max_people must be at least 1")
        if self.target is not None and self.target < 0:
            raise ValueError("target must be a track number")
        # the pose path needs no cap to re-identify, the segmentation path does
        if self.reidentify and self.segments() and self.people() is None:
            raise ValueError("re-identification of segments needs max_people or a single person")

    def segments(self) -> bool:
        return self.segmentation or self.mode != "pose"

    def people(self) -> int | None:
        return 1 if self.single else self.max_people
