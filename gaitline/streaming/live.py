"""Live features of a stream: each track keeps what its windows need of the past; a row comes out for each frame of a full window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gaitline.operators import live

COLUMNS = ["session", "track_id", "frame", "window_energy", "activity"]
SCHEMA = "session string, track_id long, frame long, window_energy double, activity double"


class WindowProcessor(StatefulProcessor):
    """State: the last `rows` (frame, value) of a track. Rows of a track come in order of frames, whatever the batch."""

    def __init__(self, rows: int, fps: float, threshold: float) -> None:
        self.rows, self.fps, self.threshold = rows, fps, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", StructType([StructField("frame", LongType()), StructField("v", DoubleType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(r[0], r[1]) for r in self.ring.get()]
        pdf = pd.concat(list(rows)).sort_values("frame")
        both = pd.concat([pd.DataFrame(held, columns=["frame", "v"]), pdf[["frame", "v"]]], ignore_index=True) if held else pdf[["frame", "v"]].reset_index(drop=True)
        step = (both["v"].diff() * self.fps) ** 2
        steps = step.rolling(self.rows - 1, min_periods=1)
        over = (step > self.threshold).astype(float).where(step.notna()).rolling(self.rows - 1, min_periods=1)
        out = pd.DataFrame({"frame": both["frame"], "window_energy": steps.mean(), "activity": over.mean()}).iloc[len(held):]
        out = out[out.index >= self.rows - 1]
        self.ring.put([(int(f), None if pd.isna(v) else float(v)) for f, v in both.tail(self.rows).itertuples(index=False)])
        out.insert(0, "track_id", int(key[1]))
        out.insert(0, "session", str(key[0]))
        yield out[COLUMNS]

    def close(self) -> None:
        pass


def windows(df: DataFrame, rows: int, fps: float, threshold: float) -> DataFrame:
    """Stream of session, track_id, frame, v -> SCHEMA: mean squared speed of the steps inside each full window."""
    keyed = df.select(F.col("session").cast("string").alias("session"), F.col("track_id").cast("long").alias("track_id"), F.col("frame").cast("long").alias("frame"), F.col("v").cast("double").alias("v"))
    return keyed.groupBy("session", "track_id").transformWithStateInPandas(WindowProcessor(rows, fps, threshold), SCHEMA, "Append", "None")


LIVE_COLUMNS = ["session", "track_id", "frame", *live.FEATURES]
LIVE_SCHEMA = "session string, track_id long, frame long, " + ", ".join(f"{n} double" for n in live.FEATURES)
_ARRAY = ArrayType(DoubleType())


class LiveProcessor(StatefulProcessor):
    """State, typed: the history that a live.Window needs. Rows of a track come in order of frames, whatever the batch."""

    def __init__(self, window: live.Window, ttl_ms: int | None) -> None:
        self.window, self.ttl_ms = window, ttl_ms
        self.shapes = {k: v.shape[1:] for k, v in window.fresh().items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", StructType([StructField(n, _ARRAY) for n in self.shapes]), self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.past.get()
        past = self.window.fresh() if held is None else {n: np.array(v, float).reshape(-1, *shape) for (n, shape), v in zip(self.shapes.items(), held)}
        pdf = pd.concat(list(rows)).sort_values("frame", kind="stable")
        new = {n: pdf[n].to_numpy(dtype=float, na_value=np.nan) for n in live.SIGNALS}
        new["pose"] = np.array([[np.nan if v is None else v for v in p] for p in pdf["pose"]], float)
        out, past = self.window.step(new, past)
        self.past.update(tuple(past[n].ravel().tolist() for n in self.shapes))
        found = pd.DataFrame({n: out[n] for n in live.FEATURES})
        found.insert(0, "frame", pdf["frame"].to_numpy())
        found.insert(0, "track_id", int(key[1]))
        found.insert(0, "session", str(key[0]))
        yield found[out["full"]]

    def close(self) -> None:
        pass


def live_rows(df: DataFrame, window: live.Window, ttl_ms: int | None = None) -> DataFrame:
    """Stream of live.signals()'s rows with session, track_id, frame -> LIVE_SCHEMA, as live.windowed() of the whole table.

    ttl_ms: a track's history goes so long, by the clock, after its last row.
    """
    keyed = df.select(F.col("session").cast("string").alias("session"), F.col("track_id").cast("long").alias("track_id"), F.col("frame").cast("long").alias("frame"), "pose", *live.SIGNALS)
    return keyed.groupBy("session", "track_id").transformWithStateInPandas(LiveProcessor(window, ttl_ms), LIVE_SCHEMA, "Append", "None" if ttl_ms is None else "ProcessingTime")


DERIVED = ["session", "track_id", "frame", "vel", "acc"]


class DerivativeProcessor(StatefulProcessor):
    """State, typed: a track's last time, coordinates and velocities; forgotten after a gap."""

    def __init__(self, forget_s: float | None, ttl_ms: int | None) -> None:
        self.forget_s, self.ttl_ms = forget_s, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("t", DoubleType()), StructField("x", _ARRAY), StructField("v", _ARRAY)]), self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out = self.last.get(), []
        for r in pd.concat(list(rows)).sort_values("frame", kind="stable").itertuples():
            x = np.array([np.nan if v is None else v for v in r.x], float)
            vel = acc = np.full(len(x), np.nan)
            if held is not None and (self.forget_s is None or r.t_s - held[0] <= self.forget_s):
                dt = max(r.t_s - held[0], 1e-3)
                vel = (x - np.array(held[1], float)) / dt
                acc = (vel - np.array(held[2], float)) / dt
            held = r.t_s, x.tolist(), vel.tolist()
            out.append((str(key[0]), int(key[1]), int(r.frame), vel.tolist(), acc.tolist()))
        self.last.update(held)
        yield pd.DataFrame(out, columns=DERIVED)

    def close(self) -> None:
        pass


def derivatives(df: DataFrame, forget_s: float | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Stream of session, track_id, frame, t_s, x array<double> -> session, track_id, frame, vel, acc: change by elapsed time, 1 ms at least.

    A missing value is NaN. After a gap of over forget_s a track begins anew; ttl_ms: its state goes, by the clock, so long after
    its last row.
    """
    keyed = df.select(F.col("session").cast("string").alias("session"), F.col("track_id").cast("long").alias("track_id"), F.col("frame").cast("long").alias("frame"), F.col("t_s").cast("double").alias("t_s"), "x")
    schema = "session string, track_id long, frame long, vel array<double>, acc array<double>"
    return keyed.groupBy("session", "track_id").transformWithStateInPandas(DerivativeProcessor(forget_s, ttl_ms), schema, "Append", "None" if ttl_ms is None else "ProcessingTime")


def first_sightings(df: DataFrame) -> DataFrame:
    """Stream: the first row of each track."""
    return df.dropDuplicates(["session", "track_id"])


def tumbling(df: DataFrame, ts: str, length: str, delay: str, *keys: str) -> DataFrame:
    """Stream: rows and distinct tracks in event-time windows, late rows dropped after the delay."""
    return df.withWatermark(ts, delay).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("rows_seen"), F.approx_count_distinct("track_id").alias("tracks"))
