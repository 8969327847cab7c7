"""Re-identification over tables and streams: one session is one key, its state machine steps frame by frame.

Rows: session, frame, t_s, raw_id (NULL: a frame without people), and for poses signature array<double>, color array<double>,
embedding array<double>, hip_x, hip_y, torso; for segments x, y, scale, aspect, fill, hue, embedding. In a stream a
frame is stepped when the watermark has passed it: until then its rows wait, in whatever batch they come, and event-time
timers step what is complete. In a table sessions are read in order, a batch of rows at a time.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from gaitline.operators.ordered import folded
from gaitline.operators.reid import PoseReid, Seen, Segment, SegmentReid

COLUMNS = ["session", "frame", "raw_id", "person_id", "event", "kind", "provisional_id", "into_id", "distance", "t", "aid", "forced"]
SCHEMA = "session string, frame long, raw_id long, person_id long, event boolean, kind string, provisional_id long, into_id long, distance double, t double, aid string, forced boolean"


#: What a frame's rows hold for either kind, after session, frame, t_s and raw_id.
POSE = {"signature": "array<double>", "color": "array<double>", "embedding": "array<double>", "hip_x": "double", "hip_y": "double", "torso": "double"}
SEGMENT = {"x": "double", "y": "double", "scale": "double", "aspect": "double", "fill": "double", "hue": "array<double>", "embedding": "array<double>"}


def _missing(x: Any) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


def _vector(x: Any) -> np.ndarray | None:
    return None if _missing(x) else np.array([np.nan if v is None else v for v in x], float)


def _point(x: Any, y: Any) -> np.ndarray | None:
    return None if _missing(x) or _missing(y) else np.array([x, y], float)


def _seen(r: dict) -> Seen:
    sig = _vector(r["signature"])
    return Seen(int(r["raw_id"]), sig if sig is not None else np.full(12, np.nan), _vector(r["color"]), _vector(r["embedding"]), _point(r["hip_x"], r["hip_y"]), None if _missing(r["torso"]) else float(r["torso"]))


def _segment(r: dict) -> Segment:
    shape = None if _missing(r["aspect"]) or _missing(r["fill"]) else (r["aspect"], r["fill"])
    return Segment(int(r["raw_id"]), _point(r["x"], r["y"]), float(r["scale"]), _vector(r["hue"]), shape, _vector(r["embedding"]))


def step_frame(machine: PoseReid | SegmentReid, person: Callable[[dict], Any], session: str, rows: list[dict]) -> list[tuple]:
    """Rows of SCHEMA of one whole frame: its people, then its events."""
    frame, now = int(rows[0]["frame"]), float(rows[0]["t_s"])
    people = [person(r) for r in sorted((r for r in rows if not _missing(r["raw_id"])), key=lambda r: r["raw_id"])]
    ids, events = machine.step(people, now)
    out = [(session, frame, raw, pid, False, None, None, None, None, now, None, None) for raw, pid in ids.items()]
    return out + [(session, frame, e["raw_id"], None, True, e["kind"], e["provisional_id"], e["person_id"], e["distance"], e["t"], e["aid"], e["forced"]) for e in events]


@dataclass
class _Session:
    machine: Any
    rows: list[dict] = field(default_factory=list)


def _table(df: DataFrame, columns: dict[str, str], make: Callable[[], Any], person: Callable[[dict], Any]) -> DataFrame:
    rows = df.select(F.col("session").cast("string").alias("session"), "frame", "t_s", "raw_id", *columns)

    def done(state: _Session, last: dict) -> list[tuple]:
        out = step_frame(state.machine, person, last["session"], state.rows) if state.rows else []
        state.rows = []
        return out

    def step(state: _Session, row: dict) -> list[tuple]:
        out = done(state, row) if state.rows and state.rows[0]["frame"] != row["frame"] else []
        state.rows.append(row)
        return out

    return folded(rows, ["session"], ["frame", "raw_id"], lambda: _Session(make()), step, done, SCHEMA, COLUMNS)


def resolve(df: DataFrame, **options: Any) -> DataFrame:
    """Batch: SCHEMA's rows of all sessions; sessions go side by side. options: PoseReid's."""
    return _table(df, POSE, lambda: PoseReid(**options), _seen)


def resolve_segments(df: DataFrame, max_people: int, **options: Any) -> DataFrame:
    """Batch: session, frame, raw_id, person_id of segments, never more than max_people in a session. options: SegmentReid's."""
    SegmentReid(max_people, **options)  # options are checked where the query is built
    return _table(df, SEGMENT, lambda: SegmentReid(max_people, **options), _segment).filter("not event").select("session", "frame", "raw_id", "person_id")


def _fields(columns: dict[str, str]) -> StructType:
    kinds = {"double": DoubleType(), "array<double>": ArrayType(DoubleType())}
    return StructType([StructField("frame", LongType()), StructField("t_s", DoubleType()), StructField("raw_id", LongType()), *(StructField(n, kinds[k]) for n, k in columns.items())])


def _plain(x: Any) -> Any:
    """A value of a pandas cell as the state takes it."""
    if isinstance(x, (list, np.ndarray)):
        return [None if v is None else float(v) for v in x]
    return None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x


class FrameProcessor(StatefulProcessor):
    """transformWithState: rows wait, typed, for the timer of their frame; the machine is stepped by timers only."""

    def __init__(self, columns: dict[str, str], make: Callable[[], Any], person: Callable[[dict], Any], idle_s: float | None) -> None:
        self.columns, self.make, self.person, self.idle_s = columns, make, person, idle_s
        self.names = ["frame", "t_s", "raw_id", *columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _fields(self.columns))
        self.machine = handle.getValueState("machine", StructType([StructField("blob", BinaryType()), StructField("last", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            new = []
            for r in pdf.to_dict("records"):
                raw = _plain(r["raw_id"])
                new.append((int(r["frame"]), float(r["t_s"]), None if raw is None else int(raw), *(_plain(r[c]) for c in self.columns)))
            self.waiting.appendList(new)
            for t in {r[1] for r in new}:
                self.handle.registerTimer(_ms(t))
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        rows = [dict(zip(self.names, r)) for r in self.waiting.get()]
        held = self.machine.get()
        machine, last = (pickle.loads(held[0]), held[1]) if held is not None else (self.make(), -1)
        now: dict[int, list[dict]] = {}
        for r in rows:
            if _ms(r["t_s"]) <= at:
                now.setdefault(r["frame"], []).append(r)
        out = []
        for frame in sorted(now):
            if self.idle_s is not None and last >= 0 and _ms(now[frame][0]["t_s"]) - last > self._idle_ms():
                machine = self._without_people(machine)
            out += step_frame(machine, self.person, str(key[0]), now[frame])
            last = max(last, _ms(now[frame][0]["t_s"]))
        if now:
            later = [tuple(r[n] for n in self.names) for r in rows if _ms(r["t_s"]) > at]
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
            if self.idle_s is not None:
                self.handle.registerTimer(last + self._idle_ms() + 1)
        elif self.idle_s is not None and at > last + self._idle_ms():
            machine = self._without_people(machine)
        self.machine.update((pickle.dumps(machine), last))
        frame = pd.DataFrame(out, columns=COLUMNS)
        yield frame.astype({c: "Int64" for c in ("person_id", "raw_id", "provisional_id", "into_id")}) if out else frame

    def _idle_ms(self) -> int:
        return round((self.idle_s or 0) * 1000)

    def _without_people(self, machine: Any) -> Any:
        """Nobody has been seen for so long: people go, their numbers are not given again."""
        fresh = self.make()
        fresh.next_id = machine.next_id
        return fresh

    def close(self) -> None:
        pass


#: Event time of second 0: a stream's watermark begins at 0, and what is not above it is late.
EPOCH_S = 86_400


def _ms(t: float) -> int:
    return math.ceil(round((t + EPOCH_S) * 1000, 6))


def _stream(df: DataFrame, columns: dict[str, str], delay_s: float, make: Callable[[], Any], person: Callable[[dict], Any], idle_s: float | None) -> DataFrame:
    if delay_s <= 0:
        raise ValueError("delay_s must be above 0: without it a frame's later rows are late")
    ts = F.timestamp_micros(((F.col("t_s") + EPOCH_S) * 1_000_000).cast("long"))
    rows = df.select(F.col("session").cast("string").alias("session"), F.col("frame").cast("long").alias("frame"), F.col("t_s").cast("double").alias("t_s"), F.col("raw_id").cast("long").alias("raw_id"), *columns, ts.alias("ts"))
    timed = rows.withWatermark("ts", f"{round(delay_s * 1000)} milliseconds").groupBy("session")
    return timed.transformWithStateInPandas(FrameProcessor(columns, make, person, idle_s), SCHEMA, "Append", "EventTime")


def resolve_stream(df: DataFrame, delay_s: float = 1.0, idle_s: float | None = None, **options: Any) -> DataFrame:
    """Stream: as resolve(), each frame once the watermark, delay_s behind the newest row of the stream, has passed it.

    t_s is event time in seconds, 0 or above. Rows that come later than that are dropped; the last frames come out when newer rows have
    moved the watermark. idle_s: a session without rows for so long forgets its people.
    """
    PoseReid(**options)
    return _stream(df, POSE, delay_s, lambda: PoseReid(**options), _seen, idle_s)


def resolve_segments_stream(df: DataFrame, max_people: int, delay_s: float = 1.0, **options: Any) -> DataFrame:
    """Stream: as resolve_segments() with its events, by resolve_stream()'s rules; nobody is forgotten."""
    SegmentReid(max_people, **options)
    return _stream(df, SEGMENT, delay_s, lambda: SegmentReid(max_people, **options), _segment, None)
