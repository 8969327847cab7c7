"""Trackers as Spark sources: anything with run(session) is read by format name, as a table or as a stream.

A backend gives the frames of a session in order, each with its rows. Sessions are partitions of a table. A stream reads a
bounded number of frames of each session a batch; its offset is the next frame.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from .schemas import DETECTIONS


@runtime_checkable
class Backend(Protocol):
    def run(self, session: str) -> Iterator[tuple[int, float, Sequence[dict[str, Any]]]]:
        """(frame, time in seconds, rows) of a session, frames rising without gaps; rows lack session, frame and t_s."""
        ...


def _rows(backend: Backend, session: str, schema: StructType, first: int = 0, most: int | None = None) -> Iterator[tuple]:
    last = -1
    for frame, t, rows in islice(backend.run(session), first, None if most is None else first + most):
        if frame <= last:
            raise ValueError(f"frames of session {session} do not rise: {frame} after {last}")
        last = frame
        for row in rows:
            full = {"session": session, "frame": frame, "t_s": t, **row}
            yield tuple(full.get(n) for n in schema.names)


class _Reader(DataSourceReader):
    def __init__(self, backend: Backend, sessions: Sequence[str], schema: StructType) -> None:
        self.backend, self.sessions, self.schema = backend, sessions, schema

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(s) for s in self.sessions]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.backend, partition.value, self.schema)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, backend: Backend, sessions: Sequence[str], schema: StructType, frames: int) -> None:
        self.backend, self.sessions, self.schema, self.frames = backend, sessions, schema, frames

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = start["frame"]
        longest = max((sum(1 for _ in islice(self.backend.run(s), first, first + self.frames)) for s in self.sessions), default=0)
        return self.readBetweenOffsets(start, end := {"frame": first + longest}), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        n = end["frame"] - start["frame"]
        return iter([row for s in self.sessions for row in _rows(self.backend, s, self.schema, start["frame"], n)] if n else [])


def register(spark: SparkSession, name: str, backend: Backend, schema: StructType = DETECTIONS) -> None:
    """Makes spark.read.format(name) and spark.readStream.format(name) read the backend; it goes to the executors by pickling.

    Options: sessions (comma-separated, required), frames (of a session a batch, 100). TypeError for no backend.
    """
    if not isinstance(backend, Backend):
        raise TypeError("a backend has run(session)")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return schema

        def _sessions(self) -> list[str]:
            given = [s for s in self.options.get("sessions", "").split(",") if s]
            if not given:
                raise ValueError("option sessions must name the sessions to read")
            return given

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(backend, self._sessions(), schema)

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
            return _StreamReader(backend, self._sessions(), schema, int(self.options.get("frames", "100")))

    spark.dataSource.register(Source)


def read(spark: SparkSession, name: str, sessions: Sequence[str]) -> DataFrame:
    return spark.read.format(name).option("sessions", ",".join(sessions)).load()
