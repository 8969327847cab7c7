"""A cursor over the frames of a session: forward, back, seek, as a viewer steps through a result.

The rows are a table; a window of frames at a time is fetched by a range filter on the frame, which reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Replay:
    """Frames of df(frame, ...) one after another. Nothing is in view before the first step; `ahead` frames are fetched at once."""

    def __init__(self, df: DataFrame, ahead: int = 100) -> None:
        if ahead < 1:
            raise ValueError("ahead must be at least 1")
        self.df, self.ahead, self.cursor = df, ahead, -1
        bounds = df.agg(F.min("frame"), F.max("frame")).first()
        self.first, self.last = (0, -1) if bounds[0] is None else (int(bounds[0]), int(bounds[1]))
        self._held: dict[int, list[Row]] = {}
        self._from = self._to = 0  # frames that are held

    def __len__(self) -> int:
        return self.last - self.first + 1

    def current(self) -> list[Row] | None:
        """Rows of the frame in view, none for an empty frame; None before the first step."""
        return None if self.cursor < 0 else self._rows(self.first + self.cursor)

    def exhausted(self) -> bool:
        return self.cursor == len(self) - 1

    def forward(self) -> list[Row] | None:
        """The next frame; None, staying, at the end."""
        return self.seek(self.cursor + 1)

    def back(self) -> list[Row] | None:
        """The frame before; None, staying, at the first."""
        return self.seek(self.cursor - 1)

    def seek(self, index: int) -> list[Row] | None:
        """The frame of that number from 0; None, staying, where there is none."""
        if not 0 <= index < len(self):
            return None
        self.cursor = index
        return self.current()

    def reset(self) -> None:
        self.cursor = -1

    def _rows(self, frame: int) -> list[Row]:
        if not self._from <= frame < self._to:
            # around the frame, so that steps back are held as well
            self._from = max(self.first, frame - self.ahead // 4)
            self._to = self._from + self.ahead
            self._held = {}
            for r in self.df.filter(F.col("frame").between(self._from, self._to - 1)).orderBy("frame").collect():
                self._held.setdefault(r["frame"], []).append(r)
        return self._held.get(frame, [])
