"""All queries of the engine and their DuckDB equivalents, by name."""

from __future__ import annotations

from . import appearance, identity, live, more, pixels, pose  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
