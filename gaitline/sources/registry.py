"""Row sources by name: a pipeline says which tracker it wants, and options that this one takes."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Source = Callable[..., DataFrame]
_sources: dict[str, Source] = {}


def register(name: str, source: Source, replace: bool = False) -> Source:
    """source(spark, folder, **options) -> rows. ValueError for a name that is taken."""
    if name in _sources and not replace:
        raise ValueError(f"source {name!r} is registered already")
    _sources[name] = source
    return source


def names() -> list[str]:
    return sorted(_sources)


def build(name: str, spark: SparkSession, folder: str, **options: Any) -> DataFrame:
    """Rows of the source. ValueError for an unknown name or option, which says what there is."""
    if name not in _sources:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(names())}")
    taken = list(inspect.signature(_sources[name]).parameters)[2:]
    if unknown := sorted(set(options) - set(taken)):
        raise ValueError(f"source {name!r} takes {taken}, not {unknown}")
    return _sources[name](spark, folder, **options)
