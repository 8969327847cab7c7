"""Work on ordered sequences in Arrow batches, many keys a batch, with one sort and no Python call for each key.

A window numbers each key's rows, which clusters and sorts them; where the input is dealt by the keys already, nothing is
dealt again. The batches then hold one sequence after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows that are worked on at a time, at least: whole sequences.
ROWS = 50_000
NUMBER = "_n"


def numbered(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """df with its rows' numbers in each key from 1; rows are sorted by key and number within tasks."""
    return df.withColumn(NUMBER, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def whole(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, rows: int = ROWS) -> DataFrame:
    """run(table, starts) over whole sequences, many at a time; starts: where each begins. A sequence has to fit a task."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(table.column(NUMBER).to_numpy() == 1)
            yield from run(table.drop_columns([NUMBER]), starts).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(table.column(NUMBER).to_numpy() == 1)
            last = int(starts[-1]) if len(starts) else 0
            if last:
                yield from done(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
                n = sum(x.num_rows for x in held)
        if n:
            yield from done(pa.Table.from_batches(held))

    return numbered(df, keys, *order).mapInArrow(mapped, schema)


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], fresh: Callable[[], Any], step: Callable[[Any, dict], list[tuple]], finish: Callable[[Any, dict], list[tuple]], schema: str, names: Sequence[str]) -> DataFrame:
    """A state for each key that steps row by row; holds one batch and one state, whatever a sequence's length.

    step(state, row) and finish(state, last row) give rows of the result, finish after a sequence's last row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row[NUMBER] == 1:
                    if last is not None:
                        out += finish(state, last)
                    state = fresh()
                out += step(state, row)
                last = row
            if out:
                yield _batch(out)
        if last is not None and (out := finish(state, last)):
            yield _batch(out)

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], list(names))

    return numbered(df, keys, *order).mapInArrow(mapped, schema)
