"""Overlap of polygons on the pixel grid, edges included, for shapes that no closed form covers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def spans(xs: np.ndarray, ys: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """row -> [(first, last)] pixels that lie in a polygon of whole-number corners or on its edge (even-odd rule)."""
    out: dict[int, list[tuple[int, int]]] = {}
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    for y in range(int(ys.min()), int(ys.max()) + 1):
        # edges are half open upward, so a corner counts once; edges that touch the row are added as they lie
        cross = (ys <= y) != (y2 <= y)
        at = np.sort(xs[cross] + (y - ys[cross]) * (x2[cross] - xs[cross]) / (y2[cross] - ys[cross]))
        found = [(int(np.ceil(a - 1e-9)), int(np.floor(b + 1e-9))) for a, b in zip(at[::2], at[1::2])]
        flat = (ys == y) & (y2 == y)
        found += [(int(min(a, b)), int(max(a, b))) for a, b in zip(xs[flat], x2[flat])]
        found += [(int(a), int(a)) for a in xs[ys == y]]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(s for s in found if s[0] <= s[1]):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = merged[-1][0], max(merged[-1][1], b)
            else:
                merged.append((a, b))
        out[y] = merged
    return out


def overlap(a: list[dict], b: list[dict]) -> float:
    """Intersection over union of two polygons of points x, y, truncated to whole numbers; 0 under 3 points."""
    if a is None or b is None or len(a) < 3 or len(b) < 3:
        return 0.0
    p, q = (spans(np.array([int(v["x"]) for v in s]), np.array([int(v["y"]) for v in s])) for s in (a, b))
    count = lambda s: sum(e - f + 1 for row in s.values() for f, e in row)
    both = sum(max(0, min(e, k) - max(f, g) + 1) for y in p.keys() & q.keys() for f, e in p[y] for g, k in q[y])
    union = count(p) + count(q) - both
    return both / union if union else 0.0


def _shapes(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(x0, y0, x1, y1 of each polygon's truncated corners, NaN where overlap() has to look; which are upright rectangles)."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    points = column.flatten()
    x, y = (np.trunc(points.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in ("x", "y"))
    bounds = np.full((4, len(size)), np.nan)
    held = np.flatnonzero(size >= 3)
    first = (np.cumsum(size) - size)[held]
    if len(held):
        # a shorter polygon's points would join the one before it
        kept = np.repeat(size >= 3, size)
        x3, y3, at = x[kept], y[kept], np.cumsum(size[held]) - size[held]
        bounds[:, held] = np.minimum.reduceat(x3, at), np.minimum.reduceat(y3, at), np.maximum.reduceat(x3, at), np.maximum.reduceat(y3, at)
    upright = np.zeros(len(size), bool)
    four = size[held] == 4
    if four.any():
        at = first[four][:, None] + np.arange(4)
        px, py, (x0, y0, x1, y1) = x[at], y[at], bounds[:, held[four], None]
        corners = ((px == x0) | (px == x1)).all(1) & ((py == y0) | (py == y1)).all(1)
        twice = np.abs((px * np.roll(py, -1, 1) - np.roll(px, -1, 1) * py).sum(1))
        whole = (2 * (x1 - x0) * (y1 - y0))[:, 0]
        upright[held[four]] = corners & (twice == whole) & (whole > 0)
    return bounds, upright


def overlaps(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """overlap() of each pair: 0 where the bounds are apart, in closed form for upright rectangles, by spans for the others."""
    (p, p_upright), (q, q_upright) = _shapes(a), _shapes(b)
    side = lambda s: (s[2] - s[0] + 1, s[3] - s[1] + 1)
    w, h = side((*np.maximum(p[:2], q[:2]), *np.minimum(p[2:], q[2:])))
    apart = (w <= 0) | (h <= 0)
    both, area = np.where(apart, 0.0, w * h), np.prod(side(p), 0) + np.prod(side(q), 0)
    closed = p_upright & q_upright
    out = np.divide(both, area - both, out=np.zeros(len(both)), where=closed & ~apart)
    rest = pa.array(np.flatnonzero(~closed & ~apart))
    out[rest.to_numpy()] = [overlap(x, y) for x, y in zip(a.take(rest).to_pylist(), b.take(rest).to_pylist())]
    return out


def polygon_overlaps(pairs: DataFrame, a: str, b: str, out: str = "iou") -> DataFrame:
    """pairs with the overlap of two polygon columns appended; pair them by frame and boxes first."""
    from pyspark.sql import types as T

    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.DoubleType())])
    i, j = pairs.columns.index(a), pairs.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = overlaps(batch.column(i), batch.column(j))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, out])

    return pairs.mapInArrow(run, schema)
