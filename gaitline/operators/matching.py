"""One-to-one matching: overlap joins, optimal assignment and greedy nearest neighbours, frame by frame.

Pairs are made by equi joins on the frame with the overlap or distance as a residual condition. Frames are solved by the Arrow
batch, each first cut into parts that share nobody; what a part of one or two people is forced to be needs no solver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaitline.functions import geometry as G

from .ordered import whole


def optimal(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of least total cost, as many as the shorter side has. Of equal optima, early rows get early columns.

    Shortest augmenting paths with potentials; finite costs only.
    """
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((r, c) for c, r in optimal(cost.T))
    # ties: a nudge below any real difference
    scale = max(1.0, float(np.abs(cost).max())) * 1e-11 / (n * m)
    cost = cost + scale * np.outer(np.arange(n, 0, -1), np.arange(m))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for r in range(1, n + 1):
        owner[0], at = r, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            row = owner[at]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], at
            open_ = np.where(done[1:], np.inf, least[1:])
            nxt = int(open_.argmin()) + 1
            delta = open_[nxt - 1]
            u[owner[done]] += delta
            v[done] -= delta
            least[1:][~done[1:]] -= delta
            at = nxt
            if owner[at] == 0:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def greedy(dist: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Rows by their own nearest column, each takes the nearest free column under the limit; ties: the earlier."""
    if not dist.size:
        return []
    free, out = np.ones(dist.shape[1], bool), []
    for r in np.argsort(dist.min(1), kind="stable").tolist():
        d = np.where(free, dist[r], np.inf)
        c = int(d.argmin())
        if d[c] < limit:
            out.append((r, c))
            free[c] = False
    return out


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """keys, a_id, b_id, iou: pairs of boxes (half open) of the same frame that overlap."""
    left = a.select(*keys, F.col("id").alias(a_id), F.col("box").alias("_a"))
    right = b.select(*keys, F.col("id").alias(b_id), F.col("box").alias("_b"))
    p, q = F.col("_a"), F.col("_b")
    touch = (p["x0"] < q["x1"]) & (q["x0"] < p["x1"]) & (p["y0"] < q["y1"]) & (q["y0"] < p["y1"])
    return left.join(right, list(keys)).filter(touch).select(*keys, a_id, b_id, G.box_iou(p, q).alias("iou")).filter("iou > 0")


def _parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Component of each pair (x, y), sides numbered from 0 and apart: the least pair number reached through common sides."""
    part = np.arange(len(x))
    while True:
        before = part
        for side in (x, y):
            least = np.full(int(side.max()) + 1, len(x))
            np.minimum.at(least, side, part)
            part = least[side]
        if (part == before).all():
            return part


def solve(group: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray, how: str = "optimal", limit: float = np.inf) -> np.ndarray:
    """Which pairs (group, a, b) are matched, many groups at once; a and b of any sortable type.

    Groups fall into parts that share no side. A part of one pair, or with one row or column, is settled outright, one of two by two
    by comparing its two ways; only larger parts, one after another, go to the solver.
    """
    if not len(score):
        return np.zeros(0, bool)
    sides = []
    for v in (a, b):
        _, n = np.unique(v, return_inverse=True)
        sides.append(np.unique(group * (int(n.max()) + 1) + n, return_inverse=True)[1])
    x, y = sides
    part = _parts(x, y)
    better = -score if how == "optimal" else score
    # by part, then its rows and columns in order
    order = np.lexsort((y, x, part))
    first = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1])))
    size = np.diff(np.append(first, len(order)))
    fits = score > 0 if how == "optimal" else score < limit
    out = np.zeros(len(score), bool)
    one = order[first[size == 1]]
    out[one] = fits[one]
    for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
        rows = order[at : at + n]
        p, q = x[rows], y[rows]
        if p[0] == p[-1] or (q == q[0]).all():
            k = rows[int(better[rows].argmin())]
            out[k] = fits[k]
            continue
        u, i = np.unique(p, return_inverse=True)
        v, j = np.unique(q, return_inverse=True)
        if how == "optimal" and len(u) == 2 and len(v) == 2:
            m = np.zeros((2, 2))
            m[i, j] = score[rows]
            out[rows] = ((i == j) == (m[0, 0] + m[1, 1] >= m[0, 1] + m[1, 0] - 1e-11)) & fits[rows]
            continue
        m = np.full((len(u), len(v)), np.inf if how == "greedy" else 0.0)
        m[i, j] = score[rows]
        picked = np.zeros(m.shape, bool)
        for r, c in greedy(m, limit) if how == "greedy" else optimal(-m):
            picked[r, c] = True
        out[rows] = picked[i, j] & fits[rows]
    return out


def _sorted_keys(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy()
    return np.unique(np.array(column.to_pylist(), object), return_inverse=True)[1]


def assign(pairs: DataFrame, keys: Sequence[str], a: str, b: str, score: str, how: str = "optimal", limit: float = np.inf) -> DataFrame:
    """keys, a, b, score: the one-to-one matches of each group. optimal: of largest total score; pairs not given score 0 and
    are never matched. greedy: score is a distance, see greedy().

    Groups come sorted, many to an Arrow batch, and are solved together; a window numbers a group's pairs, so what was dealt
    by the keys to be joined is not dealt again. A group has to fit a task: its pairs, not its rows.
    """
    names = [*keys, a, b]
    rows = pairs.filter(F.col(score).isNotNull()).select(*names, F.col(score).cast("double").alias(score))
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{score}` double"

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        group = np.zeros(table.num_rows, np.int64)
        group[starts] = 1
        found = solve(np.cumsum(group), _sorted_keys(table.column(a)), _sorted_keys(table.column(b)), table.column(score).to_numpy(), how, limit)
        return table.filter(pa.array(found))

    return whole(rows, keys, [a, b], run, schema)


def near(points: DataFrame, targets: DataFrame, keys: Sequence[str], point_id: str, target_id: str, limit: float) -> DataFrame:
    """keys, point_id, target_id, distance: each point's greedy nearest target of its frame, under the limit.

    Points go by the distance of their nearest target; those without a target under the limit match nothing, so they
    and what lies beyond the limit are left out before.
    """
    left = points.select(*keys, point_id, F.col("at").alias("_p"))
    right = targets.select(*keys, target_id, F.col("at").alias("_t")).filter("_t.x is not null and _t.y is not null")
    both = left.join(right, list(keys)).select(*keys, point_id, target_id, G.distance(F.col("_p"), F.col("_t")).alias("distance"))
    return assign(both.filter(F.col("distance") < limit), keys, point_id, target_id, "distance", "greedy", limit)


def top_confident(df: DataFrame, keys: Sequence[str], conf: str, tie: str, most: int | None, place: str | None = None) -> DataFrame:
    """The `most` rows of each group with the largest confidence, ties by `tie`; all rows without a limit.

    place: a column for each row's place in its group from 1: by `tie`, as the rows were, in groups within the limit and without
    one; by confidence in those that it cuts.
    """
    one = W.partitionBy(*keys)
    plain = F.row_number().over(one.orderBy(tie))
    if most is None:
        return df.withColumn(place, plain) if place else df
    rank = F.row_number().over(one.orderBy(F.desc(conf), tie))
    if place is None:
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    within = F.count(F.lit(1)).over(one) <= most
    return df.withColumn("_rank", rank).withColumn(place, F.when(within, plain).otherwise(rank)).filter(F.col("_rank") <= most).drop("_rank")


def outcome(cost: Column, accept: float, reject: float, flag_uncertain: bool = True) -> Column:
    """matched, uncertain or new by the assigned pair's cost; no pair is new."""
    gray = F.lit("uncertain" if flag_uncertain else "new")
    return F.when(cost.isNull() | (cost > reject), F.lit("new")).when(cost <= accept, F.lit("matched")).otherwise(gray)
