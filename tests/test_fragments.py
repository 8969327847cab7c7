"""Merging of fragments against a plain version: both passes, groups, pooled signatures."""

import numpy as np

from gaitline.operators import fragments
from gaitline.plans.appearance import _fragment_tables
from gaitline.plans.registry import QUERIES


def cheapest(cost):
    """(row, column) pairs of least total cost, as many as the shorter side has: shortest paths in the residual graph."""
    n, m = cost.shape
    match = {}
    for _ in range(min(n, m)):
        owner = {c: r for r, c in match.items()}
        dist = {("r", r): 0.0 for r in range(n) if r not in match}
        came = {}
        for _ in range(n + m + 1):
            changed = False
            for (side, k), d in list(dist.items()):
                steps = [(("c", c), cost[k, c]) for c in range(m) if match.get(k) != c] if side == "r" else [(("r", owner[k]), -cost[owner[k], k])] if k in owner else []
                for node, w in steps:
                    if d + w < dist.get(node, np.inf) - 1e-12:
                        dist[node], came[node], changed = d + w, (side, k), True
            if not changed:
                break
        node = min((x for x in dist if x[0] == "c" and x[1] not in owner), key=lambda x: dist[x])
        while node in came:
            before = came[node]
            if node[0] == "c":
                match[before[1]] = node[1]
            node = before
    return set(match.items())


def unit(v):
    return v / np.linalg.norm(v)


def likeness(a, b):
    return 0.0 if a is None or b is None else float(np.clip((a @ b + 1) / 2, 0, 1))


def roots(ids, edges):
    group = {i: {i} for i in ids}
    for a, b in edges:
        both = group[a] | group[b]
        for i in both:
            group[i] = both
    return {i: min(g) for i, g in group.items()}


def merged(ids, vectors, usable):
    """ids: id -> frames; (pairs, group pairs, canonical ids)."""
    real = {i: (min(f), max(f)) for i, f in ids.items() if len(f) >= 8}
    late = sorted(i for i in real if real[i][0] > 0)
    good = {i: sorted(f for f in ids[i] if usable(f)) for i in real}
    start, end = ({i: unit(np.mean([vectors[f] for f in side(g)], 0)) if g else None for i, g in good.items()} for side in (lambda g: g[:5], lambda g: g[-5:]))
    rows = sorted(real)
    cost = np.full((len(rows), len(late)), 10.0)
    for r, i in enumerate(rows):
        for c, j in enumerate(late):
            if i != j and real[i][1] < real[j][0]:
                cost[r, c] = 1 - likeness(end[i], start[j])
    pairs = {(rows[r], late[c], 1 - cost[r, c]) for r, c in cheapest(cost) if cost[r, c] < 10}
    edges = [(i, j) for i, j, s in pairs if s >= 0.6]
    group = roots(ids, edges)
    orphans = sorted(set(late) - {j for _, j in edges})

    pooled = {}
    for i, (first, last) in real.items():
        span = last - first + 1
        targets = range(first, last + 1) if span <= 5 else sorted({int(np.rint(first + k * (span - 1) / 4)) for k in range(5)})
        reach, taken = min(max(1, max(1, span // 5) // 2), 200), set()
        for t in targets:
            near = sorted((abs(f - t), f < t, f) for f in good[i] if abs(f - t) <= reach and f not in taken)
            if near:
                taken.add(near[0][2])
        pooled.setdefault(group[i], []).extend(vectors[f] for f in sorted(taken))
    names = sorted(set(group.values()))
    cost = np.full((len(orphans), len(names)), 10.0)
    for r, o in enumerate(orphans):
        for c, g in enumerate(names):
            members = [i for i in real if group[i] == g]
            clash = any(i == o or (real[i][0] <= real[o][1] and real[i][1] >= real[o][0]) for i in members)
            if members and not clash and any(real[i][1] < real[o][0] for i in members):
                cost[r, c] = 1 - likeness(unit(np.mean(pooled[g], 0)) if pooled.get(g) else None, start[o])
    second = {(orphans[r], names[c], 1 - cost[r, c]) for r, c in cheapest(cost) if cost[r, c] < 10} if orphans else set()
    return pairs, second, roots(ids, edges + [(g, o) for o, g, s in second if s >= 0.6])


def rounded(rows):
    return {(a, b, round(s, 9)) for a, b, s in rows}


def test_merged_fragments(spark, sf_small):
    masks, signals = _fragment_tables(spark, sf_small)
    vectors = {r["frame"]: np.array(r["vec"]) for r in signals.collect()}
    runs = {}
    for r in masks.collect():
        runs.setdefault(r["run"], {}).setdefault(r["id"], []).append(r["frame"])
    got = QUERIES["str15_fragment_pairs"](spark, sf_small).collect()
    canonical = {(r["run"], r["id"]): r["canonical"] for r in QUERIES["str15_merge_fragments"](spark, sf_small).collect()}
    assert len(runs) == 2 and any(r["pass"] == 2 for r in got)
    for run, ids in runs.items():
        first, second, roots_ = merged(ids, vectors, lambda f: f % 7 != 0)
        of = lambda k: rounded((r["from_id"], r["into_id"], r["similarity"]) for r in got if r["run"] == run and r["pass"] == k)  # noqa: E731, B023
        assert of(1) == rounded(first) and of(2) == rounded((g, o, s) for o, g, s in second)
        assert {i: canonical[run, i] for i in ids} == roots_
        assert all(r["accepted"] == (r["similarity"] >= fragments.THRESHOLD) for r in got)
