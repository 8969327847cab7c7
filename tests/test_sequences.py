"""Queries that follow a sequence, against plain walks over the rows."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from gaitline.operators import chunks
from gaitline.plans import identity as plan
from gaitline.plans.registry import QUERIES
from gaitline.sources import adapters as A


def iou(a, b, border=0):
    side = lambda lo, hi: max(0.0, hi - lo + border)
    inter = side(max(a[0], b[0]), min(a[2], b[2])) * side(max(a[1], b[1]), min(a[3], b[3]))
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - inter
    return inter / union if union > 0 else 0.0


def best(pairs):
    """Matches of largest total score of {(row, column): score}, part by part, by trying all ways."""
    left, out = dict(pairs), set()
    while left:
        part, grown = {next(iter(left))}, True
        while grown:
            more = {p for p in left if any(p[0] == q[0] or p[1] == q[1] for q in part)}
            grown, part = more != part, more
        rows, cols = sorted({p[0] for p in part}), sorted({p[1] for p in part})
        assert max(len(rows), len(cols)) <= 8
        if len(rows) > len(cols):
            ways = (tuple(zip(w, cols)) for w in permutations(rows, len(cols)))
        else:
            ways = (tuple(zip(rows, w)) for w in permutations(cols, len(rows)))
        won = max(ways, key=lambda w: sum(left.get(p, 0.0) for p in w))
        out |= {p for p in won if p in part}
        left = {p: s for p, s in left.items() if p not in part}
    return out


def boxes(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["session"], r["frame"]), {})[r["id"]] = tuple(r["box"])
    return out


def test_reconciled_ids(spark, sf_small):
    oracle, base = map(boxes, A.two_runs(spark, sf_small))
    want, last = set(), max(f for _, f in oracle)
    for session in {s for s, _ in oracle}:
        for k in range(1, last // plan.CHUNK + 1):
            at = k * plan.CHUNK
            prev = [(f, i, b) for f in range(at - 5, at) for i, b in oracle.get((session, f), {}).items()]
            curr = [(f, i, b) for f in (at, at + 1) for i, b in base.get((session, f), {}).items()]
            speed = {}
            for i in {p[1] for p in prev}:
                mids = sorted((f, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for f, j, b in prev if j == i)
                steps = [((v[1] - u[1]) / (v[0] - u[0]), (v[2] - u[2]) / (v[0] - u[0])) for u, v in zip(mids, mids[1:])]
                if steps:
                    speed[i] = np.median([s[0] for s in steps]), np.median([s[1] for s in steps])
            score = {}
            for fa, i, a in prev:
                for fb, j, b in curr:
                    s = iou(a, b, 1)
                    if i in speed:
                        dx, dy = (v * (fb - fa) for v in speed[i])
                        s = max(s, iou((a[0] + dx, a[1] + dy, a[2] + dx, a[3] + dy), b, 1))
                    if s > 0:
                        score[i, j] = max(score.get((i, j), 0.0), s)
            want |= {(session, k, i, j, round(score[i, j], 9)) for i, j in best(score) if score[i, j] >= 0.3}
    got = QUERIES["jn10_reconcile"](spark, sf_small).collect()
    assert {(r["session"], r["boundary"], r["prev_id"], r["curr_id"], round(r["best_iou"], 9)) for r in got} == want and len(got) == len(want) > 20


def carried(local, lost_after=None, vec=None):
    """(session, chunk, local id) -> global id; lost_after: chunks after which a lost id is forgotten."""
    out = {}
    for session in {k[0] for k in local}:
        known, nxt, gone, held = {}, 0, {}, {}
        for c in sorted({k[1] for k in local if k[0] == session}):
            here = local[session, c]
            before = local.get((session, c - 1), {})
            score = {}
            for i, rows in before.items():
                for j, mine in here.items():
                    both = [iou(rows[f + plan._STRIDE], mine[f]) for f in mine if f < plan._OVER and f + plan._STRIDE in rows]
                    if both and i in known:
                        score[known[i], j] = float(np.mean(both))
            now = {j: g for g, j in best({p: s for p, s in score.items() if s > 0}) if score[g, j] >= 0.3}
            for j in sorted(here, key=lambda x: (min(here[x]), x)):
                if j in now:
                    continue
                like = [] if lost_after is None else [(float(np.clip((held[g] @ vec[session, c, j] + 1) / 2, 0, 1)), at, g) for g, at in gone.items()]
                like = [x for x in like if x[0] >= 0.8]
                if like:
                    now[j] = max(like)[2]
                    del gone[now[j]]
                else:
                    now[j], nxt = nxt, nxt + 1
            if lost_after is not None:
                for j, g in now.items():
                    mixed = vec[session, c, j] if g not in held else 0.9 * held[g] + 0.1 * vec[session, c, j]
                    held[g] = mixed / np.linalg.norm(mixed)
                    gone.pop(g, None)
                gone |= {g: c for g in set(known.values()) - set(now.values())}
                for g in [g for g, at in gone.items() if c - at > lost_after]:
                    del gone[g], held[g]
            out |= {(session, c, j): g for j, g in now.items()}
            known = now
    return out


def by_chunk(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["session"], r["chunk_index"]), {}).setdefault(r["local_id"], {})[r["local_frame"]] = tuple(r["box"])
    return out


def test_carried_ids(spark, sf_small):
    want = carried(by_chunk(plan._local_chunks(spark, sf_small)))
    got = {(r["session"], r["chunk_index"], r["local_id"]): r["global_id"] for r in QUERIES["jn11_carried_ids"](spark, sf_small).collect()}
    assert got == want and len({k[1] for k in got}) > 3


def test_ids_known_again_by_a_gallery(spark, sf_small):
    local = plan._local_chunks(spark, sf_small).filter("(id + chunk_index) % 4 <> 2")
    vec = {}
    for r in local.select("session", "chunk_index", "local_id", "id").distinct().collect():
        v = np.array([(k == r["id"]) + ((r["chunk_index"] + k) % 3) * 0.05 for k in range(20)])
        vec[r["session"], r["chunk_index"], r["local_id"]] = v / np.linalg.norm(v)
    want = carried(by_chunk(local), 3, vec)
    got = {(r["session"], r["chunk_index"], r["local_id"]): r["global_id"] for r in QUERIES["str13_gallery_ids"](spark, sf_small).collect()}
    assert got == want
    # without it people who were away get new numbers
    seen = local.groupBy("session", "chunk_index", "local_id").agg(F.min("local_frame").alias("first_seen")).withColumn("pos", F.col("local_id"))
    plain = chunks.carry_ids(chunks.overlap_scores(local, plan._OVER, plan._STRIDE), seen, 0.3)
    assert plain.agg(F.max("global_id")).first()[0] > max(got.values())


def test_embedding_average(spark, sf_small):
    got = {}
    for r in QUERIES["wn17_embedding_ema"](spark, sf_small).collect():
        got.setdefault(r["label"], {})[r["k"]] = r["x"]
    want = {}
    for r in sorted(A.appearance(spark, sf_small).collect(), key=lambda r: r["vec_id"]):
        v = np.array(r["vec"])
        old = want.get(r["label"])
        mixed = v if old is None else 0.9 * old + 0.1 * v
        want[r["label"]] = mixed if old is None else mixed / np.linalg.norm(mixed)
    assert set(got) == set(want)
    for label, v in want.items():
        assert np.abs(np.array([got[label][k] for k in range(len(v))]) - v).max() < 1e-6


def test_chunks_by_pixels(spark):
    from gaitline.operators import masks

    rows = [(0, c, f, i, (x, 0, x + 4, 4)) for c in range(2) for f in range(20) for i, x in ((1, 0 if c == 0 else 2), (2, 10))]
    df = spark.createDataFrame(rows, "session long, chunk_index long, local_frame long, local_id long, box struct<x0:int,y0:int,x1:int,y1:int>")
    df = df.withColumn("rle", masks.from_box(F.col("box"), F.lit(30)))
    key = lambda d: sorted((r["prev_id"], r["curr_id"], round(r["mean_iou"], 9), r["shared"]) for r in d.collect())
    assert key(chunks.overlap_scores(df, 5, 15, pixels=True)) == key(chunks.overlap_scores(df, 5, 15)) and key(chunks.overlap_scores(df, 5, 15))[0] == (1, 1, 0.333333333, 5)
