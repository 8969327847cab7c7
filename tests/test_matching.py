"""Assignment, correspondence, chunks, fragments: scenarios with known answers."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaitline.operators import chunks, fragments, identity, matching
from gaitline.operators.ingest import SessionOptions


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_optimal_is_least(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    found = matching.optimal(cost)
    k = min(n, m)
    assert len(found) == k and len({r for r, _ in found}) == k and len({c for _, c in found}) == k
    rows, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
    c = cost if n <= m else cost.T
    least = min(sum(c[r, p[r]] for r in rows) for p in itertools.permutations(cols, k))
    assert sum(cost[r, q] for r, q in found) == least


def test_greedy_takes_the_surest_first():
    d = np.array([[5.0, 1.0], [0.5, 9.0], [0.6, 50.0]])
    assert sorted(matching.greedy(d, 80.0)) == [(1, 0), (2, 1)]  # the last row was nearer to its first choice than the first row
    assert matching.greedy(np.array([[80.0]]), 80.0) == []  # the limit is strict


BOX = "struct<y0:int,y1:int,x0:int,x1:int>"


def run_of(spark, ids):
    """ids[frame] -> [(id, x)] as 8 by 8 boxes."""
    rows = [(0, f, i, (0, 8, x, x + 8)) for f, people in enumerate(ids) for i, x in people]
    return spark.createDataFrame(rows, f"session long, frame long, id long, box {BOX}")


def metrics(spark, oracle, baseline, n, chunk):
    corr = identity.correspondence(run_of(spark, oracle), run_of(spark, baseline))
    totals = spark.createDataFrame([(0, n)], "session long, n long")
    return identity.report(corr, totals, chunk).first(), corr


def test_identical_runs(spark):
    run = [[(0, 0)]] * 10
    r, _ = metrics(spark, run, run, 10, 5)
    assert (r["fragmentation_count"], r["swap_count"], r["correct_boundary_matches"], r["total_boundaries_checked"], r["boundary_accuracy"]) == (0, 0, 1, 1, 1.0)


def test_fragmentation_at_a_boundary(spark):
    r, corr = metrics(spark, [[(0, 0)]] * 10, [[(0 if f < 5 else 5, 0)] for f in range(10)], 10, 5)
    assert (r["fragmentation_count"], r["cross_chunk_fragmentation_count"], r["boundary_accuracy"]) == (1, 1, 0.0)
    e = identity.switch_events(corr, "oracle_id", "baseline_id", 5).first()
    assert (e["from_id"], e["to_id"], e["last_seen_frame"], e["new_seen_frame"]) == (0, 5, 4, 5)


def test_fragmentation_inside_a_chunk(spark):
    r, _ = metrics(spark, [[(0, 0)]] * 10, [[(0 if f < 5 else 7, 0)] for f in range(10)], 10, 20)
    assert (r["fragmentation_count"], r["intra_chunk_fragmentation_count"], r["total_boundaries_checked"], r["boundary_accuracy"]) == (1, 1, 0, None)


def test_two_people_share_an_id(spark):
    oracle = [[(0, 0)] if f < 5 else [(1, 30)] for f in range(10)]
    r, _ = metrics(spark, oracle, [[(0, 0 if f < 5 else 30)] for f in range(10)], 10, 5)
    assert (r["fragmentation_count"], r["swap_count"], r["cross_chunk_swap_count"]) == (0, 1, 1)


def test_unmatched_oracle_rows_stay(spark):
    _, corr = metrics(spark, [[(0, 0), (1, 100)]], [[(9, 1)]], 1, 5)
    assert {r["oracle_id"]: r["baseline_id"] for r in corr.collect()} == {0: 9, 1: None}


def test_crowd_needs_the_solver(spark):
    # greedy by overlap would take 1-1 first and leave 0 without a partner
    _, corr = metrics(spark, [[(0, 4), (1, 0)]], [[(7, 1), (8, -3)]], 1, 5)
    assert {r["oracle_id"]: r["baseline_id"] for r in corr.collect()} == {0: 7, 1: 8}


def test_chunk_ranges(spark):
    got = chunks.ranges(spark.createDataFrame([(0, 1000), (1, 0), (2, 20)], "session long, n long"), 300, 50).orderBy("session", "start").collect()
    assert [(r["session"], r["start"], r["end"]) for r in got] == [(0, 0, 300), (0, 250, 550), (0, 500, 800), (0, 750, 1000), (2, 0, 20)]
    with pytest.raises(ValueError):
        chunks.ranges(spark.createDataFrame([(0, 10)], "session long, n long"), 50, 50)


def test_memberships(spark):
    df = spark.createDataFrame([(0, f) for f in range(23)], "session long, frame long")
    mem = chunks.memberships(df, spark.createDataFrame([(0, 23)], "session long, n long"), 10, 3)
    by = {r["chunk_index"]: (r["lo"], r["hi"]) for r in mem.groupBy("chunk_index").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).collect()}
    assert by == {0: (0, 9), 1: (7, 16), 2: (14, 22)}
    assert chunks.fresh(mem, 3).count() == 23


def _carried(spark, scores, seen, **more):
    s = spark.createDataFrame(scores, "session long, chunk_index long, prev_id long, curr_id long, mean_iou double, shared long")
    x = spark.createDataFrame(seen, "session long, chunk_index long, local_id long, first_seen long, pos long")
    return {(r["chunk_index"], r["local_id"]): r["global_id"] for r in chunks.carry_ids(s, x, 0.3, **more).collect()}


def test_carried_ids(spark):
    seen = [(0, 0, 5, 0, 0), (0, 0, 2, 0, 1), (0, 0, 9, 1, 0), (0, 1, 7, 0, 0), (0, 1, 55, 4, 0)]
    got = _carried(spark, [(0, 1, 5, 7, 0.8, 3), (0, 1, 2, 55, 0.2, 1)], seen)
    assert got == {(0, 5): 0, (0, 2): 1, (0, 9): 2, (1, 7): 0, (1, 55): 3}
    capped = _carried(spark, [(0, 1, 5, 7, 0.8, 3)], seen, max_ids=2)
    assert capped == {(0, 5): 0, (0, 2): 1, (1, 7): 0}


def test_velocity_brings_a_walker_back(spark):
    box = lambda x: (x, x + 40, x, x + 40)
    prev = spark.createDataFrame([(0, f, 1, box(20 * f)) for f in range(2)], f"session long, frame long, id long, box {BOX}")
    curr = spark.createDataFrame([(0, 3, 9, box(60))], f"session long, frame long, id long, box {BOX}")
    speed = chunks.velocities(prev, ["session", "id"], F.col("box.x0").cast("double"), F.col("box.y0").cast("double"))
    assert speed.first()["vx"] == 20.0
    assert chunks.anchor_scores(prev, curr, ["session"], speed).first()["best_iou"] == 1.0
    assert chunks.anchor_scores(prev, curr, ["session"]).count() == 0 or chunks.anchor_scores(prev, curr, ["session"]).first()["best_iou"] < 0.3


def _fragments(spark, spells, vec):
    """spells: id -> (first, last); vec: id -> vector."""
    rows = [("r", i, f, True, vec[i], None, (0, 8, 0, 8)) for i, (a, b) in spells.items() for f in range(a, b + 1)]
    df = spark.createDataFrame(rows, f"run string, id long, frame long, usable boolean, vec array<double>, hue array<double>, box {BOX}")
    return fragments.merge(df.select("run", "id", "frame", "box"), df.drop("box"))


def test_fragments_merge_in_order_of_time(spark):
    out = _fragments(spark, {1: (0, 19), 2: (30, 49), 3: (5, 18), 4: (60, 64)}, {1: [1.0, 0.0], 2: [0.99, 0.14], 3: [0.0, 1.0], 4: [1.0, 0.0]})
    assert {r["id"]: r["canonical"] for r in out["canonical"].collect()} == {1: 1, 2: 1, 3: 3, 4: 4}  # 4 is too short to merge, but stays
    assert [(r["from_id"], r["into_id"], r["accepted"]) for r in out["pairs"].collect() if r["accepted"]] == [(1, 2, True)]


def test_group_with_a_member_at_the_same_time_is_refused(spark):
    # 3 is like the group of 1 and 2, but 2 is there at the same time
    out = _fragments(spark, {1: (0, 9), 2: (20, 60), 3: (30, 50)}, {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [1.0, 0.0]})
    assert {r["id"]: r["canonical"] for r in out["canonical"].collect()}[3] in (1, 3)
    assert not any(r["accepted"] and r["orphan_id"] == 3 for r in out["group_pairs"].collect())


def test_evenly_spaced(spark):
    df = spark.createDataFrame([(0, 10), (3, 5)], "a long, b long")
    assert [r[0] for r in df.select(fragments.evenly_spaced(F.col("a"), F.col("b"), 5)).collect()] == [[0, 2, 5, 8, 10], [3, 4, 5]]


def test_lifespans_use_the_upper_median(spark):
    df = spark.createDataFrame([(0, t, f) for t, n in enumerate((2, 4, 20, 30)) for f in range(n)], "g long, track_id long, frame long")
    r = identity.lifespans(identity.churn(df, ["g"]), ["g"]).first()
    assert (r["tracks"], r["shortest"], r["upper_median"], r["longest"], r["short_tracks"], r["short_share"]) == (4, 2, 20, 30, 2, 0.5)


def test_options():
    assert SessionOptions(single=True, max_people=4).people() == 1
    for bad in ({"chunk_size": 10, "overlap": 10}, {"chunk_size": 0}, {"overlap": -1}, {"max_people": 0}, {"reidentify": True, "segmentation": True}):
        with pytest.raises(ValueError):
            SessionOptions(**bad)
    SessionOptions(reidentify=True)


def test_raster_overlap_counts_edges():
    from gaitline.operators.raster import overlap, spans

    square = lambda x, y, w: [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + w}, {"x": x, "y": y + w}]
    s = spans(np.array([0, 4, 4, 0]), np.array([0, 0, 4, 4]))
    assert {y: v for y, v in s.items()} == {y: [(0, 4)] for y in range(5)}
    assert overlap(square(0, 0, 40), square(0, 0, 40)) == 1.0 and overlap(square(0, 0, 4), square(10, 10, 4)) == 0.0
    assert overlap(square(0, 0, 40), square(10, 0, 40)) == pytest.approx(31 * 41 / (2 * 41 * 41 - 31 * 41))
    assert overlap(square(0, 0, 4)[:2], square(0, 0, 4)) == 0.0
    triangle = spans(np.array([0, 8, 4]), np.array([0, 0, 4]))
    assert [b - a + 1 for row in triangle.values() for a, b in row] == [9, 7, 5, 3, 1]
    notch = spans(np.array([0, 6, 6, 3, 0]), np.array([0, 0, 6, 2, 6]))  # not convex: two runs in a row
    assert len(notch[5]) == 2
