"""Re-identification scenarios, the gallery, and stream against batch."""

import numpy as np
import pytest

from gaitline.operators.reid import Gallery, PoseReid, Seen, Segment, SegmentReid, blend, decide
from gaitline.streaming import reid as R

A = np.array([0.5, 0.4, 0.35, 0.35, 0.3, 0.3, 0.45, 0.45, 0.42, 0.42, 0.06, 0.12])
B = np.array([0.35, 0.32, 0.28, 0.28, 0.25, 0.25, 0.38, 0.38, 0.35, 0.35, 0.06, 0.12])
C = np.array([0.6, 0.52, 0.42, 0.42, 0.38, 0.38, 0.5, 0.5, 0.48, 0.48, 0.06, 0.12])
FPS = 30.0


def play(machine, script, frames):
    """script(frame) -> people; (ids by frame, events)."""
    ids, events = [], []
    for f in range(frames):
        now, more = machine.step(script(f), f / FPS)
        ids.append(now)
        events += more
    return ids, events


def test_comes_back_with_a_stranger():
    def script(f):
        if f < 60:
            return [Seen(1, A), Seen(2, B)]
        return [Seen(2, B)] if f < 160 else [Seen(2, B), Seen(3, A * 1.01), Seen(4, C)]

    ids, events = play(PoseReid(), script, 220)
    assert ids[-1] == {2: 2, 3: 1, 4: 4}
    assert [(e["raw_id"], e["person_id"], e["forced"]) for e in events if e["kind"] == "merge"] == [(3, 1, False)]
    assert ids[162][3] == 3  # rows given out before the merge keep the provisional id


def test_no_signal_forces_no_match():
    ids, events = play(PoseReid(), lambda f: [Seen(1, A)] if f < 30 else [] if f < 60 else [Seen(2, A + 0.3)], 200)
    assert not [e for e in events if e["kind"] == "merge"] and ids[-1] == {2: 2}


def test_position_helps_only_nearby():
    hip = lambda x: np.array([x, 100.0])
    for x, merged in ((105.0, 1), (2000.0, 0)):
        script = lambda f, x=x: [Seen(1, A, hip=hip(100.0), torso=100.0)] if f < 30 else [] if f < 60 else [Seen(2, A + 0.16, hip=hip(x), torso=100.0)]
        _, events = play(PoseReid(), script, 120)
        assert len([e for e in events if e["kind"] == "merge"]) == merged


def test_embedding_right_and_wrong():
    for e, merged in (([1.0, 0.0], 1), ([-1.0, 0.0], 0)):
        v = np.array(e)
        _, events = play(PoseReid(), lambda f, v=v: [Seen(1, A, embedding=np.array([1.0, 0.0]))] if f < 30 else [] if f < 60 else [Seen(2, A + 0.25, embedding=v)], 140)
        assert len([x for x in events if x["kind"] == "merge"]) == merged


def test_cap_forces_exactly_one():
    def script(f):
        if f < 40:
            return [Seen(1, A), Seen(2, B)]
        return [Seen(2, B)] if f < 80 else [Seen(2, B), Seen(3, A + 0.4)]

    ids, events = play(PoseReid(max_people=2), script, 240)
    assert [(e["person_id"], e["forced"]) for e in events if e["kind"] == "merge"] == [(1, True)] and ids[-1][3] == 1


def test_lost_later_than_the_newcomer_came():
    # 2 comes while 1 is still there: it can't be 1
    ids, _ = play(PoseReid(), lambda f: [Seen(1, A), Seen(2, A)] if f < 10 else [Seen(2, A)], 60)
    assert ids[-1] == {2: 2}


def test_memory_ends():
    m = PoseReid(memory_s=1.0)
    _, events = play(m, lambda f: [Seen(1, A)] if f < 30 else [] if f < 90 else [Seen(2, A)], 140)
    assert not events


def segment(raw, x):
    return Segment(raw, np.array([x, 0.0]), 40.0)


def test_segments_never_exceed_the_cap():
    m = SegmentReid(2)
    seen = set()
    for f in range(60):
        seen |= set(m.step([segment(100 + f, 10.0), segment(500 + f, 300.0)], f / FPS)[0].values())
    assert len(seen) <= 2
    ids, _ = SegmentReid(2).step([segment(k, 100.0 * k) for k in range(3)], 0.0)
    assert len(set(ids.values())) == 2
    one = SegmentReid(1)
    assert {p for f in range(20) for p in one.step([segment(f, 50.0 * f)], f / FPS)[0].values()} == {1}


def test_segment_returns_nearby():
    m = SegmentReid(5, soft=0.3)
    m.step([segment(1, 0.0), segment(2, 400.0)], 0.0)
    m.step([segment(2, 400.0)], 0.1)
    assert m.step([segment(2, 400.0), segment(9, 5.0)], 0.2)[0] == {2: 2, 9: 1}


def test_segment_cap_is_checked():
    with pytest.raises(ValueError):
        SegmentReid(0)


def test_decide():
    cost = np.array([[0.05, np.inf], [np.inf, 0.15], [np.inf, np.inf]])
    assert [s for s, _, _ in decide(cost, 0.12, 0.2)] == ["matched", "uncertain", "new"]
    assert [s for s, _, _ in decide(cost, 0.12, 0.2, False)] == ["matched", "new", "new"]
    assert [s for s, _, _ in decide(np.zeros((2, 0)), 0.1, 0.2)] == ["new", "new"]


def test_gallery():
    g = Gallery()
    g.observe(1, np.array([1.0, 0.0]))
    g.observe(2, np.array([0.0, 1.0]))
    assert g.match(np.array([1.0, 0.0])) is None  # only lost ids match
    g.lose(1, 0)
    assert g.match(np.array([1.0, 0.0])) == 1 and g.match(np.array([0.0, 1.0])) is None
    g.forget(10)
    assert g.match(np.array([1.0, 0.0])) == 1
    g.forget(11)
    assert g.match(np.array([1.0, 0.0])) is None


def test_blend_settles():
    rng = np.random.default_rng(0)
    true = np.array([1.0, 0, 0, 0])
    v = None
    for _ in range(50):
        x = true + rng.normal(0, 0.3, 4)
        v = blend(v, x / np.linalg.norm(x))
    assert (v @ true + 1) / 2 > 0.95 and blend(None, None) is None


COLUMNS = "session string, frame long, t_s double, raw_id long, signature array<double>, color array<double>, embedding array<double>, hip_x double, hip_y double, torso double"


def _rows():
    out = []
    for s in ("x", "y"):
        for f in range(120):
            raw = 1 if f < 30 else None if f < 60 else 2
            out.append((s, f, f / FPS, raw, A.tolist() if raw else None, None, None, None, None, None))
    return out


def _fed(spark, df, path, parts, extra):
    """A stream of files: each part, then rows far later that move the watermark on."""
    for part in [*parts, None]:
        rows = extra if part is None else df.filter(part)
        rows.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _streamed(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def _key(rows):
    return sorted((r["session"], r["frame"], r["raw_id"], r["event"], r["person_id"] or 0, r["into_id"] or 0) for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    """A frame's rows come in two batches, and frames out of order within the delay."""
    rows = _rows() + [("x", f, f / FPS, 9, B.tolist(), None, None, None, None, None) for f in range(120)]
    df = spark.createDataFrame(rows, COLUMNS)
    end = spark.createDataFrame([("z", 0, 1e6, None, None, None, None, None, None, None)], COLUMNS)
    late = (df.frame % 7 == 3) | (df.raw_id == 9)
    parts = []
    for k in range(3):
        here = (df.frame >= k * 40) & (df.frame < (k + 1) * 40)
        parts += [here & ~late, here & late]
    out = _streamed(spark, R.resolve_stream(_fed(spark, df, str(tmp_path / "in"), parts, end), delay_s=5.0), "people", tmp_path)
    batch = R.resolve(df).collect()
    assert _key(out) == _key(batch) and sum(not r["event"] for r in batch) == 300 and any(r["kind"] == "merge" for r in batch)
    with pytest.raises(ValueError):
        R.resolve_stream(df, delay_s=0.0)


def test_segment_stream_equals_batch(spark, tmp_path):
    schema = "session string, frame long, t_s double, raw_id long, x double, y double, scale double, aspect double, fill double, hue array<double>, embedding array<double>"
    rows = [(s, f, f / FPS, 10 * (f // 9) + k, 100.0 * k + f % 5, 50.0, 40.0, 0.5, 0.8, None, None) for s in ("a", "b") for f in range(45) for k in range(4)]
    df = spark.createDataFrame(rows, schema)
    end = spark.createDataFrame([("z", 0, 1e6, None, None, None, 0.0, None, None, None, None)], schema)
    parts = [(df.frame < 20) & (df.raw_id % 2 == 0), (df.frame < 20) & (df.raw_id % 2 == 1), df.frame >= 20]
    out = _streamed(spark, R.resolve_segments_stream(_fed(spark, df, str(tmp_path / "in"), parts, end), 3, delay_s=10.0), "segments", tmp_path)
    got = sorted((r["session"], r["frame"], r["raw_id"], r["person_id"]) for r in out if not r["event"])
    assert got == sorted(map(tuple, R.resolve_segments(df, 3).collect())) and len(got) == 360 and max(r[3] for r in got) == 3


def test_idle_sessions_are_forgotten(spark, tmp_path):
    df = spark.createDataFrame([("x", f, t, 1, A.tolist(), None, None, None, None, None) for f, t in ((0, 0.0), (1, 1.0), (2, 900.0))], COLUMNS)
    end = lambda t: spark.createDataFrame([("z", int(t), t, None, None, None, None, None, None, None)], COLUMNS)
    path = str(tmp_path / "in")
    for rows in (df.filter("frame < 2"), end(700.0), df.filter("frame = 2"), end(2000.0)):
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = _streamed(spark, R.resolve_stream(stream, delay_s=5.0, idle_s=100.0), "idle", tmp_path)
    assert sorted((r["frame"], r["person_id"]) for r in out if r["session"] == "x") == [(0, 1), (1, 1), (2, 2)]
