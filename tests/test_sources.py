"""Trackers as sources, the replay cursor, options, and batch wiring of the state machines."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from gaitline.operators import motion
from gaitline.operators.ingest import SessionOptions
from gaitline.operators.reid import PoseReid, SegmentReid
from gaitline.operators.replay import Replay
from gaitline.plans.registry import QUERIES
from gaitline.sources import backend
from gaitline.streaming import reid as R

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import tests


class Made:
    """Frames by arithmetic, some without rows."""

    def __init__(self, n, twice=False):
        self.n, self.twice = n, twice

    def run(self, session):
        for f in range(self.n + len(session)):
            box = {"x1": float(f), "y1": 0.0, "x2": f + 5.0, "y2": 9.0}
            yield f - (self.twice and f == 3), f / 15, [{"track_id": t, "bbox": box, "poly": [], "conf": 0.5} for t in range(f % 3)]


def test_backend_as_a_table(spark):
    backend.register(spark, "made", Made(6))
    rows = backend.read(spark, "made", ["a", "bb"]).collect()
    assert sorted((r["session"], r["frame"], r["track_id"]) for r in rows) == [(s, f, t) for s in ("a", "bb") for f in range(6 + len(s)) for t in range(f % 3)]
    assert rows[0]["bbox"]["y2"] == 9.0
    for bad, match in ((lambda: backend.register(spark, "none", object()), "run"), (lambda: spark.read.format("made").load().collect(), "sessions")):
        with pytest.raises(Exception, match=match):
            bad()
    backend.register(spark, "twice", Made(6, True))
    with pytest.raises(Exception, match="do not rise"):
        backend.read(spark, "twice", ["a"]).collect()


def test_backend_as_a_stream(spark, tmp_path):
    backend.register(spark, "made", Made(20))
    stream = spark.readStream.format("made").option("sessions", "a,bb").option("frames", "7").load()
    q = stream.writeStream.format("memory").queryName("made_rows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r["session"], r["frame"], r["track_id"]) for r in rows)
    assert key(spark.table("made_rows").collect()) == key(backend.read(spark, "made", ["a", "bb"]).collect())


def test_replay(spark):
    df = spark.createDataFrame([(f, k) for f in (3, 4, 6, 9) for k in range(f % 3 + 1)], "frame long, k long")
    for ahead in (1, 3, 100):
        r = Replay(df, ahead)
        assert len(r) == 7 and r.current() is None and r.back() is None
        assert [len(r.forward()) for _ in range(7)] == [1, 2, 0, 1, 0, 0, 1] and r.exhausted() and r.forward() is None
        assert r.seek(1)[0]["frame"] == 4 and len(r.back()) == 1 and r.back() is None and r.cursor == 0 and r.seek(9) is None
        r.reset()
        assert r.current() is None and len(r.forward()) == 1
    assert len(Replay(df.limit(0))) == 0 and Replay(df.limit(0)).forward() is None


def test_options():
    assert SessionOptions(mode="both", backend="chunked", reidentify=True, max_people=3).people() == 3 and SessionOptions(reidentify=True).people() is None
    bad = [dict(mode="x"), dict(backend="y"), dict(backend="chunked"), dict(fps=0), dict(window_s=-1), dict(chunk_size=5, overlap=5), dict(redetect_every=0), dict(max_people=0), dict(target=-1), dict(mode="segmentation", reidentify=True)]
    for options in bad:
        with pytest.raises(ValueError):
            SessionOptions(**options)


def test_proximity_of_unequal_tracks(spark):
    kp = [{"x": 1.0, "y": 2.0, "conf": 1.0}] * 17
    rows = lambda n: spark.createDataFrame([(0, f, kp) for f in range(n)], "session long, frame long, kp array<struct<x:double,y:double,conf:double>>")
    assert motion.proximity(rows(3), rows(3), equal=True).count() == 3 and motion.proximity(rows(3), rows(2)).count() == 2
    with pytest.raises(Exception, match="unequal length"):
        motion.proximity(rows(3), rows(2), equal=True).collect()


@pytest.mark.parametrize("name", ["str03_reidentify", "str08_reidentify_segments"])
def test_sessions_are_stepped_frame_by_frame(spark, sf_small, name, monkeypatch):
    """The registered queries against the machine itself, fed from the collected rows."""
    from gaitline.plans import appearance, more

    fed = {}
    module, hook = (appearance.R, "resolve") if name.startswith("str03") else (more.R, "resolve_segments")
    real = getattr(module, hook)
    monkeypatch.setattr(module, hook, lambda df, *a, **b: (fed.update(rows=[r.asDict() for r in df.collect()]), real(df, *a, **b))[1])
    got = QUERIES[name](spark, sf_small).collect()
    make, person = (lambda: PoseReid(), R._seen) if hook == "resolve" else (lambda: SegmentReid(6), R._segment)
    want = []
    for session in {r["session"] for r in fed["rows"]}:
        machine = make()
        frames = {}
        for r in fed["rows"]:
            if r["session"] == session:
                frames.setdefault(r["frame"], []).append(r)
        for f in sorted(frames):
            want += R.step_frame(machine, person, str(session), frames[f])
    people = sorted((x[0], x[1], x[2], x[3]) for x in want if not x[4])
    assert sorted((r["session"], r["frame"], r["raw_id"], r["person_id"]) for r in got if "event" not in r.asDict() or not r["event"]) == people and len(people) > 500
    if hook == "resolve":
        assert sum(r["event"] for r in got) == sum(x[4] for x in want)
    assert np.unique([x[3] for x in people]).size > 3
