"""Faces and hands given to people, against a walk over every frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitline.functions import geometry as G
from gaitline.functions.skeleton import KP, WRIST
from gaitline.operators import identity, ingest
from gaitline.plans.registry import QUERIES
from gaitline.sources import adapters as A


def walk(points, targets, limit):
    """Points by their nearest target's distance, each to the nearest target left under the limit."""
    out = []
    for frame, here in points.items():
        there = dict(targets.get(frame, {}))
        gap = lambda p, t: float(np.hypot(p[0] - t[0], p[1] - t[1]))
        order = sorted(here, key=lambda k: (min((gap(here[k], t) for t in there.values()), default=np.inf), k))
        for k in order:
            near = sorted((gap(here[k], t), n) for n, t in there.items())
            if near and near[0][0] < limit:
                out.append((*frame, k, near[0][1], round(near[0][0], 6)))
                del there[near[0][1]]
    return sorted(out)


def grouped(rows):
    out = {}
    for session, frame, key, x, y in rows:
        if x is not None and y is not None:
            out.setdefault((session, frame), {})[key] = (x, y)
    return out


def test_faces_to_tracks(spark, sf_small):
    faces = grouped(A.faces(spark, sf_small).select("session", "frame", "face_idx", "center.x", "center.y").collect())
    head = G.head_center(F.col("kp"))
    heads = grouped(A.keypoints(spark, sf_small).select("session", "frame", "track_id", head["x"], head["y"]).collect())
    got = QUERIES["jn04_faces_to_tracks"](spark, sf_small).collect()
    assert sorted((r["session"], r["frame"], r["face_idx"], r["track_id"], round(r["distance"], 6)) for r in got) == walk(faces, heads, 80.0)


def test_hands_to_wrists(spark, sf_small):
    at = F.col("lm")[WRIST]
    hands = grouped(A.hands(spark, sf_small).select("session", "frame", "hand_idx", at["x"], at["y"]).collect())
    kp = A.keypoints(spark, sf_small)
    both = [F.struct((F.col("track_id") * 2 + k).alias("key"), F.col("kp")[KP[f"{s}_wrist"]]["x"].alias("x"), F.col("kp")[KP[f"{s}_wrist"]]["y"].alias("y")) for k, s in enumerate(("left", "right"))]
    wrists = grouped(kp.select("session", "frame", F.explode(F.array(*both)).alias("w")).select("session", "frame", "w.*").collect())
    got = QUERIES["jn05_hands_to_wrists"](spark, sf_small).collect()
    assert sorted((r["session"], r["frame"], r["hand_idx"], r["track_id"] * 2 + (r["side"] == "right"), round(r["distance"], 6)) for r in got) == walk(hands, wrists, 60.0)


def test_runs_of_unequal_length_fail(spark):
    lengths = lambda rows: spark.createDataFrame(rows, "session long, n long")
    box = lambda k: {"x0": 0, "y0": 0, "x1": 5 + k, "y1": 5}
    run = spark.createDataFrame([(0, f, 1, box(f)) for f in range(4)], "session long, frame long, id long, box struct<x0:int,y0:int,x1:int,y1:int>")
    ok = identity.same_lengths(lengths([(0, 4), (0, 4)]), lengths([(0, 4)]))
    assert identity.correspondence(run, run, lengths=ok).filter("baseline_id = 1").count() == 4
    for a, b in (([(0, 4)], [(0, 5)]), ([(0, 4), (0, 3)], [(0, 4)]), ([(0, 4)], [])):
        with pytest.raises(Exception, match="unequal length in session 0"):
            identity.correspondence(run, run, lengths=identity.same_lengths(lengths(a), lengths(b))).collect()


def test_lengths_of_sessions(spark):
    frames = spark.createDataFrame([(1, 0), (1, 6), (2, 0)], "session long, frame long")
    asked = spark.createDataFrame([(1,), (3,)], "session long")
    assert {r["session"]: r["n"] for r in ingest.total_frames(asked, frames, "null").collect()} == {1: 7, 3: None}
    with pytest.raises(Exception, match="no frames of session 3"):
        ingest.total_frames(asked, frames).collect()
    with pytest.raises(ValueError):
        ingest.total_frames(asked, frames, "zero")
