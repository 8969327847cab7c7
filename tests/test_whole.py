"""Queries over whole tables: no frame, id or session is left out."""

import numpy as np
import pyarrow as pa
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from gaitline.operators import raster
from gaitline.plans.registry import ORACLES, QUERIES
from gaitline.sources import adapters as A


def test_raster_iou_of_every_frame(spark, sf_small, duck):
    got = QUERIES["sc19_raster_iou"](spark, sf_small).toPandas()
    boxes = {}
    for r in A.detections(spark, sf_small).select("frame", "det", "bbox.*").collect():
        boxes.setdefault(r["frame"], []).append(r)
    want = []
    for frame, rows in boxes.items():
        for a in rows:
            for b in rows:
                if a["det"] < b["det"]:
                    w, h = (max(0.0, min(a[f"{c}2"], b[f"{c}2"]) - max(a[f"{c}1"], b[f"{c}1"]) + 1) for c in "xy")
                    area = sum((r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1) for r in (a, b))
                    want.append((frame, a["det"], b["det"], w * h / (area - w * h)))
    have = sorted(got[["frame", "a_id", "b_id", "iou"]].itertuples(index=False, name=None))
    assert [x[:3] for x in have] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in have], [x[3] for x in sorted(want)], rtol=0, atol=6e-7)
    assert rows_of(got) == rows_of(duck.execute(ORACLES["sc19_raster_iou"]).df())


def test_raster_shortcuts_equal_spans():
    rng = np.random.default_rng(7)
    point = lambda x, y: {"x": float(x), "y": float(y)}

    def shape(kind):
        x, y, w, h = rng.integers(-12, 12, 2).tolist() + rng.integers(0, 14, 2).tolist()
        box = [point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)]
        crossed = [box[0], box[2], box[1], box[3]]
        free = [point(*p) for p in rng.integers(-12, 12, (5, 2)) + 0.5]
        return (box, box[::-1], crossed, free, box[:2], [], None)[kind]

    a, b = ([shape(k) for k in rng.integers(0, 7, 600)] for _ in "ab")
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    assert raster.overlaps(pa.array(a, kind), pa.array(b, kind)).tolist() == [raster.overlap(x, y) for x, y in zip(a, b)]
    assert raster.overlaps(pa.array([], kind), pa.array([], kind)).tolist() == []


def test_similarity_of_all_pairs(spark, sf_small, duck):
    got = QUERIES["sc30_embedding_similarity"](spark, sf_small).toPandas()
    v = sorted(((r["vec_id"], r["label"], np.array(r["vec"])) for r in A.appearance(spark, sf_small).collect()), key=lambda r: r[0])
    want = {(i, j): np.clip((x @ y + 1) / 2, 0, 1) for i, k, x in v for j, m, y in v if i < j and k == m}
    have = {(a, b): s for a, b, s in got[["a_id", "b_id", "similarity"]].itertuples(index=False, name=None)}
    assert len(got) == len(have) and have.keys() == want.keys()
    assert all(abs(have[k] - want[k]) <= 6e-7 for k in want)
    assert rows_of(got) == rows_of(duck.execute(ORACLES["sc30_embedding_similarity"]).df())


def test_dense_export_to_the_end_of_the_run(spark, sf_small):
    from gaitline.plans.appearance import _fragment_tables

    masks = _fragment_tables(spark, sf_small)[0].select("run", "id", "frame").toPandas()
    n = masks.groupby("run")["frame"].max() + 1
    want = {k: (n[k[0]], len(g)) for k, g in masks.groupby(["run", "id"])}
    got = {(r["run"], r["id"]): (r["frames"], r["filled"]) for r in QUERIES["snk03_dense_export"](spark, sf_small).collect()}
    assert got == want and max(n) > 60


def test_union_and_round_trip_of_whole_tables(spark, sf_small, duck):
    got = QUERIES["so02_both_pipelines"](spark, sf_small).toPandas()
    pose = got["pipeline"] == "pose"
    assert pose.sum() == A.signal(spark, sf_small).count() and (~pose).sum() == A.detections(spark, sf_small).count()
    assert rows_of(got) == rows_of(duck.execute(ORACLES["so02_both_pipelines"]).df())
    # the smallest tables have one session
    more = str(DATA / "sf0.01")
    back = QUERIES["snk01_csv_round_trip"](spark, more).toPandas()
    want = A.signal(spark, more).selectExpr("session", "track_id", "frame", "round(v, 6) AS v").toPandas()
    assert rows_of(back) == rows_of(want) and back["session"].max() >= 3


def test_every_boundary_is_reconciled(spark, sf_small):
    from gaitline.operators import chunks, matching
    from gaitline.plans.identity import CHUNK

    last = A.signal(spark, sf_small).agg({"frame": "max"}).first()[0]
    got = QUERIES["jn10_reconcile"](spark, sf_small).toPandas()
    assert set(got["boundary"]) <= set(range(1, last // CHUNK + 1)) and got["boundary"].max() > 1
    # a boundary by itself, as the query did for the first
    oracle, base = A.two_runs(spark, sf_small)
    x, y = ((F.col(f"box.{c}0") + F.col(f"box.{c}1")) / 2.0 for c in "xy")
    for k in (1, int(got["boundary"].max())):
        prev = oracle.filter(f"frame between {k * CHUNK - 5} and {k * CHUNK - 1}")
        curr = base.filter(f"frame between {k * CHUNK} and {k * CHUNK + 1}")
        scores = chunks.anchor_scores(prev, curr, ["session"], chunks.velocities(prev, ["session", "id"], x, y))
        want = matching.assign(scores, ["session"], "prev_id", "curr_id", "best_iou").filter("best_iou >= 0.3").toPandas()
        assert rows_of(got[got["boundary"] == k].drop(columns="boundary")) == rows_of(want)


def test_reidentification_sees_all_tracks(spark, sf_small):
    kp = A.keypoints(spark, sf_small)
    out = QUERIES["str08_reidentify_segments"](spark, sf_small).toPandas()
    here = A.two_runs(spark, sf_small)[0].select("session", "frame", "id").toPandas()
    ids = out["raw_id"] % 100
    assert set(ids) == set(here["id"]) and ids.max() >= 6 and len(out) == len(here)
    assert out.groupby("session")["person_id"].nunique().max() <= 6
    rows = QUERIES["str03_reidentify"](spark, sf_small).toPandas()
    raw = rows.loc[rows["raw_id"].notna(), "raw_id"] // 2
    assert set(raw.astype(int)) == {r["track_id"] for r in kp.select("track_id").distinct().collect()} and (raw % 20).max() >= 4
