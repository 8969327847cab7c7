"""Exact values of the geometry, as hand-made skeletons and landmarks have them."""

import math

import pytest
from pyspark.sql import functions as F

from gaitline.functions import face_hand as H
from gaitline.functions import geometry as G
from gaitline.functions.skeleton import COCO17, KP

REST = {
    "nose": (0, -70), "left_eye": (-5, -74), "right_eye": (5, -74), "left_ear": (-10, -72), "right_ear": (10, -72), "left_shoulder": (-20, -50), "right_shoulder": (20, -50),
    "left_elbow": (-30, -20), "right_elbow": (30, -20), "left_wrist": (-35, 5), "right_wrist": (35, 5), "left_hip": (-15, 0), "right_hip": (15, 0),
    "left_knee": (-18, 45), "right_knee": (18, 45), "left_ankle": (-20, 90), "right_ankle": (20, 90),
}
KP_TYPE = "kp array<struct<x:double,y:double,conf:double>>"


def body(**moved):
    at = REST | moved
    return [(None, None, 0.0) if at[n] is None else (float(at[n][0]), float(at[n][1]), 0.9) for n in COCO17]


def one(spark, column, kp=None, **values):
    rows = spark.createDataFrame([(kp or body(),)], KP_TYPE)
    return rows.select(column.alias("out")).first()["out"]


def pt(x, y):
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


@pytest.mark.parametrize("last, degrees", [((0, 100), 180.0), ((50, 50), 90.0)])
def test_elbow_angle(spark, last, degrees):
    assert one(spark, G.angle_at(pt(0, 0), pt(0, 50), pt(*last))) == pytest.approx(degrees)


def test_degenerate_angles_differ(spark):
    assert one(spark, G.angle_at(pt(1, 1), pt(1, 1), pt(2, 2))) is None
    assert one(spark, G.angle_padded(pt(1, 1), pt(1, 1), pt(2, 2))) == pytest.approx(90.0)


def test_missing_stays_missing(spark):
    kp = body(left_wrist=None)
    assert one(spark, G.joint_angles(F.col("kp"))["left_elbow_angle"], kp) is None
    assert one(spark, G.joint_angles(F.col("kp"))["right_elbow_angle"], kp) is not None
    assert one(spark, G.clip(F.lit(None).cast("double"), 0, 1)) is None


def test_normalized_origin(spark):
    n = G.normalized(F.col("kp"))
    assert one(spark, n["mid_hip"]["x"]) == 0 and one(spark, n["mid_hip"]["y"]) == 0
    assert one(spark, G.derived(n)["com_y"]) == pytest.approx(one(spark, n["neck"]["y"]) / 2)


def test_self_touch(spark):
    assert one(spark, G.self_touch_now(F.col("kp")), body(left_wrist=(0, -72))) > 0.9
    assert one(spark, G.self_touch_now(F.col("kp")), body(left_wrist=(300, 300), right_wrist=None)) == 0
    assert one(spark, G.self_touch_now(F.col("kp")), body(left_wrist=None, right_wrist=None)) is None


def test_signature_and_distance(spark):
    s = one(spark, G.signature(F.col("kp")))
    assert s[0] == pytest.approx(40 / 50) and s[10] == pytest.approx(10 / 50)
    a, b = F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4))), F.array(F.lit(0.1), F.lit(0.2), F.lit(None).cast("double"), F.lit(0.6))
    assert one(spark, G.signature_distance(a, b)) == pytest.approx(math.sqrt(0.04 / 3))
    assert one(spark, G.signature_distance(a, b, least=4)) is None


def test_similarities(spark):
    e = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    none = F.lit(None).cast("array<double>")
    assert one(spark, G.embedding_similarity(e(1, 0), e(1, 0))) == 1.0
    assert one(spark, G.embedding_similarity(e(1, 0), e(0, 1))) == 0.5
    assert one(spark, G.embedding_similarity(e(1, 0), e(-1, 0))) == 0.0
    assert one(spark, G.embedding_similarity(e(1, 0), none)) is None
    assert one(spark, G.color_similarity(e(0.95, 0.5), e(0.05, 0.5))) == pytest.approx(0.95)  # hues are neighbours across 1
    assert one(spark, G.fragment_similarity(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.0


def test_pair_cost_takes_the_strongest_signal(spark):
    cost, used = G.pose_pair_cost(F.lit(0.2), F.lit(1.0), F.lit(0.4), F.lit(0.2))
    assert one(spark, cost) == pytest.approx(0.1) and one(spark, used) == "color"
    cost, used = G.pose_pair_cost(F.lit(0.2), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    assert one(spark, cost) == pytest.approx(0.2) and one(spark, used) is None


def test_boxes_and_polygons(spark):
    box = lambda a, b, c, d: F.struct(*(F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (a, b, c, d))))
    assert one(spark, G.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, G.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    square = F.array(pt(0, 0), pt(4, 0), pt(4, 4), pt(0, 4))
    assert one(spark, G.polygon_area(square)) == 16 and one(spark, G.polygon_centroid(square)["x"]) == 2
    assert one(spark, G.polygon_area(F.array(pt(0, 0), pt(1, 1)))) == 0.0
    empty = F.array().cast("array<struct<x:double,y:double>>")
    assert one(spark, G.polygon_centroid(empty)["x"]) is None and one(spark, G.touches_border(empty, 10, 10)) is False
    assert one(spark, G.touches_border(square, 100, 100)) is True
    assert one(spark, G.xywh_to_xyxy(*map(F.lit, (0.5, 0.5, 0.25, 0.5)), 100, 200)["y2"]) == 200.0


@pytest.mark.parametrize("angles", [(0, 0, 0), (30, 0, 0), (-45, 10, 5), (15, -20, 0), (60, -30, 15)])
def test_euler_round_trip(spark, angles):
    back = H.euler(H.rotation(*(F.lit(float(a)) for a in angles)))
    assert [one(spark, c) for c in back.values()] == pytest.approx(angles, abs=1e-3)


def test_joint_attention(spark):
    args = F.lit(160.0), F.lit(480.0), 640.0
    assert one(spark, H.bearing(*args)) == 30.0
    assert one(spark, H.joint_attention(args[0], F.lit(30.0), args[1], 640.0)) > 0.95
    assert one(spark, H.joint_attention(args[0], F.lit(-30.0), args[1], 640.0)) == 0.0


def test_open_hand_and_fist(spark):
    def hand(reach):
        points = [(0.0, 0.0)] * 21
        for f, base in enumerate((1, 5, 9, 13, 17)):
            for k in range(4):
                points[base + k] = (10.0 * (f - 2), -20.0 - k * 15 * reach)
        return F.array(*(pt(*p) for p in points))

    assert one(spark, H.hand_openness(hand(1.0))) > one(spark, H.hand_openness(hand(0.1)))


def test_indices():
    assert KP["nose"] == 0 and KP["right_ankle"] == 16 and len(COCO17) == 17
