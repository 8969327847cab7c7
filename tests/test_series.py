"""Windows, spectra and time: against small definitions in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitline.operators import motion, spectral
from gaitline.operators.temporal import as_of


def frame(spark, values, schema="session long, track_id long, frame long, v double"):
    return spark.createDataFrame([(0, 0, k, v) for k, v in enumerate(values)], schema)


@pytest.mark.parametrize("n", [8, 33, 64])
def test_spectrum_equals_fft(spark, n):
    fps, rng = 30.0, np.random.default_rng(n)
    x = np.sin(2 * np.pi * 3 * np.arange(n) / fps) + 0.3 * rng.normal(size=n)
    got = spectral.repetitiveness(frame(spark, x.tolist()), "v", fps, ["session", "track_id"]).first()
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2
    f = np.fft.rfftfreq(n, 1 / fps)
    band = (f >= 0.5) & (f <= 8)
    assert got["peak_freq_hz"] == pytest.approx(f[band][p[band].argmax()])
    assert got["peak_power_ratio"] == pytest.approx(p[band].max() / p[1:].sum())


def test_spectrum_edges(spark):
    few = spectral.repetitiveness(frame(spark, [1.0] * 7), "v", 30.0, ["session"]).first()
    assert few["peak_freq_hz"] is None and few["peak_power_ratio"] is None
    flat = spectral.repetitiveness(frame(spark, [2.0] * 20), "v", 30.0, ["session"]).first()
    assert flat["peak_freq_hz"] is None and flat["peak_power_ratio"] == 0.0
    slow = spectral.repetitiveness(frame(spark, list(map(float, range(20)))), "v", 0.9, ["session"]).first()
    assert slow["peak_power_ratio"] == 0.0  # no frequency in the band


def test_sliding_waits_for_a_full_window(spark):
    df = frame(spark, [float(k) for k in range(10)]).withColumn("b", F.lag("v").over(motion.track()))
    out = motion.sliding(df, (F.col("v") - F.col("b")) * 2, 8, 1.0).orderBy("frame").collect()
    assert [r["frame"] for r in out] == [7, 8, 9]
    assert out[0]["window_energy"] == 2.0 and out[0]["activity"] == 1.0


def test_blinks(spark):
    ear = [0.6, 0.6, 0.6, 0.1, 0.6, 0.6, 0.1, 0.6, 0.6, 0.6, 0.1, 0.6, 0.6]
    out = motion.blink_rate(frame(spark, ear), "v", len(ear), 60.0).collect()
    assert [r["blink_rate_per_min"] for r in out] == [3.0]


def test_synchrony(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0, 1.0, 2.0]
    rows = motion.synchrony(frame(spark, a), frame(spark, [-x for x in a[:11]]), 4, 3).orderBy("frame_start").collect()
    assert [(r["frame_start"], r["frame_end"]) for r in rows] == [(0, 4), (3, 7), (6, 10)]
    assert all(r["synchrony"] == pytest.approx(-1.0) for r in rows)
    flat = motion.synchrony(frame(spark, a), frame(spark, [1.0] * 12), 4, 3).collect()
    assert all(r["synchrony"] is None for r in flat)


def test_derivatives_of_a_moving_body(spark):
    from test_geometry import body

    rows = [(0, 0, k, k / 30.0, [(x + 30 * k if x is not None else None, y, c) for x, y, c in body()]) for k in range(3)]
    df = spark.createDataFrame(rows, "session long, track_id long, frame long, t_s double, kp array<struct<x:double,y:double,conf:double>>")
    out = motion.clinical(df).orderBy("frame").collect()
    assert len(out[0].asDict()) == 5 + 97
    assert out[0]["neck_x_vel"] is None and out[1]["neck_x_vel"] == pytest.approx(0) and out[1]["neck_x_acc"] is None and out[2]["neck_x_acc"] == pytest.approx(0)


def test_energy_of_the_first_frame_is_zero(spark):
    from test_geometry import body

    df = spark.createDataFrame([(0, 0, k, body(left_wrist=None)) for k in range(2)], "session long, track_id long, frame long, kp array<struct<x:double,y:double,conf:double>>")
    assert [r["movement_energy"] for r in motion.movement_energy(df, 30.0).orderBy("frame").collect()] == [0.0, 0.0]
    assert motion.with_speeds(df, 30.0).orderBy("frame").select(motion.strict_energy(F.col("speeds")).alias("e")).collect()[1]["e"] is None


def test_window_rows():
    assert motion.window_rows(3.0, 30) == 90 and motion.window_rows(0.1, 10) == 8


def test_as_of(spark):
    left = spark.createDataFrame([(1, t) for t in (5, 10, 30)], "k int, t long")
    right = spark.createDataFrame([(1, 4, 40), (1, 10, 100), (2, 9, 90)], "k int, t long, w int")
    got = {r["t"]: r["w"] for r in as_of(left, right, ["k"], "t", "w", 10).collect()}
    assert got == {5: 40, 10: 100, 30: None}
