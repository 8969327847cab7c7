"""Streams give what batches give."""

from pyspark.sql import functions as F

from gaitline.operators import motion
from gaitline.streaming import live


def feed(spark, df, path, parts, column="frame"):
    hi = df.agg(F.max(column)).first()[0] + 1
    for k in range(parts):
        df.filter((F.col(column) >= hi * k // parts) & (F.col(column) < hi * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


def test_live_windows(spark, tmp_path):
    df = spark.createDataFrame([("s", t, f, float((f * 7 + t * 3) % 11) if (f + t) % 13 else None) for t in range(3) for f in range(40)], "session string, track_id long, frame long, v double")
    run(live.windows(feed(spark, df, str(tmp_path / "in"), 4), 10, 15.0, 500.0), "windows", tmp_path)
    step = (F.col("v") - F.col("b")) * (F.col("v") - F.col("b")) * 225.0
    batch = motion.sliding(df.withColumn("b", F.lag("v").over(motion.track())), step, 10, 500.0)
    key = lambda rows: sorted((r["track_id"], r["frame"], round(r["window_energy"], 6), round(r["activity"], 9)) for r in rows)
    got = key(spark.table("windows").collect())
    assert got == key(batch.collect()) and len(got) == 3 * 31


def test_first_sightings(spark, tmp_path):
    df = spark.createDataFrame([("s", t, f) for f in range(8) for t in range(f // 2 + 1)], "session string, track_id long, frame long")
    run(live.first_sightings(feed(spark, df, str(tmp_path / "in"), 4)), "first", tmp_path)
    assert sorted((r["track_id"], r["frame"]) for r in spark.table("first").collect()) == [(0, 0), (1, 2), (2, 4), (3, 6)]


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [(k, at, 1) for k, at in enumerate((0, 5, 12, 40, 41, 1))]  # the last comes after the watermark has passed it
    df = spark.createDataFrame(rows, "frame long, at long, track_id long").withColumn("ts", F.timestamp_seconds("at"))
    run(live.tumbling(feed(spark, df, str(tmp_path / "in"), 6), "ts", "10 seconds", "5 seconds"), "tumbling", tmp_path)
    got = {r["window"]["start"].second: r["rows_seen"] for r in spark.table("tumbling").collect()}
    assert got == {0: 2, 10: 1}


def test_live_rows_equal_the_batch(spark, sf_small, tmp_path):
    from gaitline.operators import live as L
    from gaitline.plans import live as plan

    window = L.Window(10, 15.0, 10 / 15, activity=3e8, blink=0.9)
    df = L.signals(plan.rows(spark, sf_small), "session", "track_id", "frame").filter("track_id < 6").withColumn("session", F.col("session").cast("string"))
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    run(live.live_rows(feed(spark, df, str(tmp_path / "in"), 4), window), "live", tmp_path)
    batch = L.windowed(df, window).filter("full").toPandas().sort_values(["track_id", "frame"]).reset_index(drop=True)
    got = spark.table("live").toPandas().sort_values(["track_id", "frame"]).reset_index(drop=True)
    assert len(got) == len(batch) > 100
    for c in L.FEATURES:
        a, b = got[c].astype(float).to_numpy(), batch[c].astype(float).to_numpy()
        assert ((a == b) | ((a != a) & (b != b)) | (abs(a - b) <= 1e-9 * abs(b))).all(), c
    assert batch["blink_rate_per_min"].notna().any() and batch["left_hand_rep_power_ratio"].notna().any()


def test_derivatives_of_a_stream(spark, tmp_path):
    rows = [("s", 1, f, f / 15 + (5.0 if f >= 12 else 0.0), [float(f * f), float(3 * f) if f != 7 else None]) for f in range(20)]
    df = spark.createDataFrame(rows, "session string, track_id long, frame long, t_s double, x array<double>")
    run(live.derivatives(feed(spark, df, str(tmp_path / "in"), 4), forget_s=1.0), "derived", tmp_path)
    got = {r["frame"]: r for r in spark.table("derived").collect()}
    bad = lambda v: v is None or v != v
    assert all(bad(v) for f in (0, 12) for v in (*got[f]["vel"], *got[f]["acc"])) and bad(got[13]["acc"][0]) and bad(got[8]["vel"][1]) and not bad(got[9]["vel"][1])
    for f in (5, 11, 16):
        assert abs(got[f]["vel"][0] - (2 * f - 1) * 15) < 1e-6 and abs(got[f]["acc"][0] - 2 * 225) < 1e-4 and abs(got[f]["vel"][1] - 45) < 1e-6 or f == 8
