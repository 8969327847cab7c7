"""Tracking tables derived from the driver's tables by integer arithmetic, so that any engine makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FPS = 15.0
WIDTH, HEIGHT = 640, 480
CHUNK = 15


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, track_id, frame, t_s, event_id, v: one ordered signal for each user."""
    one = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    frame = F.row_number().over(one).cast("long") - 1
    return rows.select(F.floor(F.col("user_id") / 20).cast("long").alias("session"), F.col("user_id").alias("track_id"), frame.alias("frame"), "event_id", F.col("value").alias("v")).withColumn("t_s", F.col("frame") / FPS)


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, track_id, frame, t_s, event_id, kp: 17 joints, some missing."""
    e, u = F.col("event_id"), F.col("track_id")

    def made(k: int):
        gone = (e + k) % 23 == 0
        x, y = ((e * (7 + 2 * k) + u * 13) % WIDTH).cast("double"), ((e * (11 + 3 * k) + u * 5) % HEIGHT).cast("double")
        return F.struct(F.when(~gone, x).alias("x"), F.when(~gone, y).alias("y"), (((e * (3 + k)) % 100).cast("double") / 100.0).alias("conf"))

    return signal(spark, sf_dir).select("session", "track_id", "frame", "t_s", "event_id", F.array(*(made(k) for k in range(17))).alias("kp"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, det, bbox, poly, conf: boxes of an order's lines."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    det = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    x1, y1 = (F.col("l_partkey") % 560).cast("double"), ((F.col("l_suppkey") * 7) % 400).cast("double")
    w, h = (20 + F.col("l_quantity").cast("int")).cast("double"), (30 + 10 * F.col("l_linenumber")).cast("double")
    out = rows.select(F.col("l_orderkey").alias("frame"), det.alias("det"), x1.alias("x1"), y1.alias("y1"), w.alias("w"), h.alias("h"), (F.abs("l_discount") * 10).alias("conf"))
    bbox = F.struct("x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x2, y2 = F.col("x1") + F.col("w"), F.col("y1") + F.col("h")
    # a pentagon: the lower right corner is cut off
    poly = F.array(corner(F.col("x1"), F.col("y1")), corner(x2, F.col("y1")), corner(x2, y2 - 10.0), corner(x2 - 10.0, y2), corner(F.col("x1"), y2))
    return out.select("frame", "det", bbox.alias("bbox"), poly.alias("poly"), "conf")


def two_runs(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(oracle, baseline): session, frame, id, box (half open). Two people share a part of the image and may overlap.

    The baseline breaks and swaps identities by chunk, its boxes are moved and shrunk, some lie in a corner far from the
    person, and some are missing. The last frame of each session is in both, so that the runs are of equal length.
    """
    sig = signal(spark, sf_dir).select("session", "frame", "track_id", "event_id")
    e, o = F.col("event_id"), F.col("track_id") % 20
    pair = F.floor(o / 2)
    left, top = (pair % 5) * 128, F.floor(pair / 5) * 240
    x, y, w, h = left + 12 + (e * 7) % 40, top + 20 + (e * 11) % 90, 30 + (e * 13) % 31, 60 + (e * 17) % 51
    far = e % 13 == 5

    def box(x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct(*(c.cast("int").alias(n) for n, c in (("x0", x), ("y0", y), ("x1", x + w), ("y1", y + h))))

    there = box(x, y, w, h)
    moved = box(x + (e * 5) % 25 - 12, y + (e * 3) % 41 - 20, w - e % 7, h - e % 11)
    seen = F.when(far, box(left, top, F.lit(30), F.lit(50))).otherwise(moved)
    c = F.floor(F.col("frame") / chunk).cast("long")
    worn = F.when((c % 4 == 3) & (o % 2 == 1), ((o + 1) % 20) * 10 + 7).when((c % 4 == 2) & (o % 2 == 0), o * 10 + 7).otherwise(o * 10 + c % 3)
    return sig.select("session", "frame", o.alias("id"), there.alias("box")), sig.filter(e % 17 != 3).select("session", "frame", worn.alias("id"), seen.alias("box"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, id, frame, box: mask boxes of both runs in one table; an empty frame has no row."""
    a, b = two_runs(spark, sf_dir)
    return a.withColumn("run", F.lit("oracle")).unionByName(b.withColumn("run", F.lit("baseline"))).select("run", "session", "id", "frame", "box")


def rle_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, session, id, frame, h, w, box, rle: masks of both runs on a grid of an eighth; some have a hole, some two parts."""
    m = masks(spark, sf_dir)
    box = F.struct(*(F.floor(F.col(f"box.{c}") / 8).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))
    m = m.withColumn("box", box).withColumn("kind", (F.col("frame") + F.col("id")) % 3)
    x0, x1, y0, y1 = (F.col(f"box.{c}") for c in ("x0", "x1", "y0", "y1"))
    w = WIDTH // 8

    def row(y: Column) -> Column:
        at = lambda x, n: F.struct((y * w + x).cast("long").alias("start"), n.cast("int").alias("len"))
        ring = (F.col("kind") == 1) & (x1 - x0 > 2) & (y > y0) & (y < y1 - 1)
        gap = (F.col("kind") == 2) & ((y == y0 + 3) | (y == y0 + 4))
        return F.when(gap, F.array().cast("array<struct<start:bigint,len:int>>")).when(ring, F.array(at(x0, F.lit(1)), at(x1 - 1, F.lit(1)))).otherwise(F.array(at(x0, x1 - x0)))

    rle = F.when((x1 > x0) & (y1 > y0), F.flatten(F.transform(F.sequence(y0, y1 - 1), row)))
    return m.select("run", "session", "id", "frame", F.lit(HEIGHT // 8).alias("h"), F.lit(w).alias("w"), "box", rle.alias("rle")).filter("rle is not null")


def appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, vec: unit vectors in order of time; the label is the true identity."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, frame, face_idx, lm (478 points), center, yaw: a face near each track's head, landmarks by arithmetic."""
    from gaitline.functions.geometry import head_center

    kp = keypoints(spark, sf_dir).withColumn("head", head_center(F.col("kp"))).filter("head.x is not null")
    e = F.col("event_id")
    lm = F.transform(F.sequence(F.lit(0), F.lit(477)), lambda k: F.struct(((e * (3 + k) + 7 * k) % 211).cast("double").alias("x"), ((e * (5 + k) + 3 * k) % 197).cast("double").alias("y")))
    center = F.struct((F.col("head.x") + (e % 31) - 15).alias("x"), (F.col("head.y") + (e % 29) - 14).alias("y"))
    return kp.select("session", "frame", F.col("track_id").alias("face_idx"), lm.alias("lm"), center.alias("center"), ((e * 17) % 121 - 60).cast("double").alias("yaw"), "event_id")


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, frame, hand_idx, side, lm (21 points): a hand at each track's present right wrist."""
    from gaitline.functions.skeleton import KP

    kp = keypoints(spark, sf_dir).withColumn("w", F.col("kp")[KP["right_wrist"]]).filter("w.x is not null")
    e = F.col("event_id")
    lm = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct((F.col("w.x") + ((e * (k + 1)) % 97) - ((e % 97))).alias("x"), (F.col("w.y") + ((e * (2 * k + 1)) % 89) - (e % 89)).alias("y")))
    return kp.select("session", "frame", F.col("track_id").alias("hand_idx"), lm.alias("lm"), "event_id")
