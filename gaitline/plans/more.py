"""Queries on the rest of the inventory: live rows, caps, histograms, reconciliation, rasters, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaitline.functions import geometry as G
from gaitline.functions.skeleton import JOINT_ANGLES
from gaitline.operators import chunks, color, matching, motion, raster
from gaitline.operators.ingest import at_frames, keep_class, prefixed, total_frames
from gaitline.sources import adapters as A
from gaitline.streaming import reid as R

from . import pose
from . import sqltext as Q
from .appearance import _fragment_tables
from .catalog import ORACLES, query
from .identity import CHUNK
from .pose import FPS, r6

@query(f"WITH {Q.SIG}, f AS (SELECT session, track_id, min(frame) AS first_frame, min(event_id) AS known FROM sig GROUP BY session, track_id), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY known % 2, known, track_id) AS k FROM f) SELECT session, track_id, k AS slot FROM r WHERE k <= 4")
def tk02_seed_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first four in order of discovery, known ones before new ones."""
    f = A.signal(spark, d).groupBy("session", "track_id").agg(F.min("event_id").alias("known"))
    k = F.row_number().over(W.partitionBy("session").orderBy(F.col("known") % 2, "known", "track_id"))
    return f.select("session", "track_id", k.cast("long").alias("slot")).filter("slot <= 4")


@query(f"WITH {Q.DET} SELECT frame, arg_max(det, (w * h, -det)) AS det, max(w * h - 50) AS area FROM det GROUP BY frame")
def tk03_largest_polygon(spark: SparkSession, d: str) -> DataFrame:
    det = A.detections(spark, d).select("frame", "det", G.polygon_area(F.col("poly")).alias("area"))
    return det.groupBy("frame").agg(F.max_by("det", F.struct("area", -F.col("det"))).alias("det"), F.max("area").alias("area"))


@query("""WITH p AS (SELECT l_orderkey AS frame, l_partkey % 180 AS hue, CAST(l_suppkey % 100 AS DOUBLE) / 100 AS sat FROM lineitem), b AS (SELECT frame, CAST(floor(hue / 1125e-2) AS BIGINT) AS bin, sat FROM p WHERE sat > 15e-2), n AS (SELECT frame, count(*) AS n, sum(sat) AS total FROM b GROUP BY frame HAVING count(*) >= 3)
SELECT frame, bin, round(sum(sat) / any_value(total), 12) AS share FROM b JOIN n USING (frame) GROUP BY frame, bin""")
def ag17_hue_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of hues weighed by saturation, from pixel rows; too few coloured pixels give none."""
    px = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 180).alias("hue"), ((F.col("l_suppkey") % 100).cast("double") / 100).alias("sat"))
    return color.hue_histogram(px, ["frame"], "hue", "sat", least=3).withColumn("share", F.round("share", 12))


@query("""SELECT l_orderkey AS frame, round(avg(CAST(l_partkey % 180 AS DOUBLE)) / 180, 6) AS mean_h, round(avg(CAST(l_suppkey % 256 AS DOUBLE)) / 255, 6) AS mean_s FROM lineitem GROUP BY 1 HAVING count(*) >= 9""")
def ag18_region_color(spark: SparkSession, d: str) -> DataFrame:
    px = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 180).alias("hue"), (F.col("l_suppkey") % 256).alias("sat"))
    return color.region_mean(px, ["frame"], "hue", "sat").select("frame", r6("mean_h").alias("mean_h"), r6("mean_s").alias("mean_s"))


@query()
def jn10_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Ids after each boundary mapped to those before it, by the best overlap of any two frames, as they lie or moved on."""
    oracle, base = A.two_runs(spark, d)
    # boundary k lies before frame k * CHUNK; five frames before it against two after
    ahead = F.floor((F.col("frame") + 5) / CHUNK).cast("long")
    prev = oracle.withColumn("boundary", ahead).filter(F.col("frame") < F.col("boundary") * CHUNK)
    behind = F.floor(F.col("frame") / CHUNK).cast("long")
    curr = base.withColumn("boundary", behind).filter((F.col("boundary") > 0) & (F.col("frame") < F.col("boundary") * CHUNK + 2))
    keys = ["session", "boundary"]
    mid = lambda a, b: (F.col(f"box.{a}") + F.col(f"box.{b}")) / 2.0
    speed = chunks.velocities(prev, [*keys, "id"], mid("x0", "x1"), mid("y0", "y1"))
    scores = chunks.anchor_scores(prev, curr, keys, speed)
    return matching.assign(scores, keys, "prev_id", "curr_id", "best_iou").filter("best_iou >= 0.3")


@query(f"WITH {Q.DET} SELECT frame, a.det AS a_id, b.det AS b_id, round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) / ((a.w + 1) * (a.h + 1) + (b.w + 1) * (b.h + 1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1)), 6) AS iou FROM det a JOIN det b USING (frame) WHERE a.det < b.det")
def sc19_raster_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the boxes' outlines on the pixel grid, edges included."""
    det = A.detections(spark, d).select("frame", "det", G.box_polygon(F.col("bbox")).alias("poly"))
    a, b = (det.select("frame", F.col("det").alias(f"{x}_id"), F.col("poly").alias(f"p{x}")) for x in "ab")
    pairs = a.join(b, "frame").filter("a_id < b_id")
    return raster.polygon_overlaps(pairs, "pa", "pb").select("frame", "a_id", "b_id", r6("iou").alias("iou"))


_MIXED = "list_transform(generate_series(1, 64), lambda i: 9e-1 * e.vec[i] + (1 - 9e-1) * CAST(v.embedding[i] AS DOUBLE))"


@query(f"""WITH RECURSIVE v AS (SELECT CAST(label AS BIGINT) AS label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
e(label, n, vec) AS (SELECT label, n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM v WHERE n = 1
  UNION ALL SELECT label, n, CASE WHEN size < 1e-9 THEN old ELSE list_transform(m, lambda x: x / size) END FROM (SELECT label, n, old, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS size FROM (SELECT v.label, v.n, e.vec AS old, {_MIXED} AS m FROM e JOIN v ON v.label = e.label AND v.n = e.n + 1)))
SELECT label, CAST(unnest(generate_series(0, 63)) AS INT) AS k, round(unnest(vec), 6) AS x FROM (SELECT label, arg_max(vec, n) AS vec FROM e GROUP BY label)""")
def wn17_embedding_ema(spark: SparkSession, d: str) -> DataFrame:
    """Running mean embedding of each identity at its end, folded in order and kept at length 1."""
    v = A.appearance(spark, d)
    return color.embedding_ema(v, ["label"], "vec", "vec_id").select("label", F.posexplode("vec").alias("k", "x")).select("label", "k", r6("x").alias("x"))


@query(f"WITH {Q.SIG}, t AS (SELECT track_id, count(*) AS n FROM sig GROUP BY track_id) SELECT printf('%d tracks, shortest %d, longest %d, under 60: %d', count(*), min(n), max(n), CAST(sum(CASE WHEN n < 60 THEN 1 ELSE 0 END) AS BIGINT)) AS summary FROM t")
def snk06_summary(spark: SparkSession, d: str) -> DataFrame:
    t = A.signal(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.format_string("%d tracks, shortest %d, longest %d, under 60: %d", F.count(F.lit(1)), F.min("n"), F.max("n"), F.count_if(F.col("n") < 60)).alias("summary"))


@query(f"""WITH RECURSIVE {Q.SIG}, c(session, track_id, frame, t) AS (SELECT session, track_id, frame, CAST(floor(v) AS BIGINT) FROM sig WHERE frame = 0 UNION ALL SELECT s.session, s.track_id, s.frame, greatest(CAST(floor(s.v) AS BIGINT), c.t + 1) FROM c JOIN sig s ON s.track_id = c.track_id AND s.frame = c.frame + 1) SELECT * FROM c""")
def str17_monotone_times(spark: SparkSession, d: str) -> DataFrame:
    """Time stamps in whole milliseconds that always go on: one that doesn't becomes the last one and 1."""
    sig = A.signal(spark, d)
    return sig.select("session", "track_id", "frame", motion.strictly_later(F.floor("v").cast("long"), motion.track()).alias("t"))


@query()
def str08_reidentify_segments(spark: SparkSession, d: str) -> DataFrame:
    """At most six people in a session, whatever raw ids come."""
    oracle, _ = A.two_runs(spark, d)
    mid = lambda a, b: (F.col(f"box.{a}") + F.col(f"box.{b}")) / 2.0
    w, h = (F.col("box.x1") - F.col("box.x0")).cast("double"), (F.col("box.y1") - F.col("box.y0")).cast("double")
    none = F.lit(None).cast("array<double>")
    raw = F.col("id") + 100 * F.floor(F.col("frame") / CHUNK).cast("long")
    rows = oracle.select("session", "frame", (F.col("frame") / FPS).alias("t_s"), raw.alias("raw_id"), mid("x0", "x1").alias("x"), mid("y0", "y1").alias("y"), F.sqrt(w * h).alias("scale"), F.try_divide(w, h).alias("aspect"), F.lit(1.0).alias("fill"), none.alias("hue"), none.alias("embedding"))
    return R.resolve_segments(rows, 6)


@query(f"WITH {Q.KPW} SELECT session, track_id, frame, CASE WHEN track_id = 7 THEN round(t_s, 6) END AS face_t, track_id % 8 AS color FROM kpw")
def pf05_target_track(spark: SparkSession, d: str) -> DataFrame:
    """Signals of one target; the skeletons of all stay."""
    from gaitline.operators.ingest import only_for

    kp = A.keypoints(spark, d)
    return kp.select("session", "track_id", "frame", only_for(r6("t_s"), F.col("track_id"), 7).alias("face_t"), G.track_color(F.col("track_id")).alias("color"))


@query("""WITH fr AS (SELECT CAST(label % 2 AS VARCHAR) AS run, label * 100 + n // 12 AS id, vec_id AS frame FROM (SELECT CAST(label AS BIGINT) AS label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings)), b AS (SELECT run, id, min(frame) AS f, max(frame) AS l, count(*) AS n FROM fr GROUP BY run, id)
SELECT a.run, a.id AS from_id, b.id AS into_id FROM b a JOIN b ON a.run = b.run AND a.id <> b.id AND a.l < b.f WHERE a.n >= 8 AND b.n >= 8 AND b.f > 0""")
def jn14_possible_merges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of fragments of which one ends before the other starts."""
    from gaitline.operators.fragments import bounds

    b = bounds(_fragment_tables(spark, d)[0]).filter("not short")
    a = b.select("run", F.col("id").alias("from_id"), F.col("last").alias("l"))
    s = b.filter("first > 0").select("run", F.col("id").alias("into_id"), F.col("first").alias("f"))
    return a.join(s, "run").filter("from_id <> into_id and l < f").select("run", "from_id", "into_id")



_CROP = [f"greatest(0, least({most}, CAST(round_even({c}, 0) AS INT)))" for c, most in (("x1", A.WIDTH), ("y1", A.HEIGHT), ("x2", A.WIDTH), ("y2", A.HEIGHT))]


@query(f"WITH {Q.DET}, c AS (SELECT frame, det, w * h AS box, {', '.join(f'{e} AS c{k}' for k, e in enumerate(_CROP))} FROM (SELECT frame, det, w, h, x1 + 5e-1 AS x1, y1 - 25e-2 AS y1, x2 + 5e-1 AS x2, y2 + 15e-1 AS y2 FROM det)) SELECT frame, det, c0 AS x1, c1 AS y1, c2 AS x2, c3 AS y2, (det % 7) * box / 8 / ((c2 - c0) * (c3 - c1)) >= 15e-2 AS masked FROM c WHERE c2 - c0 >= 24 AND c3 - c1 >= 48")
def sc37_person_crop(spark: SparkSession, d: str) -> DataFrame:
    """Crops of people large enough to embed, and whether their mask fills enough to be used."""
    det = A.detections(spark, d)
    moved = F.struct((F.col("bbox.x1") + 0.5).alias("x1"), (F.col("bbox.y1") - 0.25).alias("y1"), (F.col("bbox.x2") + 0.5).alias("x2"), (F.col("bbox.y2") + 1.5).alias("y2"))
    covered = (F.col("det") % 7) * (F.col("bbox.x2") - F.col("bbox.x1")) * (F.col("bbox.y2") - F.col("bbox.y1")) / 8
    crop = G.person_crop(moved, A.WIDTH, A.HEIGHT, F.lit(1.0))
    fill = covered / ((crop["x2"] - crop["x1"]) * (crop["y2"] - crop["y1"]))
    return det.withColumn("c", G.person_crop(moved, A.WIDTH, A.HEIGHT, fill)).filter("c is not null").select("frame", "det", "c.*")


@query(f"SELECT session, track_id, frame, {', '.join(f'{n} AS pose_{n}' for n in JOINT_ANGLES)} FROM ({ORACLES['sc02_joint_angles']})")
def pf03_prefixed(spark: SparkSession, d: str) -> DataFrame:
    return prefixed(pose.sc02_joint_angles(spark, d), "pose_", "session", "track_id", "frame")


@query(f"WITH {Q.DET} SELECT frame, det, round(conf, 6) AS conf FROM det WHERE det % 3 = 0")
def pf04_people_only(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one detector class."""
    return keep_class(A.detections(spark, d).withColumn("class_id", F.col("det") % 3)).select("frame", "det", r6("conf").alias("conf"))


@query(f"WITH {Q.SIG}, q AS (SELECT DISTINCT session, unnest([0, 37, 1000000]) AS frame FROM sig) SELECT q.session, q.frame, track_id, round(v, 6) AS v FROM q LEFT JOIN sig USING (session, frame)")
def src09_frame_access(spark: SparkSession, d: str) -> DataFrame:
    """Single frames of each session; past the end there is one row without a value."""
    sig = A.signal(spark, d)
    wanted = sig.select("session").distinct().withColumn("frame", F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 37, 1_000_000)))))
    return at_frames(sig, wanted).select("session", "frame", "track_id", r6("v").alias("v"))


@query(f"WITH {Q.SIG}, q AS (SELECT DISTINCT session FROM sig UNION ALL SELECT -1), n AS (SELECT session, max(frame) + 1 AS n FROM sig GROUP BY session) SELECT session, n FROM q LEFT JOIN n USING (session)")
def src11_total_frames(spark: SparkSession, d: str) -> DataFrame:
    """Length of each session asked for; unknown ones have none."""
    sig = A.signal(spark, d)
    asked = sig.select("session").distinct().unionByName(spark.createDataFrame([(-1,)], "session long"))
    return total_frames(asked, sig, "null")


def _hair(name: str) -> Q.Point:
    return Q.joint(name)


_UP = tuple(f"({_hair('nose')[k]} - {Q.SHOULDER[k]})" for k in (0, 1))
_EARS = [_hair("right_ear"), _hair("left_ear")]
_KNOWN = " AND ".join(f"{v} IS NOT NULL" for v in (*_EARS[0], *_EARS[1], *_UP))


@query(f"WITH {Q.KPW} SELECT session, track_id, frame, {', '.join(f'CASE WHEN {_KNOWN} THEN {e} END AS {n}' for n, e in ((f'h{k}_{a}', _EARS[(0, 1, 1, 0)[k]][i] + (f' + {_UP[i]}' if k > 1 else '')) for k in range(4) for i, a in enumerate('xy')))} FROM kpw")
def sc25_hair_corners(spark: SparkSession, d: str) -> DataFrame:
    corners = G.hair_corners(F.col("kp"))
    return A.keypoints(spark, d).select("session", "track_id", "frame", *(c[a].alias(f"h{k}_{a}") for k, c in enumerate(corners) for a in "xy"))


_SHAPE = "1 - (least(abs(a.aspect - b.aspect) / greatest(a.aspect, b.aspect, 1e-6), 1) + abs(a.fill - b.fill)) / 2"


@query(f"""WITH {Q.DET}, s AS (SELECT frame, det, w / h AS aspect, (w * h - 50) / (w * h) AS fill, [(det * k + frame) % 17 + 1 FOR k IN generate_series(1, 16)] AS raw FROM det), hs AS (SELECT *, list_sum(raw) AS total FROM s)
SELECT a.frame, a.det AS a_id, b.det AS b_id, round(greatest(0e0, least(1e0, {_SHAPE})), 6) AS shape, round(list_sum(list_transform(generate_series(1, 16), lambda k: least(a.raw[k] / a.total, b.raw[k] / b.total))), 6) AS histogram FROM hs a JOIN hs b ON a.frame = b.frame AND a.det < b.det""")
def sc29_shape_and_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of two people's outlines and of their hue histograms."""
    area = G.polygon_area(F.col("poly"))
    raw = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: ((F.col("det") * k + F.col("frame")) % 17 + 1).cast("double"))
    s = A.detections(spark, d).withColumn("raw", raw).withColumn("hist", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda t, y: t + y)))
    aspect, fill = G.shape_descriptor(F.col("bbox"), area, F.size("poly"))
    s = s.select("frame", "det", aspect.alias("aspect"), fill.alias("fill"), "hist")
    a, b = (s.select("frame", *(F.col(c).alias(f"{c}_{x}") for c in ("det", "aspect", "fill", "hist"))) for x in "ab")
    both = a.join(b, "frame").filter("det_a < det_b")
    shape = G.shape_similarity((F.col("aspect_a"), F.col("fill_a")), (F.col("aspect_b"), F.col("fill_b")))
    return both.select("frame", F.col("det_a").alias("a_id"), F.col("det_b").alias("b_id"), r6(shape).alias("shape"), r6(G.histogram_similarity(F.col("hist_a"), F.col("hist_b"))).alias("histogram"))
