"""Queries on detections, identities and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitline.functions import geometry as G
from gaitline.operators import chunks, identity, matching
from gaitline.sources import adapters as A
from gaitline.sources import files, registry

from . import sqltext as Q
from .catalog import query
from .pose import r6

CHUNK = A.CHUNK
for _name, _source in (("pose", A.keypoints), ("segmentation", A.detections), ("masks", A.rle_masks)):
    registry.register(_name, _source, replace=True)

# --- detections ---------------------------------------------------------------------------------------------

_PX = ["x1", "x2", "x2", "x2 - 10", "x1"]
_PY = ["y1", "y1", "y2 - 10", "y2", "y2"]
_AREA = "abs(" + " + ".join(f"(({_PX[k]}) * ({_PY[(k + 1) % 5]}) - ({_PX[(k + 1) % 5]}) * ({_PY[k]}))" for k in range(5)) + ") / 2"


@query(f"WITH {Q.DET} SELECT frame, det, x1, y1, x2, y2, round(({' + '.join(_PX)}) / 5, 6) AS centroid_x, round(({' + '.join(_PY)}) / 5, 6) AS centroid_y, {_AREA} AS mask_area_px, round(conf, 6) AS box_conf FROM det")
def pf01_segment_rows(spark: SparkSession, d: str) -> DataFrame:
    c = G.polygon_centroid(F.col("poly"))
    return A.detections(spark, d).select("frame", "det", "bbox.*", r6(c["x"]).alias("centroid_x"), r6(c["y"]).alias("centroid_y"), G.polygon_area(F.col("poly")).alias("mask_area_px"), r6("conf").alias("box_conf"))


@query(f"WITH {Q.DET}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, det) AS rk, row_number() OVER (PARTITION BY frame ORDER BY det) AS k, count(*) OVER (PARTITION BY frame) AS n FROM det) SELECT frame, det, round(conf, 6) AS conf, CASE WHEN n <= 2 THEN k ELSE rk END AS place FROM r WHERE rk <= 2")
def tk01_cap_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    """At most two in a frame; as they were in frames within the limit, by confidence in those over it."""
    return matching.top_confident(A.detections(spark, d), ["frame"], "conf", "det", 2, "place").select("frame", "det", r6("conf").alias("conf"), F.col("place").cast("long").alias("place"))


_INT = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(f"WITH {Q.DET}, p AS (SELECT a.frame, a.det AS a_id, b.det AS b_id, {_INT} AS i, a.w * a.h + b.w * b.h AS s FROM det a JOIN det b ON a.frame = b.frame AND a.det < b.det) SELECT frame, a_id, b_id, round(i / (s - i), 6) AS iou FROM p WHERE i > 0")
def jn06_pairwise_iou(spark: SparkSession, d: str) -> DataFrame:
    box = A.detections(spark, d).select("frame", F.col("det").alias("id"), F.struct(F.col("bbox.x1").alias("x0"), F.col("bbox.y1").alias("y0"), F.col("bbox.x2").alias("x1"), F.col("bbox.y2").alias("y1")).alias("box"))
    return matching.overlaps(box, box, ["frame"], "a_id", "b_id").filter("a_id < b_id").select("frame", "a_id", "b_id", r6("iou").alias("iou"))


@query(f"WITH {Q.DET}, p AS (SELECT a.frame, a.det, b.det AS o, {_INT} AS i, a.w * a.h + b.w * b.h AS s FROM det a JOIN det b ON a.frame = b.frame AND b.det < a.det) SELECT frame, det FROM det WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame = det.frame AND p.det = det.det AND i / (s - i) >= 2e-1)")
def jn16_new_people(spark: SparkSession, d: str) -> DataFrame:
    """Detections that overlap no earlier one of their frame: an anti join."""
    det = A.detections(spark, d)
    a, b = det.alias("a"), det.select("frame", "det", "bbox").alias("b")
    known = (F.col("a.frame") == F.col("b.frame")) & (F.col("b.det") < F.col("a.det")) & (G.box_iou(F.col("a.bbox"), F.col("b.bbox"), ("x1", "y1", "x2", "y2")) >= 0.2)
    return a.join(b, known, "left_anti").select("frame", "det")


@query(f"""WITH {Q.DET}, t AS (SELECT frame % 500 AS g, det, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame FROM det GROUP BY 1, 2) SELECT g, det AS track_id, frames, first_frame, last_frame FROM t""")
def ag09_track_churn(spark: SparkSession, d: str) -> DataFrame:
    det = A.detections(spark, d).withColumn("g", F.col("frame") % 500)
    return identity.churn(det, ["g"], "det").withColumnRenamed("det", "track_id")


@query(f"""WITH {Q.DET}, t AS (SELECT frame % 500 AS g, det, count(*) AS frames FROM det GROUP BY 1, 2), r AS (SELECT g, frames, row_number() OVER (PARTITION BY g ORDER BY frames) AS r, count(*) OVER (PARTITION BY g) AS n FROM t)
SELECT g, count(*) AS tracks, min(frames) AS shortest, max(CASE WHEN r = n // 2 + 1 THEN frames END) AS upper_median, max(frames) AS longest, CAST(sum(CASE WHEN frames < 15 THEN 1 ELSE 0 END) AS BIGINT) AS short_tracks, round(avg(CASE WHEN frames < 15 THEN 1e0 ELSE 0e0 END), 6) AS short_share FROM r GROUP BY g""")
def ag10_lifespans(spark: SparkSession, d: str) -> DataFrame:
    out = identity.lifespans(ag09_track_churn(spark, d), ["g"])
    return out.withColumn("short_share", r6("short_share"))


@query(f"""WITH {Q.DET} SELECT frame, count(*) AS people_count, round(avg(conf), 6) AS mean_conf, round(quantile_cont(w, 95e-2), 6) AS p95_width FROM det GROUP BY frame""")
def ag20_people_count(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("bbox.x2") - F.col("bbox.x1")
    return A.detections(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("people_count"), r6(F.avg("conf")).alias("mean_conf"), r6(F.percentile(w, 0.95)).alias("p95_width"))


@query(f"WITH {Q.SIG} SELECT session, track_id, frame, round(avg(v) OVER (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS mean_latency, round(1000 / avg(v) OVER (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS fps FROM sig")
def ag19_moving_latency(spark: SparkSession, d: str) -> DataFrame:
    from gaitline.operators.motion import track

    sig = A.signal(spark, d).withColumn("mean", F.avg("v").over(track().rowsBetween(-29, 0)))
    # no latency is no limit, as in the SQL; in Spark a division by zero is an error
    fps = F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(1000 / F.col("mean"))
    return sig.select("session", "track_id", "frame", r6("mean").alias("mean_latency"), r6(fps).alias("fps"))


@query(f"WITH {Q.DET} SELECT frame, det, round(w / h, 6) AS aspect, round({_AREA} / (w * h), 6) AS fill, x1 <= 1 OR y1 <= 1 OR x2 >= {A.WIDTH} - 2 OR y2 >= {A.HEIGHT} - 2 AS on_border FROM det")
def sc29_shape_descriptor(spark: SparkSession, d: str) -> DataFrame:
    aspect, fill = G.shape_descriptor(F.col("bbox"), G.polygon_area(F.col("poly")), F.size("poly"))
    return A.detections(spark, d).select("frame", "det", r6(aspect).alias("aspect"), r6(fill).alias("fill"), G.touches_border(F.col("poly"), A.HEIGHT, A.WIDTH).alias("on_border"))


@query(f"WITH {Q.DET} SELECT frame, det, greatest(0, CAST(trunc(x1 - w * 15e-2) AS INT)) AS x1, greatest(0, CAST(trunc(y1 - h * 15e-2) AS INT)) AS y1, least({A.WIDTH}, CAST(trunc(x2 + w * 15e-2) AS INT)) AS x2, least({A.HEIGHT}, CAST(trunc(y2 + h * 15e-2) AS INT)) AS y2 FROM det")
def sc17_padded_crop(spark: SparkSession, d: str) -> DataFrame:
    return A.detections(spark, d).withColumn("c", G.padded_crop(F.col("bbox"), A.WIDTH, A.HEIGHT)).select("frame", "det", "c.*")


# --- identity metrics ------------------------------------------------------------------------------------------


def _corr(spark: SparkSession, d: str) -> DataFrame:
    n = _totals(spark, d)
    return identity.correspondence(*A.two_runs(spark, d), lengths=identity.same_lengths(n, n))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return A.signal(spark, d).groupBy("session").agg((F.max("frame") + 1).alias("n"))


@query(f"WITH {Q.RUNS} SELECT session, frame, oracle_id, baseline_id FROM corr")
def jn08_correspondence(spark: SparkSession, d: str) -> DataFrame:
    return _corr(spark, d).select("session", "frame", "oracle_id", "baseline_id")


def _switches(entity: str, other: str, corr: str = "corr") -> str:
    return f"""SELECT session, {entity} AS entity_id, f AS from_id, {other} AS to_id, lf AS last_seen_frame, frame AS new_seen_frame, lf // {CHUNK} <> frame // {CHUNK} AS cross_chunk FROM (
  SELECT session, frame, {entity}, {other}, lag({other}) OVER w AS f, lag(frame) OVER w AS lf, row_number() OVER (PARTITION BY session, {entity}, {other} ORDER BY frame) AS nth FROM {corr} WHERE baseline_id IS NOT NULL WINDOW w AS (PARTITION BY session, {entity} ORDER BY frame, {other})) WHERE nth = 1 AND f <> {other}"""


_FRAG, _SWAP = _switches("oracle_id", "baseline_id"), _switches("baseline_id", "oracle_id")


@query(f"WITH {Q.RUNS} SELECT 'fragmentation' AS kind, * FROM ({_FRAG}) UNION ALL SELECT 'swap' AS kind, * FROM ({_SWAP})")
def wn09_switch_events(spark: SparkSession, d: str) -> DataFrame:
    corr = files.settled(_corr(spark, d))
    frag = identity.switch_events(corr, "oracle_id", "baseline_id", CHUNK).withColumn("kind", F.lit("fragmentation"))
    return frag.unionByName(identity.switch_events(corr, "baseline_id", "oracle_id", CHUNK).withColumn("kind", F.lit("swap")))


def _bounds(corr: str = "corr", totals: str = "SELECT session, max(frame) + 1 AS n FROM sig GROUP BY session") -> str:
    return f"""bnd AS (SELECT session, unnest(generate_series(1, CAST(ceil(n / {CHUNK}) AS BIGINT) - 1)) * {CHUNK} AS b FROM ({totals})),
chk AS (SELECT c.session, b AS boundary_frame, oracle_id, arg_max(baseline_id, frame) FILTER (frame < b) AS before_baseline_id, max(frame) FILTER (frame < b) AS bf, arg_min(baseline_id, frame) FILTER (frame >= b) AS after_baseline_id, min(frame) FILTER (frame >= b) AS af FROM bnd JOIN (SELECT * FROM {corr} WHERE baseline_id IS NOT NULL) c ON c.session = bnd.session GROUP BY c.session, b, oracle_id),
bc AS (SELECT session, boundary_frame, oracle_id, before_baseline_id, after_baseline_id, before_baseline_id = after_baseline_id AS correct FROM chk WHERE bf IS NOT NULL AND af IS NOT NULL AND boundary_frame - bf <= {CHUNK} AND af - boundary_frame <= {CHUNK})"""


@query(f"WITH {Q.RUNS}, {_bounds()} SELECT * FROM bc")
def wn10_boundary_checks(spark: SparkSession, d: str) -> DataFrame:
    return identity.boundary_checks(_corr(spark, d), _totals(spark, d), CHUNK)


def _report(corr: str = "corr") -> str:
    """SQL of the report's parts fr, sw and bk, over _bounds()."""
    parts = (("fr", "f", "oracle_id", "baseline_id"), ("sw", "s", "baseline_id", "oracle_id"))
    counted = ", ".join(f"{t} AS (SELECT session, count(*) AS {n}, count(*) FILTER (cross_chunk) AS {n}c FROM ({_switches(x, y, corr)}) GROUP BY session)" for t, n, x, y in parts)
    return f"{counted}, bk AS (SELECT session, count(*) AS t, count(*) FILTER (correct) AS c FROM bc GROUP BY session)"


_REPORTED = "coalesce(f, 0) AS fragmentation_count, coalesce(fc, 0) AS cross_chunk_fragmentation_count, coalesce(f - fc, 0) AS intra_chunk_fragmentation_count, coalesce(s, 0) AS swap_count, coalesce(sc, 0) AS cross_chunk_swap_count, coalesce(s - sc, 0) AS intra_chunk_swap_count, coalesce(c, 0) AS correct_boundary_matches, coalesce(t, 0) AS total_boundaries_checked, round(c / t, 6) AS boundary_accuracy"


@query(f"""WITH {Q.RUNS}, {_bounds()}, {_report()}
SELECT session, {_REPORTED} FROM (SELECT DISTINCT session FROM sig) LEFT JOIN fr USING (session) LEFT JOIN sw USING (session) LEFT JOIN bk USING (session)""")
def ag16_persistence_report(spark: SparkSession, d: str) -> DataFrame:
    return identity.report(files.settled(_corr(spark, d)), _totals(spark, d), CHUNK).withColumn("boundary_accuracy", r6("boundary_accuracy"))


_CONFIG = 1_000_000
_ALL_RUNS = f"SELECT {_CONFIG} + session AS session, frame, oracle_id, baseline_id FROM corr UNION ALL SELECT {2 * _CONFIG} + session, frame, id, id FROM ora UNION ALL SELECT {3 * _CONFIG} + session, frame, oracle_id, baseline_id * 2 FROM corr"


@query(f"""WITH {Q.RUNS}, every AS MATERIALIZED ({_ALL_RUNS}), tt AS (SELECT k * {_CONFIG} + session AS session, n FROM (SELECT session, max(frame) + 1 AS n FROM sig GROUP BY session), (SELECT unnest([1, 2, 3]) AS k)), {_bounds("every", "SELECT * FROM tt")}, {_report("every")},
ct AS (SELECT session, count(DISTINCT baseline_id) AS ids, count(baseline_id) AS matched FROM every GROUP BY session)
SELECT session // {_CONFIG} AS config, session % {_CONFIG} AS session, ids, matched, {_REPORTED} FROM tt LEFT JOIN ct USING (session) LEFT JOIN fr USING (session) LEFT JOIN sw USING (session) LEFT JOIN bk USING (session)""")
def jn23_configs_against_reference(spark: SparkSession, d: str) -> DataFrame:
    """Three runs scored against one reference, a report for each: run and session are one key of one plan."""
    oracle, base = A.two_runs(spark, d)
    runs = [base, oracle, base.withColumn("id", F.col("id") * 2)]
    shifted = lambda df, k: df.withColumn("session", F.col("session") + k * _CONFIG)
    both = [(shifted(oracle, k), shifted(run, k)) for k, run in enumerate(runs, 1)]
    first, second = both[0]
    for o, r in both[1:]:
        first, second = first.unionByName(o), second.unionByName(r)
    corr = files.settled(identity.correspondence(first, second))
    totals = _totals(spark, d).withColumn("session", F.explode(F.array(*(F.col("session") + k * _CONFIG for k in (1, 2, 3)))))
    counts = corr.groupBy("session").agg(F.countDistinct("baseline_id").alias("ids"), F.count("baseline_id").alias("matched"))
    out = identity.report(corr, totals, CHUNK).join(counts, "session").withColumn("boundary_accuracy", r6("boundary_accuracy"))
    return out.withColumn("config", F.floor(F.col("session") / _CONFIG).cast("int")).withColumn("session", F.col("session") % _CONFIG)


# --- chunks ----------------------------------------------------------------------------------------------------------

_LEN, _OVER = 20, 5
_STRIDE = _LEN - _OVER
_LAST = f"greatest(0, CAST(ceil((n - {_LEN}) / {_STRIDE}) AS BIGINT))"
_TOT = "tot AS (SELECT session, max(frame) + 1 AS n FROM sig GROUP BY session)"


@query(f"WITH {Q.SIG}, {_TOT}, c AS (SELECT session, n, unnest(generate_series(0, {_LAST})) AS chunk_index FROM tot) SELECT session, chunk_index, chunk_index * {_STRIDE} AS start, least(chunk_index * {_STRIDE} + {_LEN}, n) AS \"end\" FROM c")
def wn12_chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    return chunks.ranges(_totals(spark, d), _LEN, _OVER)


_MEM = f"mem AS (SELECT session, track_id, frame, v, unnest(generate_series(greatest(0, CAST(ceil((frame - {_LEN} + 1) / {_STRIDE}) AS BIGINT)), least(frame // {_STRIDE}, {_LAST}))) AS chunk_index FROM sig JOIN tot USING (session) WHERE n > {_OVER})"


@query(f"WITH {Q.SIG}, {_TOT}, {_MEM} SELECT session, chunk_index, count(*) AS rows_held, count(DISTINCT track_id) AS ids, CAST(sum(frame - chunk_index * {_STRIDE}) AS BIGINT) AS local_sum FROM mem GROUP BY session, chunk_index")
def wn13_chunk_membership(spark: SparkSession, d: str) -> DataFrame:
    mem = chunks.memberships(A.signal(spark, d), _totals(spark, d), _LEN, _OVER)
    return mem.groupBy("session", "chunk_index").agg(F.count(F.lit(1)).alias("rows_held"), F.countDistinct("track_id").alias("ids"), F.sum("local_frame").alias("local_sum"))


_EVERY = 6


@query(f"WITH {Q.SIG}, {_TOT}, {_MEM} SELECT session, chunk_index, (frame - chunk_index * {_STRIDE}) // {_EVERY} AS redetect_window, count(DISTINCT track_id) AS ids, min(frame) FILTER ((frame - chunk_index * {_STRIDE}) % {_EVERY} = 0) AS redetect_frame FROM mem GROUP BY ALL")
def str10_redetections(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a chunk at whose first frame people are looked for anew."""
    parts = chunks.redetections(chunks.memberships(A.signal(spark, d), _totals(spark, d), _LEN, _OVER), _EVERY)
    return parts.groupBy("session", "chunk_index", "redetect_window").agg(F.countDistinct("track_id").alias("ids"), F.min(F.when(F.col("redetect"), F.col("frame"))).alias("redetect_frame"))


@query(f"WITH {Q.SIG}, {_TOT}, {_MEM} SELECT session, track_id, frame, chunk_index FROM mem WHERE chunk_index = 0 OR frame - chunk_index * {_STRIDE} >= {_OVER}")
def pf13_fresh_frames(spark: SparkSession, d: str) -> DataFrame:
    mem = chunks.memberships(A.signal(spark, d), _totals(spark, d), _LEN, _OVER)
    return chunks.fresh(mem, _OVER).select("session", "track_id", "frame", "chunk_index")


@query(f"WITH {Q.KPW}, h AS (SELECT session, track_id, frame, {Q.HIP[0]} AS hx, {Q.HIP[1]} AS hy FROM kpw), k AS (SELECT * FROM h WHERE hx IS NOT NULL AND hy IS NOT NULL), s AS (SELECT session, track_id, (hx - lag(hx) OVER w) / (frame - lag(frame) OVER w) AS sx, (hy - lag(hy) OVER w) / (frame - lag(frame) OVER w) AS sy FROM k WINDOW w AS (PARTITION BY session, track_id ORDER BY frame)) SELECT session, track_id, round(median(sx), 6) AS vx, round(median(sy), 6) AS vy FROM s WHERE sx IS NOT NULL GROUP BY session, track_id")
def ag11_velocities(spark: SparkSession, d: str) -> DataFrame:
    hip = G.hip_center(F.col("kp"))
    return chunks.velocities(A.keypoints(spark, d), ["session", "track_id"], hip["x"], hip["y"]).select("session", "track_id", r6("vx").alias("vx"), r6("vy").alias("vy"))


def _local_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The oracle run cut into chunks, ids renamed in each."""
    oracle, _ = A.two_runs(spark, d)
    mem = chunks.memberships(oracle, _totals(spark, d), _LEN, _OVER)
    return mem.select("session", "chunk_index", "local_frame", ((F.col("id") + F.col("chunk_index") * 3) % 20).alias("local_id"), "id", "box")


_CH = f"ch AS (SELECT o.session, chunk_index, o.frame - chunk_index * {_STRIDE} AS lf, (id + chunk_index * 3) % 20 AS local_id, id, bx0, by0, bx1, by1 FROM ora o JOIN mem m ON m.session = o.session AND m.frame = o.frame AND m.track_id = o.session * 20 + o.id)"
_HI = "greatest(0, least(a.bx1, b.bx1) - greatest(a.bx0, b.bx0)) * greatest(0, least(a.by1, b.by1) - greatest(a.by0, b.by0))"


@query(f"""WITH {Q.RUNS}, {_TOT}, {_MEM}, {_CH}, p AS (SELECT b.session, b.chunk_index, a.local_id AS prev_id, b.local_id AS curr_id, CAST({_HI} AS DOUBLE) AS i, CAST((a.bx1 - a.bx0) * (a.by1 - a.by0) + (b.bx1 - b.bx0) * (b.by1 - b.by0) AS DOUBLE) AS s FROM ch a JOIN ch b ON a.session = b.session AND b.chunk_index = a.chunk_index + 1 AND a.lf - {_STRIDE} = b.lf WHERE b.lf < {_OVER} AND a.lf >= {_STRIDE})
SELECT session, chunk_index, prev_id, curr_id, round(avg(CASE WHEN s > i THEN i / (s - i) ELSE 0e0 END), 6) AS mean_iou, count(*) AS shared FROM p GROUP BY ALL""")
def jn11_overlap_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean overlap of a chunk's local ids with the previous one's, over the frames that they share."""
    return chunks.overlap_scores(_local_chunks(spark, d), _OVER, _STRIDE).withColumn("mean_iou", r6("mean_iou"))


@query()
def jn11_carried_ids(spark: SparkSession, d: str) -> DataFrame:
    """Global ids through all chunks; a linked track keeps one id."""
    local = _local_chunks(spark, d)
    seen = local.groupBy("session", "chunk_index", "local_id").agg(F.min("local_frame").alias("first_seen")).withColumn("pos", F.col("local_id"))
    return chunks.carry_ids(chunks.overlap_scores(local, _OVER, _STRIDE), seen, 0.3)


@query()
def str13_gallery_ids(spark: SparkSession, d: str) -> DataFrame:
    """As jn11_carried_ids, with people who are away for a chunk and are known again by their embedding."""
    local = _local_chunks(spark, d).filter("(id + chunk_index) % 4 <> 2")
    like = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.when(k == F.col("id"), 1.0).otherwise(0.0) + ((F.col("chunk_index") + k) % 3) * 0.05)
    vec = F.transform(like, lambda x: x / F.sqrt(F.aggregate(like, F.lit(0.0), lambda t, y: t + y * y)))
    seen = local.groupBy("session", "chunk_index", "local_id").agg(F.min("local_frame").alias("first_seen"), F.first(vec).alias("vec")).withColumn("pos", F.col("local_id"))
    return chunks.carry_ids(chunks.overlap_scores(local, _OVER, _STRIDE), seen, 0.3, gallery={"least": 0.8, "max_age": 3})


# --- sets, remaps, pairs of streams ------------------------------------------------------------------------------------


@query(f"WITH {Q.SIG}, a AS (SELECT session, track_id FROM sig WHERE frame = 40), b AS (SELECT session, track_id FROM sig WHERE frame = 60) SELECT * FROM (SELECT 'gone' AS kind, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL SELECT 'kept' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def so05_id_sets(spark: SparkSession, d: str) -> DataFrame:
    sig = A.signal(spark, d)
    a, b = (sig.filter(F.col("frame") == k).select("session", "track_id") for k in (40, 60))
    return a.subtract(b).withColumn("kind", F.lit("gone")).unionByName(a.intersect(b).withColumn("kind", F.lit("kept")))


@query(f"WITH {Q.KPW}, o AS (SELECT session, frame, track_id FROM kpw) SELECT 'pose' AS pipeline, session, frame, track_id, c0 AS nose_conf, NULL AS conf FROM kpw UNION ALL SELECT 'segmentation', NULL, frame, det, NULL, round(conf, 6) FROM ({'SELECT * FROM (WITH ' + Q.DET + ' SELECT * FROM det)'})")
def so02_both_pipelines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two pipelines in one table; what a pipeline lacks is NULL."""
    pose = registry.build("pose", spark, d).select(F.lit("pose").alias("pipeline"), "session", "frame", "track_id", F.col("kp")[0]["conf"].alias("nose_conf"))
    seg = registry.build("segmentation", spark, d).select(F.lit("segmentation").alias("pipeline"), "frame", F.col("det").alias("track_id"), r6("conf").alias("conf"))
    return pose.unionByName(seg, allowMissingColumns=True)


@query(f"WITH {Q.SIG}, m AS (SELECT DISTINCT track_id, track_id - track_id % 3 AS canonical FROM sig WHERE track_id % 2 = 0) SELECT session, coalesce(canonical, track_id) AS person_id, frame, count(*) AS n FROM sig LEFT JOIN m USING (track_id) GROUP BY ALL")
def jn21_id_remap(spark: SparkSession, d: str) -> DataFrame:
    sig = A.signal(spark, d)
    remap = sig.select("track_id").distinct().filter("track_id % 2 = 0").select("track_id", (F.col("track_id") - F.col("track_id") % 3).alias("canonical"))
    named = sig.join(remap, "track_id", "left").withColumn("person_id", F.coalesce("canonical", "track_id"))
    return named.groupBy("session", "person_id", "frame").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {Q.SIG}, a AS (SELECT track_id // 2 AS pair, frame, v FROM sig WHERE track_id % 2 = 0), b AS (SELECT track_id // 2 AS pair, frame, v FROM sig WHERE track_id % 2 = 1) SELECT pair, frame, a.v AS v_pose, b.v AS v_seg FROM a JOIN b USING (pair, frame)")
def jn03_zip_streams(spark: SparkSession, d: str) -> DataFrame:
    """Two streams frame by frame, as far as the shorter goes."""
    sig = A.signal(spark, d)
    a, b = (sig.filter(F.col("track_id") % 2 == k).select(F.floor(F.col("track_id") / 2).alias("pair"), "frame", F.col("v").alias(n)) for k, n in enumerate(("v_pose", "v_seg")))
    return a.join(b, ["pair", "frame"])


_TOL = 3600 * 24


@query(f"""WITH l AS (SELECT user_id, event_id, epoch(ts) AS t FROM events WHERE user_id % 2 = 0), r AS (SELECT user_id // 2 AS g, event_id AS other, epoch(ts) AS rt FROM events WHERE user_id % 2 = 1),
j AS (SELECT l.event_id, l.t, r.other, r.rt FROM l LEFT JOIN r ON r.g = l.user_id // 2 AND r.rt <= l.t AND l.t - r.rt <= {_TOL}) SELECT event_id, arg_max(other, (rt, other)) AS other_id, round(max(t - rt) FILTER (FALSE), 3) AS unused FROM j GROUP BY event_id""".replace(", round(max(t - rt) FILTER (FALSE), 3) AS unused", ""))
def jn24_as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each event the last one of the leader at or before it, within a tolerance: one sort over both streams."""
    from gaitline.operators.temporal import as_of

    ev = A.read(spark, d, "events").select(F.floor(F.col("user_id") / 2).cast("long").alias("g"), "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    left = ev.filter("user_id % 2 = 0").select("g", "event_id", "t")
    right = ev.filter("user_id % 2 = 1").select("g", F.col("event_id").alias("other_id"), "t")
    return as_of(left, right, ["g"], "t", "other_id", _TOL * 1_000_000).select("event_id", "other_id")
