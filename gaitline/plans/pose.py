"""Queries over keypoints: geometry, motion, windows, spectra, synchrony, clinical features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitline.functions import geometry as G
from gaitline.functions.skeleton import BLAZEPOSE_OF_COCO, CLINICAL_MOVING, CLINICAL_POINTS, COCO17, HEAD, JOINT_ANGLES, KP, LIMBS, SIGNATURE
from gaitline.operators import motion, spectral
from gaitline.sources import adapters as A

from . import sqltext as Q
from .catalog import query

FPS, WINDOW_S = A.FPS, 2.0
ROWS = motion.window_rows(WINDOW_S, FPS)
#: Squared units a second, of the adapters' scale, that one energy unit stands for in results.
MEGA = 1e6
TRACK = list(motion.TRACK)


def rounded(x: Column | str, digits: int) -> Column:
    """A double rounded as the SQL rounds: x * 10^digits to the nearest whole number, halves away from zero. F.round takes the
    shortest decimal of x instead, and so rounds 2.0265625 up, whose double times 10^6 is less than a half above 2026562.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def r6(x: Column | str) -> Column:
    return rounded(x, 6)


def s6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


# --- the flagship --------------------------------------------------------------------------------------------


@query(f"""WITH {Q.SIG}, st AS (SELECT *, (v - lag(v) OVER w) * (v - lag(v) OVER w) * {FPS ** 2}e0 AS step FROM sig WINDOW w AS (PARTITION BY session, track_id ORDER BY frame)),
win AS (SELECT session, track_id, frame, avg(step) OVER s AS e, avg(CASE WHEN step IS NULL THEN NULL WHEN step > 2e5 THEN 1e0 ELSE 0e0 END) OVER s AS a, count(*) OVER f AS c FROM st
WINDOW s AS (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN {ROWS - 2} PRECEDING AND CURRENT ROW), f AS (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW))
SELECT session, track_id, frame, round(e / 1e6, 6) AS window_energy, round(a, 6) AS activity FROM win WHERE c = {ROWS}""")
def motion_window(spark: SparkSession, d: str) -> DataFrame:
    """Events as ordered signals -> squared speed -> sliding energy and activity of full windows."""
    sig = A.signal(spark, d).withColumn("before", F.lag("v").over(motion.track()))
    step = (F.col("v") - F.col("before")) * (F.col("v") - F.col("before")) * FPS**2
    out = motion.sliding(sig, step, ROWS, 2e5)
    return out.select("session", "track_id", "frame", r6(F.col("window_energy") / MEGA).alias("window_energy"), r6("activity").alias("activity"))


# --- sources and frames -----------------------------------------------------------------------------------------


@query(f"""WITH {Q.KPW} SELECT session, track_id, frame, round(t_s, 6) AS t_s, CAST({' + '.join(f'(x{k} IS NOT NULL)::INT' for k in range(17))} AS BIGINT) AS joints,
{' + '.join(f'coalesce(x{k}, 0)' for k in range(17))} AS sum_x, {' + '.join(f'coalesce(y{k}, 0)' for k in range(17))} AS sum_y FROM kpw""")
def src01_keypoints(spark: SparkSession, d: str) -> DataFrame:
    held = F.filter("kp", lambda p: p["x"].isNotNull())
    total = lambda axis: F.aggregate(held, F.lit(0.0), lambda s, p: s + p[axis])
    return A.keypoints(spark, d).select("session", "track_id", "frame", r6("t_s").alias("t_s"), F.size(held).cast("long").alias("joints"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query(f"WITH {Q.KPW} SELECT session, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames, round(avg(y{KP['nose']}), 6) AS nose_y FROM kpw WHERE session = 3 GROUP BY session, track_id")
def src10_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return A.keypoints(spark, d).filter("session = 3").groupBy(*TRACK).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("frames"), r6(F.avg(F.col("kp")[0]["y"])).alias("nose_y"))


# --- scalar geometry -------------------------------------------------------------------------------------------


@query(f"WITH {Q.KPW} SELECT session, track_id, frame, {', '.join(s6(Q.angle(*(Q.joint(j) for j in t)), n) for n, t in JOINT_ANGLES.items())} FROM kpw")
def sc02_joint_angles(spark: SparkSession, d: str) -> DataFrame:
    return A.keypoints(spark, d).select("session", "track_id", "frame", *(r6(c).alias(n) for n, c in G.joint_angles(F.col("kp")).items()))


@query(f"WITH {Q.KPW} SELECT session, track_id, frame, {Q.HIP[0]} AS hip_x, {Q.HIP[1]} AS hip_y, {s6(Q.TORSO, 'torso')} FROM kpw")
def sc03_hip_and_torso(spark: SparkSession, d: str) -> DataFrame:
    hip = G.hip_center(F.col("kp"))
    return A.keypoints(spark, d).select("session", "track_id", "frame", hip["x"].alias("hip_x"), hip["y"].alias("hip_y"), r6(G.torso_length(F.col("kp"))).alias("torso"))


_HX, _HY = (f"list_avg(list_filter([{', '.join(f'{a}{KP[n]}' for n in HEAD)}], lambda v: v IS NOT NULL))" for a in "xy")
_TOUCH = {s: f"(CASE WHEN torso >= 1e-6 AND {Q.dist(Q.joint(f'{s}_wrist'), ('hx', 'hy'))} IS NOT NULL THEN greatest(0e0, 1 - {Q.dist(Q.joint(f'{s}_wrist'), ('hx', 'hy'))} / torso) END)" for s in ("left", "right")}


@query(f"WITH {Q.KPW}, h AS (SELECT *, {_HX} AS hx, {_HY} AS hy, {Q.TORSO} AS torso FROM kpw) SELECT session, track_id, frame, {s6('hx', 'head_x')}, {s6('hy', 'head_y')}, {s6(f'greatest({_TOUCH['left']}, {_TOUCH['right']})', 'self_touch')} FROM h")
def sc04_self_touch(spark: SparkSession, d: str) -> DataFrame:
    head = G.head_center(F.col("kp"))
    return A.keypoints(spark, d).select("session", "track_id", "frame", r6(head["x"]).alias("head_x"), r6(head["y"]).alias("head_y"), r6(G.self_touch_now(F.col("kp"))).alias("self_touch"))


_NORM = ", ".join(f"CASE WHEN torso >= 1e-3 THEN ({Q.clinical(n)[k]} - {Q.HIP[k]}) / torso END AS {n}_{a}" for n in CLINICAL_POINTS for k, a in enumerate("xy"))
_DER = Q.clinical_derived()
_MOVING = [f"{n}_{a}" for n in CLINICAL_MOVING for a in "xy"]


def clinical_sql(source: str = "kpw") -> str:
    """SQL of the clinical columns over rows of joints."""
    return (
        f"t AS (SELECT *, {Q.TORSO} AS torso FROM {source}), n AS (SELECT session, track_id, frame, t_s, {_NORM} FROM t), "
        f"dv AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _DER.items())} FROM n), "
        f"v AS (SELECT *, {', '.join(f'({m} - lag({m}) OVER w) / greatest(t_s - lag(t_s) OVER w, 1e-3) AS {m}_vel' for m in _MOVING)}, t_s - lag(t_s) OVER w AS dt FROM dv WINDOW w AS (PARTITION BY session, track_id ORDER BY frame)), "
        f"cl AS (SELECT session, track_id, frame, {', '.join(s6(f'{n}_{a}', f'{n}_{a}') for n in CLINICAL_POINTS for a in 'xy')}, {', '.join(s6(k, k) for k in _DER)}, "
        f"{', '.join(s6(f'{m}_vel / 1e3', f'{m}_vel') for m in _MOVING)}, {', '.join(s6(f'(({m}_vel - lag({m}_vel) OVER w) / greatest(dt, 1e-3)) / 1e3', f'{m}_acc') for m in _MOVING)} FROM v WINDOW w AS (PARTITION BY session, track_id ORDER BY frame))"
    )


CLINICAL = [f"{n}_{a}" for n in CLINICAL_POINTS for a in "xy"] + list(_DER) + [f"{m}_{k}" for m in _MOVING for k in ("vel", "acc")]


def clinical_rounded(kp: DataFrame) -> DataFrame:
    out = motion.clinical(kp)
    return out.select("session", "track_id", "frame", *(r6(F.col(c) / 1e3 if c.endswith(("_vel", "_acc")) else c).alias(c) for c in CLINICAL))


@query(f"WITH {Q.KPW}, {clinical_sql()} SELECT * FROM cl")
def sc08_clinical_features(spark: SparkSession, d: str) -> DataFrame:
    """All 97 columns; velocities and accelerations in thousands of torso lengths."""
    return clinical_rounded(A.keypoints(spark, d))


@query(f"WITH {Q.KPW} SELECT session, track_id, frame, {', '.join(f'10e0 + x{k} / {A.WIDTH} * 100e0 AS px{k}, 20e0 + y{k} / {A.HEIGHT} * 200e0 AS py{k}' for k in (0, 9, 16))} FROM kpw")
def jn22_landmark_remap(spark: SparkSession, d: str) -> DataFrame:
    """33 crop-relative landmarks to 17 joints in pixels of the frame."""
    from gaitline.operators.ingest import blazepose_to_coco

    kp = A.keypoints(spark, d)
    unit = F.transform("kp", lambda p: F.struct((p["x"] / A.WIDTH).alias("x"), (p["y"] / A.HEIGHT).alias("y"), p["conf"].alias("visibility")))
    wide = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda k: F.element_at(F.col("unit"), F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, BLAZEPOSE_OF_COCO)), k).cast("int"))))
    out = kp.withColumn("unit", unit).withColumn("lm", wide).withColumn("kp", blazepose_to_coco(F.col("lm"), F.lit(10.0), F.lit(20.0), F.lit(100.0), F.lit(200.0)))
    return out.select("session", "track_id", "frame", *(F.col("kp")[k][a].alias(f"p{a}{k}") for k in (0, 9, 16) for a in "xy"))


@query(f"WITH {Q.KPW} SELECT session, track_id, frame, {', '.join(s6(f'CASE WHEN {Q.TORSO} >= 1e-6 THEN {Q.dist(Q.joint(a), Q.joint(b))} / {Q.TORSO} END', n) for n, (a, b) in SIGNATURE.items())} FROM kpw")
def sc23_signature_frame(spark: SparkSession, d: str) -> DataFrame:
    kp = A.keypoints(spark, d).withColumn("s", G.signature(F.col("kp")))
    return kp.select("session", "track_id", "frame", *(r6(F.col("s")[k]).alias(n) for k, n in enumerate(SIGNATURE)))


_XS, _YS = (f"list_filter([{', '.join(f'{a}{k}' for k in range(17))}], lambda v: v IS NOT NULL)" for a in "xy")


@query(f"""WITH {Q.KPW}, b AS (SELECT *, list_min({_XS}) AS lx, list_max({_XS}) AS hx, list_min({_YS}) AS ly, list_max({_YS}) AS hy, len({_XS}) AS n FROM kpw)
SELECT session, track_id, frame, {', '.join(f'CASE WHEN n >= 4 AND hx - lx >= 1e-6 AND hy - ly >= 1e-6 THEN {e} END AS {c}' for c, e in (('bx1', 'lx - 0.25e0 * (hx - lx)'), ('by1', 'ly - 0.25e0 * (hy - ly)'), ('bx2', 'hx + 0.25e0 * (hx - lx)'), ('by2', 'hy + 0.25e0 * (hy - ly)')))} FROM b""")
def sc28_bbox_from_keypoints(spark: SparkSession, d: str) -> DataFrame:
    box = A.keypoints(spark, d).withColumn("b", G.padded_box(F.col("kp")))
    return box.select("session", "track_id", "frame", *(F.col("b")[c].alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))


_CONF = {a: f"list_avg(list_filter([{', '.join(f'CASE WHEN c{KP[n]} >= 3e-1 THEN {a}{KP[n]} END' for n in HEAD)}], lambda v: v IS NOT NULL))" for a in "xy"}
_SHW = Q.dist(Q.joint("left_shoulder"), Q.joint("right_shoulder"))


@query(f"""WITH {Q.KPW}, h AS (SELECT *, {_CONF['x']} AS hx, {_CONF['y']} AS hy, CASE WHEN {_SHW} >= 1e-3 THEN 6e-1 * {_SHW} ELSE 40e0 END AS rad FROM kpw),
g AS (SELECT session, track_id, frame, rad, CAST(floor(hx) AS INT) AS cx, CAST(floor(hy) AS INT) AS cy, greatest(CAST(floor(rad) AS INT), 10) AS r FROM h),
q AS (SELECT *, greatest(0, cx - r) AS x0, greatest(0, cy - r) AS y0, least({A.WIDTH}, cx + r) AS x1, least({A.HEIGHT}, cy + r) AS y1 FROM g WHERE cx IS NOT NULL)
SELECT session, track_id, frame, round(rad, 6) AS radius, x0, y0, x1, y1 FROM q WHERE x1 > x0 AND y1 > y0""")
def sc34_face_region(spark: SparkSession, d: str) -> DataFrame:
    out = A.keypoints(spark, d).withColumn("f", G.face_region(F.col("kp"), A.WIDTH, A.HEIGHT)).filter("f is not null")
    return out.select("session", "track_id", "frame", r6(G.head_radius(F.col("kp"))).alias("radius"), "f.*")


# --- motion -------------------------------------------------------------------------------------------------


_SP = ", ".join(f"sqrt((x{k} - lag(x{k}) OVER w) * (x{k} - lag(x{k}) OVER w) + (y{k} - lag(y{k}) OVER w) * (y{k} - lag(y{k}) OVER w)) * {FPS}e0 AS s{k}" for k in range(17))
_SPEEDS = f"{Q.KPW}, sp AS (SELECT session, track_id, frame, {_SP} FROM kpw WINDOW w AS (PARTITION BY session, track_id ORDER BY frame))"
_ENERGY = " + ".join(f"coalesce(s{k} * s{k}, 0)" for k in range(17))


@query(f"WITH {_SPEEDS} SELECT session, track_id, frame, {', '.join(s6(f's{k} / 1e3', f'{n}_speed') for k, n in enumerate(COCO17))} FROM sp")
def wn01_joint_speed(spark: SparkSession, d: str) -> DataFrame:
    out = motion.with_speeds(A.keypoints(spark, d), FPS)
    return out.select("session", "track_id", "frame", *(r6(F.col("speeds")[k] / 1e3).alias(f"{n}_speed") for k, n in enumerate(COCO17)))


@query(f"WITH {_SPEEDS} SELECT session, track_id, frame, {s6(f'({_ENERGY}) / 987654321e0', 'movement_energy')} FROM sp")
def ag01_movement_energy(spark: SparkSession, d: str) -> DataFrame:
    return motion.movement_energy(A.keypoints(spark, d), FPS).select("session", "track_id", "frame", r6(F.col("movement_energy") / 987654321e0).alias("movement_energy"))


_LR = {n: (KP[f"left_{n}"], KP[f"right_{n}"]) for n in LIMBS}


@query(f"WITH {_SPEEDS} SELECT session, track_id, {', '.join(s6(f'abs(avg(s{a}) - avg(s{b})) / CASE WHEN avg(s{a}) + avg(s{b}) > 1e-8 THEN avg(s{a}) + avg(s{b}) END', f'{n}_symmetry') for n, (a, b) in _LR.items())} FROM sp GROUP BY session, track_id")
def ag02_symmetry(spark: SparkSession, d: str) -> DataFrame:
    out = motion.symmetry(A.keypoints(spark, d), FPS)
    return out.select(*TRACK, *(r6(f"{n}_symmetry").alias(f"{n}_symmetry") for n in LIMBS))


@query(f"WITH {Q.KPW} SELECT session, track_id, {s6(f'(max({Q.HIP[1]}) - min({Q.HIP[1]})) / avg(CASE WHEN {Q.TORSO} > 1e-6 THEN {Q.TORSO} END)', 'vertical_excursion')} FROM kpw GROUP BY session, track_id")
def ag03_vertical_excursion(spark: SparkSession, d: str) -> DataFrame:
    return motion.excursion(A.keypoints(spark, d)).select(*TRACK, r6("vertical_excursion").alias("vertical_excursion"))


@query(f"WITH {_SPEEDS} SELECT session, track_id, {s6(f'avg(CASE WHEN ({_ENERGY}) > 3e8 THEN 1e0 ELSE 0e0 END)', 'activity_ratio')} FROM sp GROUP BY session, track_id")
def ag04_activity_ratio(spark: SparkSession, d: str) -> DataFrame:
    e = motion.movement_energy(A.keypoints(spark, d), FPS)
    return motion.activity_ratio(e, F.col("movement_energy"), 3e8).select(*TRACK, r6("activity_ratio").alias("activity_ratio"))


_STRICT = " + ".join(f"s{k} * s{k}" for k in range(17))


@query(f"""WITH {_SPEEDS}, st AS (SELECT session, track_id, frame, {_STRICT} AS step FROM sp), w AS (SELECT *, avg(step) OVER s AS e, avg(CASE WHEN step IS NULL THEN NULL WHEN step > 3e8 THEN 1e0 ELSE 0e0 END) OVER s AS a, count(*) OVER f AS c FROM st
WINDOW s AS (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN {ROWS - 2} PRECEDING AND CURRENT ROW), f AS (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW))
SELECT session, track_id, frame, round(e / 987654321e0, 6) AS window_energy, round(a, 6) AS activity FROM w WHERE c = {ROWS}""")
def ag05_live_energy(spark: SparkSession, d: str) -> DataFrame:
    """The live path's energy: a step with a missing joint is missing."""
    sp = motion.with_speeds(A.keypoints(spark, d), FPS)
    out = motion.sliding(sp, motion.strict_energy(F.col("speeds")), ROWS, 3e8)
    return out.select("session", "track_id", "frame", r6(F.col("window_energy") / 987654321e0).alias("window_energy"), r6("activity").alias("activity"))


@query(f"""WITH {Q.KPW}, h AS (SELECT *, {_HX} AS hx, {_HY} AS hy, {Q.TORSO} AS torso FROM kpw), t AS (SELECT session, track_id, frame, greatest({_TOUCH['left']}, {_TOUCH['right']}) AS touch FROM h),
s AS (SELECT *, avg(CASE WHEN touch > 5e-1 THEN 1e0 ELSE 0e0 END) OVER w AS ratio, count(*) OVER w AS c FROM t WHERE touch IS NOT NULL WINDOW w AS (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW))
SELECT session, track_id, frame, round(ratio, 6) AS self_touch_ratio FROM s WHERE c = {ROWS}""")
def wn06_self_touch_window(spark: SparkSession, d: str) -> DataFrame:
    """Share of touching frames among the last `ROWS` that have a score."""
    seen = A.keypoints(spark, d).select(*TRACK, "frame", G.self_touch_now(F.col("kp")).alias("touch")).filter("touch is not null")
    w = motion.track().rowsBetween(-(ROWS - 1), 0)
    out = seen.select(*TRACK, "frame", F.avg((F.col("touch") > 0.5).cast("double")).over(w).alias("ratio"), F.count(F.lit(1)).over(w).alias("c"))
    return out.filter(F.col("c") == ROWS).select(*TRACK, "frame", r6("ratio").alias("self_touch_ratio"))


@query(f"""WITH {Q.SIG}, c AS (SELECT session, track_id, frame, v < 3e1 AS shut FROM sig), e AS (SELECT *, CASE WHEN shut AND NOT lag(shut) OVER w THEN 1 ELSE 0 END AS edge FROM c WINDOW w AS (PARTITION BY session, track_id ORDER BY frame)),
s AS (SELECT *, sum(edge) OVER a AS n, count(*) OVER b AS full_ FROM e WINDOW a AS (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN {ROWS - 2} PRECEDING AND CURRENT ROW), b AS (PARTITION BY session, track_id ORDER BY frame ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW))
SELECT session, track_id, frame, CAST(n AS DOUBLE) / {WINDOW_S}e0 * 60 AS blink_rate_per_min FROM s WHERE full_ = {ROWS}""")
def ag07_blink_rate(spark: SparkSession, d: str) -> DataFrame:
    return motion.blink_rate(A.signal(spark, d), "v", ROWS, WINDOW_S, 30.0).select(*TRACK, "frame", "blink_rate_per_min")


# --- spectra, pairs of tracks -------------------------------------------------------------------------------


def dft(source: str, keys: str, fps: float) -> str:
    """SQL of the spectral score over source(keys, i, n, x)."""
    turn = f"{2 * math.pi!r} * k * i / n"
    return f"""tot AS (SELECT {keys}, max(n) AS n, (max(n) * sum(x * x) + CASE WHEN max(n) % 2 = 0 THEN power(sum(x * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END), 2) ELSE 0 END) / 2 AS total FROM {source} GROUP BY {keys}),
bins AS (SELECT {keys}, n, i, x, unnest(generate_series(1, n // 2)) AS k FROM {source}),
spec AS (SELECT {keys}, n, k, power(sum(x * cos({turn})), 2) + power(sum(x * sin({turn})), 2) AS p FROM bins WHERE k * {fps}e0 / n >= 5e-1 AND k * {fps}e0 / n <= 8e0 GROUP BY {keys}, n, k),
pk AS (SELECT {keys}, arg_max(k, (p, -k)) AS k, max(p) AS p FROM spec GROUP BY {keys})
SELECT {keys}, n, CASE WHEN n >= 8 AND total >= 1e-12 THEN round(k * {fps}e0 / n, 6) END AS peak_freq_hz, CASE WHEN n >= 8 THEN CASE WHEN total < 1e-12 OR k IS NULL THEN 0e0 ELSE round(p / total, 6) END END AS peak_power_ratio FROM tot LEFT JOIN pk USING ({keys})"""


@query(f"WITH {Q.SIG}, z AS (SELECT session, track_id, row_number() OVER (PARTITION BY session, track_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY session, track_id) AS n, v - avg(v) OVER (PARTITION BY session, track_id) AS x FROM sig), {dft('z', 'session, track_id', FPS)}")
def wn04_spectral_score(spark: SparkSession, d: str) -> DataFrame:
    out = spectral.repetitiveness(A.signal(spark, d), "v", FPS, TRACK)
    return out.select(*TRACK, "n", r6("peak_freq_hz").alias("peak_freq_hz"), r6("peak_power_ratio").alias("peak_power_ratio"))


_HOP = 10


@query(f"""WITH {Q.SIG}, m AS (SELECT *, count(*) OVER (PARTITION BY session, track_id) AS m FROM sig), ww AS (SELECT session, track_id, frame, v, unnest(generate_series(greatest(0, CAST(ceil((frame - {ROWS} + 1) / {_HOP}) AS BIGINT)), frame // {_HOP})) AS w, m FROM m),
u AS (SELECT session, track_id, w * {_HOP} + {ROWS} - 1 AS window_end, frame, v FROM ww WHERE w * {_HOP} + {ROWS} <= m),
z AS (SELECT session, track_id, window_end, row_number() OVER (PARTITION BY session, track_id, window_end ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY session, track_id, window_end) AS n, v - avg(v) OVER (PARTITION BY session, track_id, window_end) AS x FROM u), {dft('z', 'session, track_id, window_end', FPS)}""")
def wn08_sliding_repetitiveness(spark: SparkSession, d: str) -> DataFrame:
    """The score of the raw signed signal, in hopping full windows."""
    out = spectral.sliding_repetitiveness(A.signal(spark, d), "v", FPS, ROWS, _HOP, TRACK)
    return out.select(*TRACK, "window_end", "n", r6("peak_freq_hz").alias("peak_freq_hz"), r6("peak_power_ratio").alias("peak_power_ratio"))


_PAIR = 20


@query(f"""WITH {Q.SIG}, a AS (SELECT track_id // 2 AS pair, frame, v FROM sig WHERE track_id % 2 = 0), b AS (SELECT track_id // 2 AS pair, frame, v FROM sig WHERE track_id % 2 = 1), p AS (SELECT a.pair, a.frame, a.v AS a, b.v AS b, max(a.frame) OVER (PARTITION BY a.pair) + 1 AS n FROM a JOIN b USING (pair, frame)),
w AS (SELECT pair, a, b, n, unnest(generate_series(greatest(0, CAST(ceil((frame - {ROWS} + 1) / 5) AS BIGINT)), frame // 5)) * 5 AS frame_start FROM p)
SELECT pair, frame_start, frame_start + {ROWS} AS frame_end, round(CASE WHEN stddev_pop(a) >= 1e-8 AND stddev_pop(b) >= 1e-8 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS synchrony FROM w WHERE frame_start + {ROWS} <= n GROUP BY pair, frame_start""")
def wn03_synchrony(spark: SparkSession, d: str) -> DataFrame:
    """Of the tracks two by two."""
    sig = A.signal(spark, d).withColumn("pair", F.floor(F.col("track_id") / 2))
    a, b = (sig.filter(F.col("track_id") % 2 == k) for k in (0, 1))
    return motion.synchrony(a, b, ROWS, 5, ("pair",)).withColumn("synchrony", r6("synchrony"))


@query(f"WITH {Q.KPW}, h AS (SELECT track_id // 2 AS pair, track_id % 2 AS t, frame, {Q.HIP[0]} AS hx, {Q.HIP[1]} AS hy FROM kpw) SELECT a.pair, a.frame, {s6(Q.dist(('a.hx', 'a.hy'), ('b.hx', 'b.hy')), 'proximity')} FROM h a JOIN h b ON a.pair = b.pair AND a.frame = b.frame WHERE a.t = 0 AND b.t = 1")
def jn01_proximity(spark: SparkSession, d: str) -> DataFrame:
    kp = A.keypoints(spark, d).withColumn("pair", F.floor(F.col("track_id") / 2))
    a, b = (kp.filter(F.col("track_id") % 2 == k) for k in (0, 1))
    return motion.proximity(a, b, ("pair",)).withColumn("proximity", r6("proximity"))


@query(f"WITH RECURSIVE {Q.SIG}, e(session, track_id, frame, ema) AS (SELECT session, track_id, frame, v FROM sig WHERE frame = 0 UNION ALL SELECT s.session, s.track_id, s.frame, 9e-1 * e.ema + (1 - 9e-1) * s.v FROM e JOIN sig s ON s.track_id = e.track_id AND s.frame = e.frame + 1) SELECT session, track_id, round(arg_max(ema, frame), 6) AS ema FROM e GROUP BY session, track_id")
def wn16_ema(spark: SparkSession, d: str) -> DataFrame:
    return motion.ema(A.signal(spark, d), "v", 0.9).select(*TRACK, r6("ema").alias("ema"))


@query(f"""WITH {_SPEEDS}, en AS (SELECT session, track_id, frame, {_ENERGY} AS energy FROM sp), sy AS (SELECT session, track_id, {', '.join(f'abs(avg(s{a}) - avg(s{b})) / CASE WHEN avg(s{a}) + avg(s{b}) > 1e-8 THEN avg(s{a}) + avg(s{b}) END AS {n}_symmetry' for n, (a, b) in _LR.items())} FROM sp GROUP BY session, track_id),
an AS (SELECT session, track_id, frame, {', '.join(f'{Q.angle(*(Q.joint(j) for j in t))} AS {n}' for n, t in JOINT_ANGLES.items())} FROM kpw)
SELECT session, track_id, frame, {', '.join(s6(n, n) for n in JOINT_ANGLES)}, {s6('energy / 987654321e0', 'movement_energy')}, {', '.join(s6(f'{n}_symmetry', f'{n}_symmetry') for n in LIMBS)} FROM an JOIN en USING (session, track_id, frame) JOIN sy USING (session, track_id)""")
def batch_pose_features(spark: SparkSession, d: str) -> DataFrame:
    """The batch table: angles and energy by frame, symmetry by track."""
    e = motion.movement_energy(A.keypoints(spark, d), FPS)
    named = e.select(*TRACK, "frame", *(r6(c).alias(n) for n, c in G.joint_angles(F.col("kp")).items()), r6(F.col("movement_energy") / 987654321e0).alias("movement_energy"))
    sym = motion.symmetry(A.keypoints(spark, d), FPS)
    return named.join(sym.select(*TRACK, *(r6(f"{n}_symmetry").alias(f"{n}_symmetry") for n in LIMBS)), TRACK)
