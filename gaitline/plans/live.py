"""The live table: a row for each frame of a full window, with every block of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaitline.functions import face_hand as H
from gaitline.functions import geometry as G
from gaitline.functions.skeleton import HAND_CURLS, JOINT_ANGLES, KP
from gaitline.operators import live, motion
from gaitline.operators.ingest import prefixed
from gaitline.sources import adapters as A

from . import pose
from . import sqltext as Q
from .appearance import _ear, _h, _HEADX, _MW, _p
from .catalog import ORACLES, query
from .pose import FPS, ROWS, WINDOW_S, dft, r6, rounded

#: Tip of the index finger in the published hand layout; scale of energies in results.
TIP, SCALE = 8, 987654321.0
WINDOW = live.Window(ROWS, FPS, WINDOW_S, activity=3e8, blink=0.9)
_KEYS = ["session", "track_id", "frame"]


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints with the face and the hand of the same track where there are any. Hands are left or right by turns of three."""
    e = F.col("event_id")
    angles = [((e * a) % m - h).cast("double") for a, m, h in ((17, 121, 60), (13, 81, 40), (7, 61, 30))]
    face = A.faces(spark, d).select("session", "frame", F.col("face_idx").alias("track_id"), *(x.alias(n) for x, n in zip(angles, ("yaw", "pitch", "roll"))), *(c.alias(n) for n, c in H.face_signals(F.col("lm")).items()))
    lm, left = F.col("lm"), e % 3 == 0
    own = {"hand_openness": H.hand_openness(lm), **H.finger_curls(lm), "tip": lm[TIP]}
    hand = A.hands(spark, d).select("session", "frame", F.col("hand_idx").alias("track_id"), left.alias("left"), *(c.alias(n) for n, c in own.items()))
    sides = {"left": F.col("left"), "right": ~F.col("left")}
    hand = hand.select(*_KEYS, *(F.when(sides[s], F.col(n)).alias(f"{s}_{n}") for s in live.SIDES for n in own))
    return A.keypoints(spark, d).join(face, _KEYS, "left").join(hand, _KEYS, "left")


def attention(df: DataFrame) -> DataFrame:
    """session, track_id, frame, attention_target, attention_score: in frames with exactly two faces of a scene (two tracks by turns)."""
    seen = df.filter("yaw is not null").select(*_KEYS, "yaw", G.head_center(F.col("kp"))["x"].alias("x"), F.floor(F.col("track_id") / 2).alias("scene"))
    one = W.partitionBy("scene", "frame").orderBy("track_id")
    both = W.partitionBy("scene", "frame")
    other = lambda c: F.coalesce(F.lead(c).over(one), F.lag(c).over(one))
    two = seen.select(*_KEYS, "yaw", "x", other("track_id").alias("attention_target"), other("x").alias("ox"), F.count(F.lit(1)).over(both).alias("n")).filter("n = 2")
    return two.select(*_KEYS, "attention_target", H.joint_attention(F.col("x"), F.col("yaw"), F.col("ox"), float(A.WIDTH)).alias("attention_score"))


def _rolled(name: str, source: str, steps: int, columns: str) -> str:
    """SQL: spectral score of each window of `steps` values of source(track_id, j, x, frame), told at the frame of its last."""
    return f"""{name}_w AS MATERIALIZED (SELECT track_id, e, row_number() OVER (PARTITION BY track_id, e ORDER BY j) - 1 AS i, count(*) OVER (PARTITION BY track_id, e) AS n, coalesce(x - avg(x) OVER (PARTITION BY track_id, e), 0) AS x FROM (SELECT track_id, j, x, unnest(generate_series(j, j + {steps - 1})) AS e FROM {source})),
{name}_f AS (SELECT * FROM {name}_w WHERE n = {steps}), {dft(f'{name}_f', 'track_id, e', FPS).replace('tot AS', f'{name}_tot AS').replace('bins AS', f'{name}_bins AS').replace('FROM bins', f'FROM {name}_bins').replace('spec AS', f'{name}_spec AS').replace('FROM spec', f'FROM {name}_spec').replace('pk AS', f'{name}_pk AS').replace('FROM tot LEFT JOIN pk', f'FROM {name}_tot LEFT JOIN {name}_pk').replace('SELECT track_id, e, n, CASE', f', {name}_out AS (SELECT track_id, e, n, CASE')}),
{name} AS (SELECT s.track_id, s.frame, peak_freq_hz AS {columns}freq_hz, peak_power_ratio AS {columns}power_ratio FROM {name}_out o JOIN {source} s ON s.track_id = o.track_id AND s.j = o.e)"""


def _sparse(name: str, value: str, columns: str) -> str:
    """Of the frames that have a value."""
    source = f"{name}_s AS MATERIALIZED (SELECT track_id, frame, {value} AS x, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS j FROM fc WHERE {value} IS NOT NULL)"
    return f"{source}, {_rolled(name, f'{name}_s', ROWS, columns)}"


def _hand(side: str, rule: str) -> str:
    """Speed of the index finger's tip between the frames that have the hand."""
    x, y = _h(TIP)
    source = f"""{side}_p AS (SELECT track_id, frame, {x} AS x, {y} AS y, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS j FROM kpw WHERE x10 IS NOT NULL AND {rule}),
{side}_s AS MATERIALIZED (SELECT * FROM (SELECT track_id, frame, j - 1 AS j, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) * {FPS}e0 AS x FROM {side}_p WINDOW w AS (PARTITION BY track_id ORDER BY frame)) WHERE j >= 0)"""
    return f"{source}, {_rolled(f'{side}_h', f'{side}_s', ROWS - 1, f'{side}_hand_rep_')}"


_WRIST = f"wr_s AS MATERIALIZED (SELECT track_id, frame, frame - 1 AS j, (s{KP['left_wrist']} + s{KP['right_wrist']}) / 2 AS x FROM sp WHERE frame > 0)"
_EYES = f"(CASE WHEN {_ear(H.LEFT_EYE)} IS NULL THEN {_ear(H.RIGHT_EYE)} WHEN {_ear(H.RIGHT_EYE)} IS NULL THEN {_ear(H.LEFT_EYE)} ELSE ({_ear(H.LEFT_EYE)} + {_ear(H.RIGHT_EYE)}) / 2 END)"
_MOUTH = f"(CASE WHEN {_MW} >= 1e-6 THEN {Q.dist(_p(H.MOUTH[0]), _p(H.MOUTH[1]))} / {_MW} END)"
_FACE = f"""fc AS MATERIALIZED (SELECT session, track_id, frame, event_id, {_HEADX} AS hx, CAST((event_id * 17) % 121 - 60 AS DOUBLE) AS yaw, CAST((event_id * 13) % 81 - 40 AS DOUBLE) AS pitch, CAST((event_id * 7) % 61 - 30 AS DOUBLE) AS roll, {_MOUTH} AS mouth, {_EYES} AS eye FROM kpw WHERE {_HEADX} IS NOT NULL),
an AS (SELECT *, count(*) OVER (PARTITION BY track_id // 2, frame) AS people FROM fc),
at_ AS (SELECT a.track_id, a.frame, b.track_id AS attention_target, round(greatest(0e0, 1 - abs(a.yaw - (b.hx - a.hx) / {A.WIDTH / 2}e0 * 30) / 20), 9) AS attention_score FROM an a JOIN an b ON a.track_id // 2 = b.track_id // 2 AND a.frame = b.frame AND a.track_id <> b.track_id WHERE a.people = 2),
bl AS (SELECT track_id, frame, CASE WHEN full_ = {ROWS} THEN n / {WINDOW_S}e0 * 60 END AS rate FROM (SELECT *, sum(edge) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN {ROWS - 2} PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW) AS full_ FROM (SELECT track_id, frame, CASE WHEN eye < {WINDOW.blink}e0 AND NOT lag(eye < {WINDOW.blink}e0) OVER (PARTITION BY track_id ORDER BY frame) THEN 1 ELSE 0 END AS edge FROM fc WHERE eye IS NOT NULL))),
blink AS (SELECT track_id, frame, last_value(rate IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame) AS blink_rate_per_min FROM fc LEFT JOIN bl USING (track_id, frame))"""
_POSTURE = f"ps AS (SELECT track_id, frame, (max({Q.HIP[1]}) OVER w - min({Q.HIP[1]}) OVER w) / avg(CASE WHEN {Q.TORSO} > 1e-6 THEN {Q.TORSO} END) OVER w AS vertical_excursion FROM kpw WINDOW w AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW))"
_TOUCHED = f"tc AS (SELECT k.track_id, k.frame, last_value(x.self_touch_ratio IGNORE NULLS) OVER (PARTITION BY k.track_id ORDER BY k.frame) AS self_touch_ratio FROM kpw k LEFT JOIN ({ORACLES['wn06_self_touch_window']}) x ON x.track_id = k.track_id AND x.frame = k.frame)"
_FACE_SIGNALS = ORACLES["sc13_face_signals"]
_HANDS = ORACLES["sc16_hand_signals"]
_SIDE = {"left": "event_id % 3 = 0", "right": "event_id % 3 <> 0"}
_HAND_COLUMNS = ", ".join(f"CASE WHEN k.{rule} THEN hs.{n} END AS {s}_{'hand_' if n == 'openness' else ''}{n}" for s, rule in _SIDE.items() for n in (*(f"{f}_curl" for f in HAND_CURLS), "openness"))
_ENERGY = ORACLES["ag05_live_energy"]


@query(f"""WITH {pose._SPEEDS}, {_FACE}, {_POSTURE}, {_TOUCHED}, {_WRIST}, {_rolled('wr', 'wr_s', ROWS - 1, 'peak_')}, {_sparse('ys', 'yaw', 'yaw_rep_')}, {_sparse('pt', 'pitch', 'pitch_rep_')}, {_sparse('ms', 'mouth', 'mouth_rep_')}, {_hand('left', _SIDE['left'])}, {_hand('right', _SIDE['right'])},
gated AS (SELECT * FROM kpw WHERE frame >= {ROWS - 1}), {pose.clinical_sql('gated')}
SELECT k.session, k.track_id, k.frame, e.window_energy AS movement_energy, e.activity AS activity_ratio, wr.peak_freq_hz, wr.peak_power_ratio, round(ps.vertical_excursion, 6) AS vertical_excursion, tc.self_touch_ratio, sc.self_touch AS self_touch_now, {', '.join(f'ja.{n}' for n in JOINT_ANGLES)},
fc.yaw AS head_yaw, fc.pitch AS head_pitch, fc.roll AS head_roll, at_.attention_target, CASE WHEN fc.yaw IS NOT NULL THEN coalesce(at_.attention_score, 0e0) END AS attention_score, fs.mouth_ratio, fs.left_eyebrow_raise, fs.right_eyebrow_raise, blink.blink_rate_per_min,
CASE WHEN fc.yaw IS NOT NULL THEN ms.mouth_rep_freq_hz END AS mouth_rep_freq_hz, ms.mouth_rep_power_ratio, ys.yaw_rep_freq_hz, ys.yaw_rep_power_ratio, pt.pitch_rep_freq_hz, pt.pitch_rep_power_ratio, {_HAND_COLUMNS}, {', '.join(f'{s}_h.{s}_hand_rep_{x}' for s in _SIDE for x in ('freq_hz', 'power_ratio'))}, {', '.join(f'cl.{c} AS clinical_{c}' for c in pose.CLINICAL)}
FROM gated k JOIN ({_ENERGY}) e ON e.track_id = k.track_id AND e.frame = k.frame JOIN cl ON cl.track_id = k.track_id AND cl.frame = k.frame JOIN ({ORACLES['sc02_joint_angles']}) ja ON ja.track_id = k.track_id AND ja.frame = k.frame JOIN ({ORACLES['sc04_self_touch']}) sc ON sc.track_id = k.track_id AND sc.frame = k.frame
JOIN ps ON ps.track_id = k.track_id AND ps.frame = k.frame JOIN tc ON tc.track_id = k.track_id AND tc.frame = k.frame LEFT JOIN wr ON wr.track_id = k.track_id AND wr.frame = k.frame LEFT JOIN fc ON fc.track_id = k.track_id AND fc.frame = k.frame LEFT JOIN at_ ON at_.track_id = k.track_id AND at_.frame = k.frame
LEFT JOIN ({_FACE_SIGNALS}) fs ON fs.face_idx = k.track_id AND fs.frame = k.frame LEFT JOIN blink ON blink.track_id = k.track_id AND blink.frame = k.frame LEFT JOIN ms ON ms.track_id = k.track_id AND ms.frame = k.frame LEFT JOIN ys ON ys.track_id = k.track_id AND ys.frame = k.frame LEFT JOIN pt ON pt.track_id = k.track_id AND pt.frame = k.frame
LEFT JOIN ({_HANDS}) hs ON hs.hand_idx = k.track_id AND hs.frame = k.frame LEFT JOIN left_h ON left_h.track_id = k.track_id AND left_h.frame = k.frame LEFT JOIN right_h ON right_h.track_id = k.track_id AND right_h.frame = k.frame""")
def str01_live_rows(spark: SparkSession, d: str) -> DataFrame:
    """All blocks: body, windows, face, attention, hands, clinical columns (derivatives begin with the first full window).

    The mouth's window is told where the mouth is, as in the SQL; live.windowed() tells it wherever the face is.
    """
    df = rows(spark, d)
    head, touch = G.joint_angles(F.col("kp")), G.self_touch_now(F.col("kp"))
    now = {"head_yaw": "yaw", "head_pitch": "pitch", "head_roll": "roll", "mouth_now": "mouth_ratio"}
    brows = ["left_eyebrow_raise", "right_eyebrow_raise"]
    hand = [f"{s}_{n}" for s in live.SIDES for n in (*(f"{f}_curl" for f in HAND_CURLS), "hand_openness")]
    base = df.withColumns({"self_touch_now": touch, **head, **{k: F.col(v) for k, v in now.items()}})
    keep = ["self_touch_now", *head, *now, *brows, *hand, "t_s", "kp"]
    out = live.windowed(live.signals(base, *_KEYS, *keep), WINDOW, keep=keep).filter("full")
    out = out.withColumns({c: F.when(F.col("mouth_now").isNotNull(), F.col(c)) for c in ("mouth_rep_freq_hz", "mouth_rep_power_ratio")})
    clinical = prefixed(motion.clinical(out.select(*_KEYS, "t_s", "kp")).select(*_KEYS, *(r6(F.col(c) / 1e3 if c.endswith(("_vel", "_acc")) else c).alias(c) for c in pose.CLINICAL)), "clinical_", *_KEYS)
    out = out.drop("kp", "t_s", "full").join(clinical, _KEYS).join(attention(df), _KEYS, "left")
    out = out.withColumn("movement_energy", F.col("movement_energy") / SCALE).withColumn("attention_score", F.when(F.col("head_yaw").isNotNull(), F.coalesce("attention_score", F.lit(0.0))))
    exact = {*_KEYS, "attention_target", "attention_score"}
    return out.select(*((rounded(c, 9) if c == "attention_score" else F.col(c) if c in exact else r6(c)).alias("mouth_ratio" if c == "mouth_now" else c) for c in out.columns))
