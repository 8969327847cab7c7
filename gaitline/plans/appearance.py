"""Queries on appearance, faces, hands, fragments, re-identification, files and generic SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaitline.functions import face_hand as H
from gaitline.functions import geometry as G
from gaitline.functions.skeleton import HAND_CURLS, HAND_TIPS, KP, MIDDLE_KNUCKLE, SIGNATURE, WRIST
from gaitline.operators import fragments, matching, motion
from gaitline.sources import adapters as A
from gaitline.sources import files
from gaitline.streaming import reid as R

from . import sqltext as Q
from .catalog import query
from .pose import FPS, r6

# --- similarities ---------------------------------------------------------------------------------------------

_BLOCK_ROWS = 512
_DOT = "list_sum(list_transform(generate_series(1, 64), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a_id < b_id and the dot product of the pairs of two blocks, or of one with itself. Products are added in the order of
    the dimensions, as the SQL adds them; NULL without a vector.
    """
    table = pa.Table.from_batches(batches)
    block, ids = table.column("block").to_numpy(), table.column("vec_id").to_numpy()
    lists = table.column("vec").combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    vec = np.full((len(ids), int(size.max())), np.nan)
    vec[np.arange(vec.shape[1]) < size[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    x, y = (table.column(c)[0].as_py() for c in "xy")
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    across = np.ascontiguousarray(vec[right].T)
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        dot = np.zeros((len(rows), len(right)))
        for k in range(vec.shape[1]):
            dot += vec[rows, k][:, None] * across[k]
        a, b = np.broadcast_to(ids[rows][:, None], dot.shape), np.broadcast_to(ids[right], dot.shape)
        some = a < b if x == y else a != b
        a, b, dot = a[some], b[some], dot[some]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(dot, mask=np.isnan(dot))], ["a_id", "b_id", "dot"])


@query(f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(greatest(0e0, least(1e0, ({_DOT} + 1) / 2)), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def sc30_embedding_similarity(spark: SparkSession, d: str) -> DataFrame:
    """All pairs within a label: its vectors are dealt into blocks of about _BLOCK_ROWS, and two blocks meet in a task."""
    v = A.appearance(spark, d)
    most = v.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-most // _BLOCK_ROWS))
    own = v.filter("vec_id is not null and label is not null").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    # block x meets blocks 0 to x as the one and x to n - 1 as the other
    met = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    sent = own.select("label", "vec_id", "vec", "block", met).select("label", "vec_id", "vec", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    out = sent.repartition("label", "x", "y").groupBy("label", "x", "y").applyInArrow(_block_pairs, "a_id long, b_id long, dot double")
    similarity = F.when(F.col("dot").isNotNull(), G.clip((F.col("dot") + 1.0) / 2.0, 0.0, 1.0))
    return out.select("a_id", "b_id", r6(similarity).alias("similarity"))


_SIGS = ", ".join(f"CASE WHEN {Q.TORSO} >= 1e-6 THEN {Q.dist(Q.joint(a), Q.joint(b))} / {Q.TORSO} END" for a, b in SIGNATURE.values())
_MED = f"{Q.KPW}, sg AS (SELECT session, track_id, frame, [{_SIGS}] AS s FROM kpw), lst AS (SELECT *, row_number() OVER (PARTITION BY session, track_id ORDER BY frame DESC) AS r FROM sg), med AS (SELECT session, track_id, {', '.join(f'median(s[{k + 1}]) AS m{k}' for k in range(12))} FROM lst WHERE r <= 15 GROUP BY session, track_id)"


def _medians(spark: SparkSession, d: str) -> DataFrame:
    """session, track_id, m0..m11: median proportions of each track's last 15 frames."""
    kp = A.keypoints(spark, d).select("session", "track_id", "frame", G.signature(F.col("kp")).alias("s"))
    last = kp.withColumn("r", F.row_number().over(W.partitionBy("session", "track_id").orderBy(F.desc("frame")))).filter("r <= 15")
    return last.groupBy("session", "track_id").agg(*(F.median(F.col("s")[k]).alias(f"m{k}") for k in range(12)))


@query(f"WITH {_MED} SELECT session, track_id, {', '.join(f'round(m{k}, 6) AS {n}' for k, n in enumerate(SIGNATURE))} FROM med")
def ag12_median_signature(spark: SparkSession, d: str) -> DataFrame:
    return _medians(spark, d).select("session", "track_id", *(r6(f"m{k}").alias(n) for k, n in enumerate(SIGNATURE)))


_SQ = " + ".join(f"coalesce((a.m{k} - b.m{k}) * (a.m{k} - b.m{k}), 0)" for k in range(12))
_CNT = " + ".join(f"(a.m{k} IS NOT NULL AND b.m{k} IS NOT NULL)::INT" for k in range(12))


@query(f"WITH {_MED} SELECT a.session, a.track_id AS a_id, b.track_id AS b_id, CASE WHEN {_CNT} >= 3 THEN round(sqrt(({_SQ}) / ({_CNT})), 6) END AS distance FROM med a JOIN med b ON a.session = b.session AND a.track_id < b.track_id")
def sc24_signature_distance(spark: SparkSession, d: str) -> DataFrame:
    m = _medians(spark, d).select("session", "track_id", F.array(*(F.col(f"m{k}") for k in range(12))).alias("s"))
    a, b = (m.select("session", F.col("track_id").alias(f"{x}_id"), F.col("s").alias(f"s{x}")) for x in "ab")
    return a.join(b, "session").filter("a_id < b_id").select("session", "a_id", "b_id", r6(G.signature_distance(F.col("sa"), F.col("sb"))).alias("distance"))


_HUES = [f"CASE WHEN (event_id + {k}) % 11 <> 0 THEN CAST((event_id * {k + 2}) % 97 AS DOUBLE) / 97 END" for k in range(6)]
_COLD = [f"CASE WHEN a.h[{k + 1}] IS NOT NULL AND b.h[{k + 1}] IS NOT NULL THEN " + (f"least(abs(a.h[{k + 1}] - b.h[{k + 1}]), 1 - abs(a.h[{k + 1}] - b.h[{k + 1}]))" if k % 2 == 0 else f"abs(a.h[{k + 1}] - b.h[{k + 1}])") + " END" for k in range(6)]
_COLN = " + ".join(f"({x} IS NOT NULL)::INT" for x in _COLD)
_COLS = " + ".join(f"coalesce({x}, 0)" for x in _COLD)
_PAIRS = f"{Q.KPW}, f AS (SELECT session, track_id, frame, t_s, [{', '.join(_HUES)}] AS h, {Q.HIP[0]} AS hx, {Q.HIP[1]} AS hy, {Q.TORSO} AS torso, event_id FROM kpw), pr AS (SELECT a.session, a.frame, a.track_id AS a_id, b.track_id AS b_id, CASE WHEN (a.event_id + b.event_id) % 5 <> 0 THEN CAST((a.event_id * 31 + b.event_id * 17) % 101 AS DOUBLE) / 100 END AS embedding, CASE WHEN (a.event_id + b.event_id) % 3 <> 0 THEN CAST((a.event_id * 13 + b.event_id * 7) % 97 AS DOUBLE) / 100 END AS shape, CASE WHEN {_COLN} >= 2 THEN greatest(0e0, least(1e0, 1 - ({_COLS}) / ({_COLN}))) END AS color, CASE WHEN (a.torso + b.torso) / 2 >= 1e-6 AND {Q.dist(('a.hx', 'a.hy'), ('b.hx', 'b.hy'))} IS NOT NULL THEN greatest(0e0, 1 - {Q.dist(('a.hx', 'a.hy'), ('b.hx', 'b.hy'))} / ((a.torso + b.torso) / 2) / 4) * greatest(0e0, 1 - (b.t_s - a.t_s) / 20) END AS position FROM f a JOIN f b ON a.session = b.session AND b.frame = a.frame + 6)"


def _frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every sighting of a session against all those six frames later, with the likenesses of the two."""
    e = F.col("event_id")
    hues = F.array(*(F.when((e + k) % 11 != 0, ((e * (k + 2)) % 97).cast("double") / 97) for k in range(6)))
    f = A.keypoints(spark, d).select("session", "track_id", "frame", "t_s", "event_id", hues.alias("h"), G.hip_center(F.col("kp")).alias("hip"), G.torso_length(F.col("kp")).alias("torso"))
    a, b = (f.select("session", (F.col("frame") - back).alias("frame"), *(F.col(c).alias(f"{c}_{x}") for c in ("track_id", "t_s", "event_id", "h", "hip", "torso"))) for x, back in (("a", 0), ("b", 6)))
    both = a.join(b, ["session", "frame"])
    # likenesses of appearance and shape that a model would give, some missing
    p, q = F.col("event_id_a"), F.col("event_id_b")
    embedding = F.when((p + q) % 5 != 0, ((p * 31 + q * 17) % 101).cast("double") / 100)
    shape = F.when((p + q) % 3 != 0, ((p * 13 + q * 7) % 97).cast("double") / 100)
    position = G.position_similarity(F.col("hip_a"), F.col("hip_b"), (F.col("torso_a") + F.col("torso_b")) / 2, F.col("t_s_b") - F.col("t_s_a"))
    return both.select("session", "frame", F.col("track_id_a").alias("a_id"), F.col("track_id_b").alias("b_id"), embedding.alias("embedding"), shape.alias("shape"), G.color_similarity(F.col("h_a"), F.col("h_b")).alias("color"), position.alias("position"))


@query(f"WITH {_PAIRS} SELECT session, frame, a_id, b_id, round(color, 9) AS color, round(position, 9) AS position FROM pr")
def sc26_color_and_position(spark: SparkSession, d: str) -> DataFrame:
    return _frame_pairs(spark, d).drop("embedding", "shape").withColumn("color", F.round("color", 9)).withColumn("position", F.round("position", 9))


_BEST = "greatest(coalesce(5e-1 * color, 0e0), coalesce(5e-1 * position, 0e0), coalesce(7e-1 * embedding, 0e0))"


@query(f"""WITH {_PAIRS}, md AS (SELECT a.session, a.track_id AS a_id, b.track_id AS b_id, CASE WHEN {_CNT} >= 3 THEN sqrt(({_SQ}) / ({_CNT})) END AS dist FROM med a JOIN med b ON a.session = b.session)
SELECT session, frame, a_id, b_id, round(dist * (1 - {_BEST}), 6) AS cost, CASE WHEN dist IS NULL OR {_BEST} = 0 THEN NULL WHEN {_BEST} = coalesce(7e-1 * embedding, 0e0) THEN 'embedding' WHEN {_BEST} = coalesce(5e-1 * color, 0e0) THEN 'color' ELSE 'position' END AS used,
CASE WHEN dist IS NULL OR dist * (1 - {_BEST}) > 5e-1 THEN 'new' WHEN dist * (1 - {_BEST}) <= 2e-1 THEN 'matched' ELSE 'uncertain' END AS status FROM pr JOIN md USING (session, a_id, b_id)""".replace(f"WITH {Q.KPW}, f AS", f"WITH {_MED}, f AS"))
def sc31_pair_cost(spark: SparkSession, d: str) -> DataFrame:
    """Proportions lowered by the strongest other signal, and what the policy makes of it."""
    m = _medians(spark, d).select("session", "track_id", F.array(*(F.col(f"m{k}") for k in range(12))).alias("s"))
    a, b = (m.select("session", F.col("track_id").alias(f"{x}_id"), F.col("s").alias(f"s{x}")) for x in "ab")
    both = _frame_pairs(spark, d).join(a, ["session", "a_id"]).join(b, ["session", "b_id"])
    cost, used = G.pose_pair_cost(G.signature_distance(F.col("sa"), F.col("sb")), F.col("color"), F.col("position"), F.col("embedding"))
    return both.select("session", "frame", "a_id", "b_id", r6(cost).alias("cost"), used.alias("used"), matching.outcome(cost, 0.2, 0.5).alias("status"))


@query(f"WITH {_PAIRS} SELECT session, frame, a_id, b_id, round(5e-1 * coalesce(position, 0) + 3e-1 * coalesce(color, 0) + 2e-1 * coalesce(shape, 0) + 7e-1 * coalesce(embedding, 0), 6) AS score, round(coalesce(greatest(color, position), 0), 6) AS strongest FROM pr")
def sc32_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum of the signals, and the stronger of two."""
    p = _frame_pairs(spark, d)
    return p.select("session", "frame", "a_id", "b_id", r6(G.seg_pair_score(F.col("position"), F.col("color"), F.col("shape"), F.col("embedding"))).alias("score"), r6(G.fragment_similarity(F.col("color"), F.col("position"))).alias("strongest"))


@query("""WITH v AS (SELECT label, vec_id, unnest(generate_series(1, 64)) AS k, embedding FROM embeddings), m AS (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS x FROM v GROUP BY label, k), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, k, round(x / norm, 6) AS x FROM m JOIN n USING (label)""")
def ag13_mean_signature(spark: SparkSession, d: str) -> DataFrame:
    v = A.appearance(spark, d).withColumn("hue", F.lit(None).cast("array<double>"))
    return fragments.finalize(v, ["label"]).select("label", F.posexplode("vec").alias("k", "x")).select("label", (F.col("k") + 1).cast("long").alias("k"), r6("x").alias("x"))


# --- faces and hands -------------------------------------------------------------------------------------------


def _p(k: int) -> Q.Point:
    return f"CAST((event_id * {3 + k} + {7 * k}) % 211 AS DOUBLE)", f"CAST((event_id * {5 + k} + {3 * k}) % 197 AS DOUBLE)"


def _ear(eye: tuple[int, ...]) -> str:
    a, t1, t2, c, b2, b1 = map(_p, eye)
    return f"(CASE WHEN {Q.dist(a, c)} >= 1e-6 THEN ({Q.dist(t1, b1)} + {Q.dist(t2, b2)}) / 2 / {Q.dist(a, c)} END)"


_IO = Q.dist(_p(H.RIGHT_EYE[0]), _p(H.LEFT_EYE[0]))


def _brow(brow: tuple[int, ...], eye: tuple[int, ...]) -> str:
    return f"(CASE WHEN {_IO} >= 1e-6 THEN (({_p(eye[1])[1]} + {_p(eye[2])[1]}) / 2 - ({' + '.join(_p(k)[1] for k in brow)}) / 5) / {_IO} END)"


_HEADX, _HEADY = (f"list_avg(list_filter([{', '.join(f'{a}{k}' for k in range(5))}], lambda v: v IS NOT NULL))" for a in "xy")
_MW = Q.dist(_p(H.MOUTH[2]), _p(H.MOUTH[3]))


@query(f"""WITH {Q.KPW}, f AS (SELECT session, frame, track_id AS face_idx, event_id FROM kpw WHERE {_HEADX} IS NOT NULL)
SELECT session, frame, face_idx, round(CASE WHEN {_MW} >= 1e-6 THEN {Q.dist(_p(H.MOUTH[0]), _p(H.MOUTH[1]))} / {_MW} END, 6) AS mouth_ratio, round(CASE WHEN {_ear(H.LEFT_EYE)} IS NULL THEN {_ear(H.RIGHT_EYE)} WHEN {_ear(H.RIGHT_EYE)} IS NULL THEN {_ear(H.LEFT_EYE)} ELSE ({_ear(H.LEFT_EYE)} + {_ear(H.RIGHT_EYE)}) / 2 END, 6) AS eye_ratio,
round({_brow(H.LEFT_BROW, H.LEFT_EYE)}, 6) AS left_eyebrow_raise, round({_brow(H.RIGHT_BROW, H.RIGHT_EYE)}, 6) AS right_eyebrow_raise FROM f""")
def sc13_face_signals(spark: SparkSession, d: str) -> DataFrame:
    return A.faces(spark, d).select("session", "frame", "face_idx", *(r6(c).alias(n) for n, c in H.face_signals(F.col("lm")).items()))


@query(f"WITH {Q.SIG} SELECT session, track_id, frame, CAST((event_id * 17) % 121 - 60 AS DOUBLE) AS yaw, CAST((event_id * 13) % 81 - 40 AS DOUBLE) AS pitch, CAST((event_id * 7) % 61 - 30 AS DOUBLE) AS roll FROM sig")
def sc10_euler_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Angles -> rotation -> angles."""
    e = F.col("event_id")
    angles = [((e * a) % m - h).cast("double") for a, m, h in ((17, 121, 60), (13, 81, 40), (7, 61, 30))]
    rot = A.signal(spark, d).withColumn("rot", H.rotation(*angles))
    return rot.select("session", "track_id", "frame", *(F.round(c, 6).alias(n) for n, c in H.euler(F.col("rot")).items())).select("session", "track_id", "frame", *((F.col(n) + 0.0).alias(n) for n in ("yaw", "pitch", "roll")))


@query(f"""WITH {Q.KPW}, f AS (SELECT session, frame, track_id, {_HEADX} AS hx, CAST((event_id * 17) % 121 - 60 AS DOUBLE) AS yaw FROM kpw WHERE {_HEADX} IS NOT NULL), c AS (SELECT *, track_id // 2 AS pair, count(*) OVER (PARTITION BY track_id // 2, frame) AS n FROM f)
SELECT a.session, a.pair, a.frame, a.track_id, b.track_id AS attention_target, round(greatest(0e0, 1 - abs(a.yaw - (b.hx - a.hx) / {A.WIDTH / 2}e0 * 30) / 20), 9) AS attention_score FROM c a JOIN c b ON a.pair = b.pair AND a.frame = b.frame AND a.track_id <> b.track_id WHERE a.n = 2""")
def sc12_joint_attention(spark: SparkSession, d: str) -> DataFrame:
    """Only in frames with exactly two people; tracks are people of one scene two by two."""
    faces = A.faces(spark, d).withColumn("pair", F.floor(F.col("face_idx") / 2)).join(A.keypoints(spark, d).select("session", "frame", F.col("track_id").alias("face_idx"), G.head_center(F.col("kp")).alias("head")), ["session", "frame", "face_idx"])
    two = faces.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("pair", "frame"))).filter("n = 2")
    a, b = two.alias("a"), two.alias("b")
    both = a.join(b, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.frame") == F.col("b.frame")) & (F.col("a.face_idx") != F.col("b.face_idx")))
    return both.select("a.session", "a.pair", "a.frame", F.col("a.face_idx").alias("track_id"), F.col("b.face_idx").alias("attention_target"), F.round(H.joint_attention(F.col("a.head.x"), F.col("a.yaw"), F.col("b.head.x"), float(A.WIDTH)), 9).alias("attention_score"))


@query()
def jn04_faces_to_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one faces to heads, under 80 pixels."""
    faces = A.faces(spark, d).select("session", "frame", "face_idx", F.col("center").alias("at"))
    heads = A.keypoints(spark, d).select("session", "frame", "track_id", G.head_center(F.col("kp")).alias("at"))
    return matching.near(faces, heads, ["session", "frame"], "face_idx", "track_id", 80.0)


@query()
def jn05_hands_to_wrists(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one hands to (track, side) wrists, under 60 pixels."""
    hands = A.hands(spark, d).select("session", "frame", "hand_idx", F.col("lm")[WRIST].alias("at"))
    kp = A.keypoints(spark, d)
    wrists = kp.select("session", "frame", F.explode(F.array(*(F.struct((F.col("track_id") * 2 + k).alias("key"), F.col("kp")[KP[f"{s}_wrist"]].alias("at")) for k, s in enumerate(("left", "right"))))).alias("w")).select("session", "frame", F.col("w.key").alias("wrist"), F.struct("w.at.x", "w.at.y").alias("at"))
    found = matching.near(hands, wrists, ["session", "frame"], "hand_idx", "wrist", 60.0)
    return found.select("session", "frame", "hand_idx", F.floor(F.col("wrist") / 2).alias("track_id"), F.when(F.col("wrist") % 2 == 0, "left").otherwise("right").alias("side"), "distance")


def _h(k: int) -> Q.Point:
    return f"(x10 + (event_id * {k + 1}) % 97 - event_id % 97)", f"(y10 + (event_id * {2 * k + 1}) % 89 - event_id % 89)"


_PALM = Q.dist(_h(WRIST), _h(MIDDLE_KNUCKLE))


@query(f"WITH {Q.KPW} SELECT session, frame, track_id AS hand_idx, {', '.join(f'round({Q.angle(*map(_h, t))}, 6) AS {n}_curl' for n, t in HAND_CURLS.items())}, round(CASE WHEN {_PALM} >= 1e-6 THEN greatest(0e0, least(1e0, ({' + '.join(Q.dist(_h(WRIST), _h(k)) for k in HAND_TIPS)}) / 5 / {_PALM} - 1)) END, 6) AS openness FROM kpw WHERE x10 IS NOT NULL")
def sc16_hand_signals(spark: SparkSession, d: str) -> DataFrame:
    lm = F.col("lm")
    return A.hands(spark, d).select("session", "frame", "hand_idx", *(r6(c).alias(n) for n, c in H.finger_curls(lm).items()), r6(H.hand_openness(lm)).alias("openness"))


# --- fragments and re-identification ------------------------------------------------------------------------------


def _fragment_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors in order of time, cut into spells: an id is (label, spell); every seventh frame is not usable."""
    v = A.appearance(spark, d)
    n = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = v.withColumn("n", n).withColumn("spell", F.floor(F.col("n") / 12))
    ids = rows.select((F.col("label") % 2).cast("string").alias("run"), (F.col("label") * 100 + F.col("spell")).cast("long").alias("id"), F.col("vec_id").alias("frame"), (F.col("vec_id") % 7 != 0).alias("usable"), "vec", F.lit(None).cast("array<double>").alias("hue"))
    box = F.struct((F.col("id") % 50).cast("int").alias("x0"), (F.col("frame") % 40).cast("int").alias("y0"), (F.col("id") % 50 + 20).cast("int").alias("x1"), (F.col("frame") % 40 + 30).cast("int").alias("y1"))
    return ids.select("run", "id", "frame", box.alias("box")), ids


_FRAGS = "fr AS (SELECT CAST(label % 2 AS VARCHAR) AS run, label * 100 + n // 12 AS id, vec_id AS frame FROM (SELECT CAST(label AS BIGINT) AS label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings))"


@query(f'WITH {_FRAGS} SELECT run, id, min(frame) AS "first", max(frame) AS "last", count(*) AS real_frames, count(*) < 8 AS short FROM fr GROUP BY run, id')
def src08_fragment_bounds(spark: SparkSession, d: str) -> DataFrame:
    return fragments.bounds(_fragment_tables(spark, d)[0])


@query(f"WITH {_FRAGS}, u AS (SELECT run, id, frame, row_number() OVER (PARTITION BY run, id ORDER BY frame DESC) AS r FROM fr WHERE frame % 7 <> 0), ok AS (SELECT run, id FROM fr GROUP BY run, id HAVING count(*) >= 8), p AS (SELECT run, id, frame FROM u SEMI JOIN ok USING (run, id) WHERE r <= 5), k AS (SELECT run, id, k, avg(CAST(embedding[k] AS DOUBLE)) AS x FROM (SELECT run, id, embedding, unnest(generate_series(1, 64)) AS k FROM p JOIN embeddings ON vec_id = frame) GROUP BY run, id, k) SELECT run, id, round(sum(x * x), 6) AS power FROM k GROUP BY run, id")
def wn20_edge_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Squared length of the mean of the last five usable frames' vectors, before it is made a unit vector."""
    masks, signals = _fragment_tables(spark, d)
    limits = fragments.bounds(masks)
    usable = signals.filter("usable").join(limits.filter("not short").select("run", "id"), ["run", "id"])
    last = usable.withColumn("k", F.row_number().over(W.partitionBy("run", "id").orderBy(F.desc("frame")))).filter("k <= 5")
    mean = fragments.mean_vectors(last, ["run", "id"], "vec")
    return mean.select("run", "id", r6(G.dot(F.col("vec"), F.col("vec"))).alias("power"))


@query(f'WITH {_FRAGS}, b AS (SELECT run, id, min(frame) AS f, max(frame) AS l FROM fr GROUP BY run, id), t AS (SELECT run, id, f, l, unnest(CASE WHEN l - f + 1 <= 5 THEN generate_series(f, l) ELSE [CAST(round_even(f + i * (l - f) / 4e0, 0) AS BIGINT) FOR i IN [0, 1, 2, 3, 4]] END) AS target FROM b) SELECT DISTINCT run, id, target FROM t')
def wn18_evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    b = fragments.bounds(_fragment_tables(spark, d)[0])
    return b.select("run", "id", F.explode(fragments.evenly_spaced(F.col("first"), F.col("last"), 5)).alias("target"))


@query()
def str15_merge_fragments(spark: SparkSession, d: str) -> DataFrame:
    masks, signals = _fragment_tables(spark, d)
    return fragments.merge(masks, signals)["canonical"]


@query()
def str15_fragment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Assigned pairs of both passes, rejected ones too, the likest first."""
    masks, signals = _fragment_tables(spark, d)
    out = fragments.merge(masks, signals)
    a = out["pairs"].select(F.lit(1).alias("pass"), "run", "from_id", "into_id", "similarity", "accepted")
    b = out["group_pairs"].select(F.lit(2).alias("pass"), "run", F.col("group_id").alias("from_id"), F.col("orphan_id").alias("into_id"), "similarity", "accepted")
    return a.unionByName(b).orderBy(F.desc("similarity"), "run", "from_id", "into_id")


@query(f"WITH {_FRAGS}, tot AS (SELECT run, max(frame) + 1 AS n FROM fr GROUP BY run), s AS (SELECT DISTINCT fr.run, id, unnest(generate_series(0, n - 1)) AS frame FROM fr JOIN tot USING (run)) SELECT run, id, count(*) AS frames, count(x.frame) AS filled FROM s LEFT JOIN fr x USING (run, id, frame) GROUP BY run, id")
def snk03_dense_export(spark: SparkSession, d: str) -> DataFrame:
    """All frames of the run of every id, empty ones included."""
    masks, _ = _fragment_tables(spark, d)
    totals = masks.groupBy("run").agg((F.max("frame") + 1).alias("n"))
    return fragments.densify(masks, totals).groupBy("run", "id").agg(F.count(F.lit(1)).alias("frames"), F.count("box").alias("filled"))


def reid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the re-identification: tracks leave for a while, and come back under another raw id."""
    kp = A.keypoints(spark, d).filter("frame < 20 or frame >= 26")
    u = F.col("track_id")
    sig = F.array(*((0.3 + ((u * (k + 3)) % 17) / 20.0 + ((F.col("event_id") * (k + 1)) % 5) / 1000.0).cast("double") for k in range(12)))
    none = F.lit(None).cast("array<double>")
    hip = G.hip_center(F.col("kp"))
    return kp.select(F.col("session").cast("string").alias("session"), "frame", "t_s", (u * 2 + F.when(F.col("frame") >= 26, 1).otherwise(0)).alias("raw_id"), sig.alias("signature"), none.alias("color"), none.alias("embedding"), hip["x"].alias("hip_x"), hip["y"].alias("hip_y"), G.torso_length(F.col("kp")).alias("torso"))


@query()
def str03_reidentify(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(reid_rows(spark, d))


@query(f"WITH {Q.SIG} SELECT session, track_id, min(frame) AS first_frame, arg_min(v, frame) AS first_v FROM sig GROUP BY session, track_id")
def str18_first_sighting(spark: SparkSession, d: str) -> DataFrame:
    return A.signal(spark, d).groupBy("session", "track_id").agg(F.min("frame").alias("first_frame"), F.min_by("v", "frame").alias("first_v"))


# --- files ----------------------------------------------------------------------------------------------------------


@query(f"WITH {Q.SIG} SELECT session, track_id, frame, round(v, 6) AS v FROM sig")
def snk01_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows to CSV with a header, and back by a declared schema."""
    rows = A.signal(spark, d).select("session", "track_id", "frame", r6("v").alias("v"))
    return files.read_csv(spark, files.write_csv(rows, _folder(spark)), rows.schema)


@query(f"WITH {Q.SIG} SELECT frame // 20 AS chunk_index, count(*) AS n, CAST(sum(track_id) AS BIGINT) AS ids FROM sig WHERE frame // 20 IN (0, 2) GROUP BY 1")
def snk02_chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """Rows partitioned by chunk; reading two chunks opens their files only."""
    rows = A.signal(spark, d).withColumn("chunk_index", F.floor(F.col("frame") / 20).cast("long"))
    path = files.write_chunks(rows, _folder(spark))
    return files.read_chunks(spark, path, rows.schema, [0, 2]).groupBy("chunk_index").agg(F.count(F.lit(1)).alias("n"), F.sum("track_id").alias("ids"))


@query(f"WITH {Q.SIG} SELECT track_id, '{{\"track_id\":' || track_id || ',\"frames\":' || count(*) || ',\"last\":' || max(frame) || '}}' AS report FROM sig GROUP BY track_id")
def snk05_json_report(spark: SparkSession, d: str) -> DataFrame:
    g = A.signal(spark, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), F.max("frame").alias("last"))
    return g.select("track_id", F.to_json(F.struct("track_id", "frames", "last")).alias("report"))


def _folder(spark: SparkSession) -> str:
    return files.scratch(spark)


# --- what the SQL surface has beside ------------------------------------------------------------------------------


@query("SELECT event_type, CAST(floor(user_id / 50) AS BIGINT) AS grp, count(*) AS n, round(sum(value) / 1e3, 6) AS total FROM events GROUP BY CUBE (event_type, grp)")
def sql_cube(spark: SparkSession, d: str) -> DataFrame:
    ev = A.read(spark, d, "events").select("event_type", F.floor(F.col("user_id") / 50).cast("long").alias("grp"), "value")
    return ev.cube("event_type", "grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") / 1e3, 6).alias("total"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 0)")
def sql_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o, n = (A.read(spark, d, t) for t in ("customer", "orders", "nation"))
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").join(n.filter("n_regionkey = 0"), c.c_nationkey == n.n_nationkey, "left_anti").select("c_custkey")


_GAP = 12 * 3600


@query(f"WITH e AS (SELECT user_id, ts, value, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < {_GAP} THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, count(*) AS n, round(sum(value) / 1e3, 6) AS total FROM s GROUP BY user_id, k")
def sql_session_windows(spark: SparkSession, d: str) -> DataFrame:
    ev = A.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = ev.groupBy("user_id", F.session_window("ts", f"{_GAP} seconds")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") / 1e3, 6).alias("total"))
    return g.select("user_id", "n", "total")
