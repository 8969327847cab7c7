"""Queries on masks: overlaps, unions, parts, and identities matched by pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitline.operators import fragments, identity, masks
from gaitline.sources import adapters as A

from . import sqltext as Q
from .catalog import query
from .pose import r6

_FRAME = ["session", "frame"]


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = A.rle_masks(spark, d)
    return tuple(m.filter(F.col("run") == r) for r in ("oracle", "baseline"))


_AREA = "ar AS (SELECT run, session, id, frame, count(*) AS n FROM px GROUP BY ALL)"
_INTER = "it AS (SELECT a.session, a.frame, a.id AS oracle_id, b.id AS baseline_id, count(*) AS inter FROM px a JOIN px b ON a.session = b.session AND a.frame = b.frame AND a.p = b.p AND a.run = 'oracle' AND b.run = 'baseline' GROUP BY ALL)"


@query(f"""WITH {Q.RUNS}, {Q.PIXELS}, {_AREA}, {_INTER} SELECT it.session, it.frame, oracle_id, baseline_id, inter, round(inter / (x.n + y.n - inter), 6) AS iou
FROM it JOIN ar x ON x.run = 'oracle' AND x.session = it.session AND x.frame = it.frame AND x.id = oracle_id JOIN ar y ON y.run = 'baseline' AND y.session = it.session AND y.frame = it.frame AND y.id = baseline_id""")
def so03_mask_ops(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that the masks of both runs share, and their share of the pixels that either has."""
    return masks.overlaps(*_runs(spark, d), _FRAME, "oracle_id", "baseline_id").withColumn("iou", r6("iou"))


@query(f"""WITH {Q.RUNS}, {Q.PIXELS}, u AS (SELECT DISTINCT run, session, id // 4 AS id, frame, p FROM px), k AS (SELECT *, p - row_number() OVER (PARTITION BY run, session, id, frame ORDER BY p) AS island FROM u)
SELECT run, session, id, frame, count(*) AS pixels, count(DISTINCT island) AS runs, min(p) AS first_pixel FROM k GROUP BY run, session, id, frame""")
def snk04_merged_masks(spark: SparkSession, d: str) -> DataFrame:
    """The masks of an identity's members united pixel by pixel."""
    m = A.rle_masks(spark, d)
    canonical = m.select("run", "session", "id").distinct().withColumn("canonical", F.floor(F.col("id") / 4).cast("long"))
    out = fragments.merged_masks(m, canonical, ("run", "session"))
    return out.select("run", "session", "id", "frame", masks.area(F.col("rle")).alias("pixels"), F.size("rle").cast("long").alias("runs"), F.col("rle")[0]["start"].alias("first_pixel"))


# a mask is in one part when all its pixels are reached from its first
_REACH = """st AS MATERIALIZED (SELECT run, session, id, frame, y, x, x - row_number() OVER (PARTITION BY run, session, id, frame, y ORDER BY x) AS g FROM px),
sg AS MATERIALIZED (SELECT run, session, id, frame, y, min(x) AS a, max(x) AS b FROM st GROUP BY run, session, id, frame, y, g),
re AS (SELECT run, session, id, frame, min(y) AS y, arg_min(a, y * 1000 + a) AS a, arg_min(b, y * 1000 + a) AS b FROM sg GROUP BY run, session, id, frame
  UNION SELECT s.run, s.session, s.id, s.frame, s.y, s.a, s.b FROM re r JOIN sg s ON s.run = r.run AND s.session = r.session AND s.id = r.id AND s.frame = r.frame AND abs(s.y - r.y) = 1 AND s.a <= r.b + 1 AND r.a <= s.b + 1)"""


@query(f"""WITH RECURSIVE {Q.RUNS}, {Q.PIXELS}, {_REACH}, al AS (SELECT run, session, id, frame, count(*) AS n, min(a) AS x0, max(b) AS x1, min(y) AS y0, max(y) AS y1 FROM sg GROUP BY run, session, id, frame), rc AS (SELECT run, session, id, frame, count(*) AS m FROM re GROUP BY run, session, id, frame)
SELECT al.run, al.session, al.id, al.frame, n = m AS single, n = m AND x0 > 1 AND y0 > 1 AND x1 < {A.WIDTH // 8} - 2 AND y1 < {A.HEIGHT // 8} - 2 AS usable FROM al JOIN rc ON al.run = rc.run AND al.session = rc.session AND al.id = rc.id AND al.frame = rc.frame""")
def pf09_single_component(spark: SparkSession, d: str) -> DataFrame:
    """Which masks are in one part, and may stand for a person."""
    m = masks.with_parts(A.rle_masks(spark, d).filter(F.size("rle") > 0))
    good = masks.usable(masks.bounds(F.col("rle"), F.col("w")), F.col("parts"), F.col("h"), F.col("w"))
    return m.select("run", "session", "id", "frame", (F.col("parts") == 1).alias("single"), good.alias("usable"))


@query(f"""WITH {Q.RUNS}, {Q.PIXELS}, {_AREA}, {_INTER},
io AS MATERIALIZED (SELECT it.session, it.frame, oracle_id, baseline_id, inter / (x.n + y.n - inter) AS iou, dense_rank() OVER (PARTITION BY it.session, it.frame, oracle_id // 2 ORDER BY oracle_id) AS r, dense_rank() OVER (PARTITION BY it.session, it.frame, oracle_id // 2 ORDER BY baseline_id) AS k
  FROM it JOIN ar x ON x.run = 'oracle' AND x.session = it.session AND x.frame = it.frame AND x.id = oracle_id JOIN ar y ON y.run = 'baseline' AND y.session = it.session AND y.frame = it.frame AND y.id = baseline_id),
wa AS (SELECT session, frame, oracle_id // 2 AS cell, coalesce(sum(iou) FILTER (r = k), 0) - coalesce(sum(iou) FILTER (r <> k), 0) AS lead FROM io GROUP BY ALL),
mt AS (SELECT io.session, io.frame, oracle_id, baseline_id FROM io JOIN wa ON wa.session = io.session AND wa.frame = io.frame AND wa.cell = oracle_id // 2 WHERE (r = k) = (lead >= -1e-11) AND iou >= 1e-1)
SELECT o.session, o.frame, o.id AS oracle_id, mt.baseline_id FROM (SELECT DISTINCT session, frame, id FROM px WHERE run = 'oracle') o LEFT JOIN mt ON mt.session = o.session AND mt.frame = o.frame AND mt.oracle_id = o.id""")
def jn07_mask_correspondence(spark: SparkSession, d: str) -> DataFrame:
    """Identities of two runs matched by the overlap of their masks' pixels."""
    oracle, base = _runs(spark, d)
    return identity.correspondence(oracle.filter(F.size("rle") > 0), base, pixels=True).select("session", "frame", "oracle_id", "baseline_id")
