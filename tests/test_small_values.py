"""Values at the edge of the arithmetic, against the queries' SQL over a few rows."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from gaitline.plans.registry import ORACLES, QUERIES


@pytest.fixture
def events(tmp_path):
    """Writes events (event_id, user_id, value), a second apart; gives the folder and DuckDB over it."""

    def write(rows):
        at = [datetime(2024, 1, 1) + timedelta(seconds=k) for k in range(len(rows))]
        ids, users, values = zip(*rows)
        table = {"event_id": pa.array(ids, pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": ["view"] * len(rows), "value": pa.array(values, pa.float64()), "props": ["{}"] * len(rows)}
        pq.write_table(pa.table(table), tmp_path / "events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        return str(tmp_path), con

    return write


def test_latency_of_zero(spark, events):
    d, con = events([(1, 1, 0.0), (2, 1, 0.0), (3, 1, 4.0), (4, 2, 5.0), (5, 2, 0.0), (6, 3, None), (7, 3, 2.0)])
    got = QUERIES["ag19_moving_latency"](spark, d).toPandas()
    assert rows_of(got) == rows_of(con.execute(ORACLES["ag19_moving_latency"]).df())
    assert sum(math.isinf(v) for v in got["fps"]) == 2


def test_rounding_as_the_sql_rounds(spark):
    from gaitline.plans.pose import rounded

    values = [2.0265625, -1.0015625, 24.4140625, 0.0000005, -0.0000005, 0.1234565, 1e290, -1e290, 123456789012.3456785, 0.0, math.inf, -math.inf, 0.49999999999999994e-6, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = {r["k"]: (r["six"], r["nine"]) for r in df.select("k", rounded("v", 6).alias("six"), rounded(F.col("v"), 9).alias("nine")).collect()}
    con = duckdb.connect()
    assert got == {k: con.execute("SELECT round(CAST(? AS DOUBLE), 6), round(CAST(? AS DOUBLE), 9)", [v, v]).fetchone() for k, v in enumerate(values)}


def test_live_rows_of_a_face_without_a_mouth(spark, events):
    # corners of the mouth coincide where 211 divides 230 e + 1610 and 197 divides 230 e + 690: e = 29744 modulo 211 * 197
    gone = next(e for e in range(1, 211 * 197) if (64 * e + 427) % 211 == (294 * e + 2037) % 211 and (66 * e + 183) % 197 == (296 * e + 873) % 197)
    # brows that are a tie by their decimals: 56541 and others
    ids = [*range(1, 60), gone, *range(gone + 1, gone + 5), 78696, 98108]
    d, con = events([(e, 1, 1.0) for e in ids])
    got = QUERIES["str01_live_rows"](spark, d).toPandas()
    at = got.set_index("frame").loc[59]
    assert math.isnan(at["mouth_ratio"]) and not math.isnan(at["head_yaw"]) and math.isnan(at["mouth_rep_freq_hz"]) and math.isnan(at["mouth_rep_power_ratio"])
    assert got["mouth_rep_power_ratio"].notna().any()
    assert rows_of(got) == rows_of(con.execute(ORACLES["str01_live_rows"]).df())


def test_live_rows_of_equal_peaks(spark, events):
    # a window of yaw with as much power at 2.5 as at 5 Hz, and one of pitch at 2.5 as at 7.5 Hz; the SQL's sums tell the higher
    yaw = [214488, 220987, 225081, 250499, 258190, 265554, 267605, 273819, 277978, 286823, 291380, 305439, 308812, 319151, 334513, 338609, 341811, 344172, 356179, 357951, 362295, 383410, 392090, 392851, 404057, 422849, 452189, 472456, 474342, 484164]
    pitch = [85363, 108403, 110107, 124795, 130540, 145093, 146907, 165764, 166303, 166993, 199122, 215854, 216293, 216567, 218614, 224528, 228519, 228983, 229872, 241587, 250515, 257567, 258043, 272581, 276418, 281887, 287300, 299781, 302783, 303657]
    d, con = events([(e, user, 1.0) for user, ids in ((1, yaw), (2, pitch)) for e in ids])
    got = QUERIES["str01_live_rows"](spark, d).toPandas()
    at = got.set_index(["track_id", "frame"])
    assert at.loc[(1, 29), "yaw_rep_freq_hz"] == 5.0 and at.loc[(2, 29), "pitch_rep_freq_hz"] == 7.5
    assert rows_of(got) == rows_of(con.execute(ORACLES["str01_live_rows"]).df())


def test_live_rows_of_a_share_between_two_roundings(spark, events):
    # the share of a window of pitch is 0.1521875, and just under it in the SQL's sums
    ids = [507864, 509759, 511395, 512741, 513172, 514745, 514950, 516430, 519613, 520280, 520281, 528058, 528706, 529501, 529722, 530029, 531238, 533678, 534011, 534087, 534309, 534457, 535384, 535753, 537217, 537350, 539528, 539954, 542040, 542523]
    d, con = events([(e, 1, 1.0) for e in ids])
    got = QUERIES["str01_live_rows"](spark, d).toPandas()
    assert got["pitch_rep_power_ratio"].tolist() == [0.152187]
    assert rows_of(got) == rows_of(con.execute(ORACLES["str01_live_rows"]).df())


def test_equal_peaks_as_the_sql_adds():
    from gaitline.operators.spectral import peaks
    from gaitline.plans.pose import FPS, dft

    rng, con = np.random.default_rng(5), duckdb.connect()
    for n in (8, 30, 33):
        x = rng.integers(-2, 3, (3000, n)).astype(float)
        con.execute("CREATE OR REPLACE TABLE raw AS SELECT unnest(?::BIGINT[]) AS g, unnest(?::BIGINT[]) AS i, unnest(?::DOUBLE[]) AS v", [np.repeat(np.arange(len(x)), n).tolist(), np.tile(np.arange(n), len(x)).tolist(), x.ravel().tolist()])
        want = con.execute(f"WITH z AS (SELECT g, i, CAST({n} AS BIGINT) AS n, v - avg(v) OVER (PARTITION BY g) AS x FROM raw ORDER BY g, i), {dft('z', 'g', FPS)} ORDER BY g").df()
        freq, share = peaks(x, FPS)
        assert np.array_equal(np.round(freq, 6), want["peak_freq_hz"].to_numpy(float), equal_nan=True)
        assert np.array_equal(np.floor(share * 1e6 + 0.5) / 1e6, want["peak_power_ratio"].to_numpy(float))


def test_similarity_across_blocks(spark, sf_small, duck, monkeypatch):
    from gaitline.plans import appearance

    monkeypatch.setattr(appearance, "_BLOCK_ROWS", 7)
    got = QUERIES["sc30_embedding_similarity"](spark, sf_small).toPandas()
    assert rows_of(got) == rows_of(duck.execute(ORACLES["sc30_embedding_similarity"]).df())
