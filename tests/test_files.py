"""Sinks and sources round trip."""

import pytest
from pyspark.sql import functions as F

from gaitline.sources import files, schemas
from gaitline.operators.fragments import densify


def test_chunk_store(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "a"), (2, 5, "b"), (2, 6, "c")], "chunk_index long, frame long, v string")
    path = files.write_chunks(df, str(tmp_path / "chunks"))
    back = files.read_chunks(spark, path, df.schema, [2])
    assert sorted(r["frame"] for r in back.collect()) == [5, 6]
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString() or "chunk_index" in back._jdf.queryExecution().toString()
    manifest = files.manifest(df, spark.range(3).withColumnRenamed("id", "chunk_index"))
    assert {r["chunk_index"]: r["rows_held"] for r in manifest.collect()} == {0: 1, 1: 0, 2: 2}


def test_mask_files(spark, tmp_path):
    for name in ("0.mp4", "12.mp4", "notes.txt", "x1.mp4"):
        (tmp_path / name).write_bytes(b"12345")
    assert sorted((r["id"], r["length"]) for r in files.mask_files(spark, str(tmp_path)).collect()) == [(0, 5), (12, 5)]


def test_unequal_lengths_fail(spark):
    ok = spark.createDataFrame([("r", 1, 5), ("r", 2, 5)], "run string, id long, n long")
    assert files.equal_lengths(ok).first()["n"] == 5
    with pytest.raises(Exception, match="unequal"):
        files.equal_lengths(ok.unionByName(spark.createDataFrame([("r", 3, 6)], ok.schema))).collect()


def test_densify_pads(spark):
    m = spark.createDataFrame([("r", 7, 2, (0, 1, 0, 1))], "run string, id long, frame long, box struct<y0:int,y1:int,x0:int,x1:int>")
    out = densify(m, spark.createDataFrame([("r", 4)], "run string, n long")).orderBy("frame").collect()
    assert [r["box"] is not None for r in out] == [False, False, True, False]


def test_schemas_are_complete(spark):
    assert set(schemas.ALL) == {"keypoints", "detections", "masks", "runs", "frames", "faces", "hands", "embeddings", "histograms", "chunk_out"}
    assert spark.createDataFrame([], schemas.KEYPOINTS).select(F.col("kp")[0]["conf"]).dtypes[0][1] == "double"
