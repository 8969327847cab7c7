"""Files in and out: CSV features, chunk stores, mask folders, JSON reports. All paths go through Spark."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where it is unset a local one serves if driver and executors
    are one process, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gaitline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{path}/rows"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again, for a result that several consumers need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk_index") -> str:
    """Parquet by chunk. Rows of a chunk are brought together first, so a chunk is few files; a chunk's rows may be many tasks'."""
    df.repartition(chunk).write.partitionBy(chunk).parquet(path)
    return path


def read_chunks(spark: SparkSession, path: str, schema: T.StructType, chunks: Sequence[int] | None = None, chunk: str = "chunk_index") -> DataFrame:
    """Rows of the chunks, others' files aren't opened. A chunk without rows has no folder: see manifest()."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if chunks is None else rows.filter(F.col(chunk).isin(list(chunks)))


def manifest(df: DataFrame, chunks: DataFrame, chunk: str = "chunk_index") -> DataFrame:
    """chunks with rows held: an empty chunk has 0, a missing one no row."""
    held = df.groupBy(chunk).agg(F.count(F.lit(1)).alias("rows_held"))
    return chunks.join(held, chunk, "left").na.fill(0, ["rows_held"])


_LISTED = "id long, path string, length long"


def _there(spark: SparkSession, folder: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def mask_files(spark: SparkSession, folder: str, suffix: str = "mp4", required: bool = False) -> DataFrame:
    """id, path, length of the files named <integer>.<suffix>; others are left out. Contents are not read.

    A missing folder has none. required: FileNotFoundError for a missing folder, ValueError for one without masks.
    """
    if not _there(spark, folder):
        if required:
            raise FileNotFoundError(folder)
        return spark.createDataFrame([], _LISTED)
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.regexp_extract("path", rf"/(\d+)\.{suffix}$", 1)
    found = files.withColumn("id", F.when(name != "", name).cast("long")).filter("id is not null").select("id", "path", "length")
    if required and found.isEmpty():
        raise ValueError(f"no <integer>.{suffix} in {folder}")
    return found


def _runs_of(pixels: np.ndarray) -> list[dict]:
    """Runs of a row-by-row mask [row, column], each within its row."""
    edge = np.diff(np.pad(pixels.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, x0), (_, x1) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return [{"start": s, "len": n} for s, n in zip((y * pixels.shape[1] + x0).tolist(), (x1 - x0).tolist())]


def mask_frames(spark: SparkSession, folder: str, threshold: int = 127) -> DataFrame:
    """id, frame, h, w, rle of the images <id>/<frame>.pgm (binary, 8 bit): pixels over the threshold; an empty frame has an empty rle.

    Other files are left out; a broken image is an error that names it. Images go to Python a batch at a time.
    """
    schema = "id long, frame long, h int, w int, rle array<struct<start:bigint,len:int>>"
    if not _there(spark, folder):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)\.pgm$", k)
    named = files.filter(at(1) != "").select(at(1).cast("long").alias("id"), at(2).cast("long").alias("frame"), "path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, rles = [], []
            for path, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                head = re.match(rb"P5(?:\s+(?:#[^\n]*\n\s*)?)(\d+)\s+(\d+)\s+(\d+)\s", raw)
                if not head or len(raw) - head.end() < int(head[1]) * int(head[2]) or int(head[3]) > 255:
                    raise ValueError(f"not an 8-bit PGM image: {path}")
                w, h = int(head[1]), int(head[2])
                sizes.append((h, w))
                rles.append(_runs_of(np.frombuffer(raw, np.uint8, h * w, head.end()).reshape(h, w) > threshold))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32()), pa.array(rles, kind)], ["id", "frame", "h", "w", "rle"])

    return named.mapInArrow(run, schema)


def equal_lengths(masks: DataFrame) -> DataFrame:
    """masks(run, id, n) where all ids of a run have the same number of frames; the query fails otherwise."""
    sizes = masks.groupBy("run").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    message = F.concat(F.lit("masks of unequal length in run "), F.col("run"))
    return sizes.select("run", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(message)).alias("n"))
