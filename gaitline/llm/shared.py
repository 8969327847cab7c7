"""What several corpus operators need: the shared folder, the training fold, table reads."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitline.sources.files import scratch

#: Fixed value: a word is a run of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000
_BATCH, _VECTORED = "spark.sql.execution.arrow.maxRecordsPerBatch", "parquet.hadoop.vectored.io.enabled"


def steady_reads(spark: SparkSession) -> None:
    """From now on this session's Parquet scans read column chunks one after another: with vectored reads each reading
    thread keeps a buffer outside the heap as large as the largest chunk of texts that it has met. For stages whose
    input another has opened; read() and through_disk() say so for their own scans only.
    """
    spark.conf.set(_VECTORED, "false")


#: Threads of each of the driver's pools for exchanges: Spark starts one for each exchange, up to 128 or 1,024 of them, and keeps
#: it for a minute, so that hundreds of small stages hold hundreds of threads with their stacks and buffers.
EXCHANGE_THREADS = 16
_POOLS = ("broadcastExchange", "shuffleExchange", "resultQueryStage")


def lean_driver(spark: SparkSession) -> None:
    """Has the driver's JVM keep few threads for exchanges and little free heap, and collects its garbage; for plans of many
    small stages.

    Spark reads the pools' sizes at the first exchange of the JVM: where others came before, theirs stay. A JVM
    without these options keeps its own. Results don't depend on either.
    """
    conf = spark._jsparkSession.sessionState().conf()
    for pool in _POOLS:
        conf.setConfString(f"spark.sql.{pool}.maxThreadThreshold", str(EXCHANGE_THREADS))
    jvm = spark.sparkContext._jvm
    try:
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        options.setVMOption("MinHeapFreeRatio", "20")
        options.setVMOption("MaxHeapFreeRatio", "40")
    except Py4JError:
        pass
    jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.option(_VECTORED, "false").parquet(f"{sf_dir}/{table}.parquet")


def through_disk(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors.

    A table without rows comes back with its schema; the files go when the driver's JVM ends. While it is written, rows go to Python in batches of BATCH_ROWS,
    so that a batch of texts is a few megabytes.
    """
    path = scratch(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, before)
    return df.sparkSession.read.option(_VECTORED, "false").schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text mod n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n
