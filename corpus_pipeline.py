"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Each stage is one operator over all that its predecessor kept, and its decisions take effect:
language ID drops documents without a language, the Jaccard join keeps one document of each group, decontamination
drops contaminated ones, mixing repeats and drops documents until sources meet their targets, and sharding places
what remains. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitline.llm import decontam, jaccard, langid, mixing
from gaitline.llm.queries import SHARDS
from gaitline.llm.sharding import place
from gaitline.llm.shared import lean_driver, read, steady_reads, through_disk
from gaitline.sources.files import settled

#: A language must be the likelier one of any two.
MIN_SCORE = 0.5


def tidy(spark: SparkSession) -> None:
    """Has the driver's JVM give back what the plans of earlier stages took: there are hundreds, and its memory is small."""
    lean_driver(spark)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: not `und`, score of at least MIN_SCORE. Without labels in lang all texts are
    `und`; null and empty texts are too.
    """
    tidy(spark)
    steady_reads(spark)
    model = langid.learn(docs)
    found = langid.identify(docs, model, pred_col="_lang_pred", score_col="_score")
    return found.filter((F.col("_lang_pred") != langid.UNDETERMINED) & (F.col("_score") >= MIN_SCORE)).select(*docs.columns)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each linked group, once; where its id has several texts in the group, the one
    whose hash is the least. Documents that link with nothing stay, and so do rows with a null id. Rows that
    repeat both id and text are one document. An empty table stays empty.
    """
    tidy(spark)
    found = settled(jaccard.linked(docs), "linked").filter("component_id is not null")
    tidy(spark)
    gone = found.filter("doc_id <> component_id").select("doc_id", "key")
    repeated = not found.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeated:
        first = found.filter("doc_id = component_id and n_shingles > 0").groupBy("component_id").agg(F.min("key").alias("least"))
        more = found.filter("doc_id = component_id and n_shingles > 0").join(first, "component_id").filter("key <> least")
        gone = gone.unionByName(more.select("doc_id", "key"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    kept = docs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
    if repeated:
        real = kept.filter("doc_id is not null").withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"]).drop("_key")
        kept = real.unionByName(kept.filter("doc_id is null"))
    return kept


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in benchmark passages; null and empty texts stay."""
    tidy(spark)
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_text")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times. Rows equal in id, text and source together as often as the mix
    takes them together; null and empty texts, of no size, are never taken. An empty table stays empty.
    """
    tidy(spark)
    times = F.expr("case when taken > 0 then cast(taken div size as int) else 0 end")
    taken = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), times.alias("_times"))
    taken = taken.groupBy("_id", "_key").agg(F.sum("_times").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    taken = settled(taken.filter("_times > 0"), "taken")
    own = docs.withColumn("_own", mixing.row_key("text", "source"))
    if not taken.filter("_rows > 1").isEmpty():
        own = own.dropDuplicates(["doc_id", "_own"])
    both = own.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")))
    return both.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int"))).alias("_copy")).drop("_copy")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard; copies of a document share a shard."""
    tidy(spark)
    steady_reads(spark)
    return place(docs, "doc_id", SHARDS)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", join_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Language ID has no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = through_disk(docs, name)
    return docs
