"""Training corpus from ``documents``: a chain of five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's input.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, mixing, quality, secret_scan, simhash
from ledgerlens.llm.common import checkpointed, fold, table, text_key
from ledgerlens.session import scratch_path

REJECT_BELOW = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    The classifier is fitted on labelled documents of the stage's input; empty
    and null texts are judged like any other; repeated rows share their fate.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", fold(F.col("doc_id"), quality.FOLDS) != 0)
    return docs.where(quality.scorer(model)(F.col("text")) >= REJECT_BELOW)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the
    smallest id (null ids last; of several texts under one id, the one with
    the smallest hash).  Rows repeated word for word count once."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    keep = (simhash.near_duplicates(docs).groupBy("component").agg(F.min(order).alias("first"))
            .select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__keep")))
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    kept = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__keep")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts stay."""
    hits = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key(F.col("text")) == F.col("__key")), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask; n_chars is that of the new text."""
    clean = secret_scan.redact(docs, secret_scan.secrets(docs))
    masked = F.char_length("text").cast("bigint")
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(masked)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes words of, with how often and how much:
    ``epochs`` whole passes and ``extra_words`` of one more, ``taken_words`` in all.

    Rows repeated under one id, text and source take one after the other what
    the mix takes of them together."""
    mix = (mixing.mixture(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("source").alias("__source"))
           .agg(F.max("epochs").alias("epochs"), F.max("size").alias("__size"), F.sum("extra").alias("__extra"),
                F.sum("taken").alias("__taken"), F.count(F.lit(1)).alias("__rows")).where("__taken > 0"))
    mix = checkpointed(mix)
    keyed = docs.withColumn("__text_key", text_key(F.col("text")))
    # Only repeats are numbered: without any, the texts need not be shuffled.
    repeats = Window.partitionBy("doc_id", "__text_key", "source").orderBy(F.xxhash64(*docs.columns))
    keyed = keyed.withColumn("__nr", F.lit(1) if mix.where("__rows > 1").isEmpty() else F.row_number().over(repeats))
    joined = keyed.join(mix, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
                        & F.col("source").eqNullSafe(F.col("__source")))
    extra = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__extra") - (F.col("__nr") - 1) * F.col("__size"))).cast("bigint")
    joined = joined.withColumn("extra_words", extra).withColumn("taken_words", F.col("epochs") * F.col("__size") + F.col("extra_words"))
    return joined.where("taken_words > 0").select(*docs.columns, "epochs", "extra_words", "taken_words")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

# The classifier, the fingerprints and the sampling hash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus made of ``documents``: every stage in turn."""
    docs = table(spark, sf_dir, "documents")
    work = scratch_path(spark, "corpus")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{work}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
