"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int,
                    doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents.

    ``allowed`` is a condition on the column ``doc_id`` that keeps held-out
    rows away.  The ids with the smallest hash are taken, half from each class
    if there are enough, so reruns agree and the order of the tables does not
    matter.  Null ids, labels other than 0 and 1, and ids labelled both ways
    are left out; documents repeated under one id count once, with the text of
    smallest hash; a null text counts as empty.
    """
    marks = (labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed)
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
             .where("label = other").select("doc_id", "label"))
    order = F.xxhash64("doc_id")
    # At most rows/2 per class, filled up from the other class if one has fewer.
    zeros = marks.where("label = 0").orderBy(order, "doc_id").limit(rows)
    ones = marks.where("label = 1").orderBy(order, "doc_id").limit(rows)
    n0, n1 = zeros.count(), ones.count()
    take0 = min(n0, max(rows // 2, rows - n1))
    chosen = (zeros.orderBy(order, "doc_id").limit(take0)
              .unionByName(ones.orderBy(order, "doc_id").limit(min(n1, rows - take0))))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The broadcast side has at most ``rows`` ids.
    found = source.join(F.broadcast(chosen), "doc_id")
    return (found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
            .select("doc_id", "one.text", "label"))
