"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word target.  While a target is at least the source's
size, all its documents are taken once more (complete epochs); what then
remains is a fractional selection.  Each document draws an exponential key,
-ln(u) / weight, from a hash of its id and text; in key order (smallest
first: a weighted sample without replacement) documents are taken until their
sizes add up to the remaining budget, the last one only as far as needed.

The order is cut into ranges of (source, key), so a source that holds most of
the rows is spread over many tasks: sizes are summed per range, the few range
sums are added up per source, and only within a range are rows sorted.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, text_key

# Fixed by the contract: words, weights in source order, and the epoch limit.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mark_weight(text: Column) -> Column:
    """Document weight from 1 (prose) down to 0.05 by the share of symbol marks."""
    length = F.char_length(text)
    marks = length - F.char_length(F.translate(text, "!|%$#&*<>{}[]\\^~", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.exp(-20.0 * marks / F.when(length > 0, length)), F.lit(1.0)))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source with its size.

    Targets share ``share`` of all words by weight; none exceeds ``max_epochs``
    times its source, and the excess goes to the others by weight.  That is
    filling vessels to one level: in order of capacity per weight, the level
    is the first at which the remaining words fit the remaining vessels.
    The windows see one row per source.
    """
    ordered = sources.withColumn("nr", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nr") - 1) % len(weights) + 1)
    vessels = ordered.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "nr").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * min(share, max_epochs) - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0))))
    vessels = (vessels.withColumn("level", level)
               # rounding may leave the last level a hair above its capacity
               .withColumn("fits", F.col("level") <= F.col("cap") / F.col("w") * (1 + 1e-12)))
    vessels = vessels.withColumn("found", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "nr", "level"))).over(everything))
    return vessels.select("source", "source_size",
                          F.least(F.col("cap"), F.col("found.level") * F.col("w")).cast("double").alias("target"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
            weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0,
            max_epochs: int = MAX_EPOCHS, seed: int = 11) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, epochs, extra, taken) per row.

    ``taken = epochs * size + extra`` words; per source they add up to the
    target, rounded.  Null texts have size 0 and are never taken; a null
    source is a source, the last one; null ids are allowed; repeated rows draw
    the same key and are taken one after the other; a source without words
    has target 0; an empty table gives no rows; other columns are ignored.
    Weights are positive; a null or other weight counts as 0.05.
    """
    w = mark_weight(F.col(text)) if weight is None else weight
    w = F.when(w > 0, w.cast("double")).otherwise(F.lit(0.05))
    # 53 random bits, never 0.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), text_key(F.col(text))), 11) + 0.5) / float(1 << 53)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"),
                       F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
                       (-F.log(u) / w).alias("draw"))
    # The narrow rows are stored first, so that the ranges are sampled and cut
    # from them and the texts are read a single time; then with their range.
    rows = checkpointed(rows)
    rows = checkpointed(rows.repartitionByRange("source", "draw").withColumn("range", F.spark_partition_id()))

    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    targets = (targets.withColumn("epochs", whole)
               .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")))
    plan = (ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
            .select("r.source", "r.range", "r.ahead", "t.source_size", "t.target", "t.epochs", "t.rest"))
    within = Window.partitionBy("source", "range").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    extra = F.least(F.col("x.size"), F.greatest(F.lit(0), F.col("p.rest") - F.col("p.ahead") - F.col("x.inside"))).cast("bigint")
    return (rows.alias("x").join(plan.alias("p"), F.col("x.source").eqNullSafe(F.col("p.source"))
                                 & (F.col("x.range") == F.col("p.range")))
            .select("x.doc_id", "x.text_key", "x.source", "x.size", "p.source_size", "p.target", "p.epochs",
                    extra.alias("extra"), (F.col("p.epochs") * F.col("x.size") + extra).alias("taken")))
