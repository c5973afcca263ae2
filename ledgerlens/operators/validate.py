"""Row validation: map columns, then attach ``error_messages`` and ``is_valid``.

One narrow projection per row; no shuffle, no UDF.  The summary is observed
while the validated table is written, so the rules are evaluated once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules, text
from ledgerlens.functions.registry import FieldRegistry, registry as default_registry
from ledgerlens.operators.mapping import apply_mapping, mapped_fields


def rule_list(fields, date_formats=text.DEFAULT_DATE_FORMATS):
    """(fault condition, message) for every rule of the mapped fields, in mapping order."""
    return [r for f in fields for r in rules.rules_for(f, date_formats)]


def validate(raw: DataFrame, mapping: Mapping[str, str],
             registry: FieldRegistry = default_registry,
             date_formats=text.DEFAULT_DATE_FORMATS,
             keep: tuple[str, ...] = ("row_id",), stored: bool = False, filtered: bool = False) -> DataFrame:
    """Mapped canonical columns (still text) + ``error_messages`` + ``is_valid``.

    Bookkeeping columns named in ``keep`` (row id, source file) pass through.

    ``is_valid`` is computed from the fault conditions directly, not from
    the message array, so a later ``filter(is_valid)`` that drops the
    messages never builds them.  With ``stored=True`` both columns will be
    written, and ``is_valid`` is read off the messages instead: each rule is
    then evaluated once per row.  With ``filtered=True`` the rows will be
    filtered by ``is_valid`` without being stored (``transform`` does so).
    """
    mapped = apply_mapping(raw, mapping, registry, keep=keep)
    rl = rule_list([f for _, f in mapped_fields(mapping, registry)], date_formats)
    checked = mapped.withColumn("error_messages", rules.messages(rl))
    if stored:
        return checked.withColumn("is_valid", F.size("error_messages") == 0)
    return checked.withColumn("is_valid", rules.passes_filter(rl) if filtered else rules.passes(rl))


def date_layouts(raw: DataFrame, mapping: Mapping[str, str], registry: FieldRegistry = default_registry) -> dict:
    """Canonical date column -> layouts, found from the whole columns."""
    dates = [f.canonical_name for _, f in mapped_fields(mapping, registry) if f.dtype == "date"]
    return text.choose_layouts(apply_mapping(raw, mapping, registry), dates)


def summary_figures() -> dict[str, Column]:
    """Aggregates of the summary, over a validated table or while it is written."""
    return {"total_rows": F.count(F.lit(1)), "invalid_rows": F.count_if(~F.col("is_valid"))}


def validation_summary(validated: DataFrame) -> DataFrame:
    """One row: total_rows, invalid_rows."""
    return validated.agg(*[c.alias(name) for name, c in summary_figures().items()])


def error_counts(validated: DataFrame) -> DataFrame:
    """Rows per failing-rule message (a row with two faults counts twice).

    ``explode`` is a narrow operator and the count is partially aggregated
    before the shuffle, so the exchange carries one row per message per task.
    """
    return (validated
            .select(F.explode("error_messages").alias("message"))
            .groupBy("message")
            .agg(F.count(F.lit(1)).alias("n_rows")))
