"""Column mapping: raw export column -> canonical field id.

``check_mapping`` applies the mapping rules to one mapping on the driver (a
mapping is a couple of dozen entries, i.e. metadata).  The same rules as a
distributed job over a whole catalog of mappings live in
``ledgerlens.operators.catalog``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.registry import FieldRegistry, registry as default_registry


class MappingError(ValueError):
    """A mapping rule failed; ``rule`` is 1..5 in evaluation order."""

    def __init__(self, rule: int, message: str):
        super().__init__(message)
        self.rule = rule


# FIXED VALUES: mapping rule messages, in rule order 1..5.
MSG_UNKNOWN_IDS = "Invalid field ids: {ids}"
MSG_DUPLICATES = "Duplicate canonical fields in mapping"
MSG_MISSING_MANDATORY = "Mandatory fields not mapped: {names}"
MSG_NO_AMOUNT_GROUP = (
    "Invalid debit/credit mapping. You must map either "
    "both 'Debit Amount' & 'Credit Amount' OR "
    "'Amount' & 'Debit / Credit Indicator'."
)
MSG_MIXED_GROUPS = "Cannot mix debit/credit field groups. Use only one group."

# The two ways to carry money: separate debit/credit columns, or one signed
# amount plus an indicator.
DEBIT_CREDIT_GROUP = ("debit_amount", "credit_amount")
AMOUNT_INDICATOR_GROUP = ("amount", "debit_credit_indicator")


def qcol(name: str) -> Column:
    """Column by exact name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def check_mapping(mapping: Mapping[str, str], registry: FieldRegistry = default_registry) -> None:
    """Raise ``MappingError`` for the first failing rule (unknown ids,
    duplicates, missing mandatory fields, no complete amount group, both
    amount groups complete)."""
    core = registry.all()
    valid_ids = {f.id for f in core}
    values = [str(v) for v in mapping.values()]

    unknown = sorted(set(values) - valid_ids)
    if unknown:
        raise MappingError(1, MSG_UNKNOWN_IDS.format(ids=unknown))

    if len(values) != len(set(values)):
        raise MappingError(2, MSG_DUPLICATES)

    mapped = set(values)
    missing = [f.canonical_name for f in core if f.is_mandatory and f.id not in mapped]
    if missing:
        raise MappingError(3, MSG_MISSING_MANDATORY.format(names=missing))

    def complete(group):
        return all(registry.id_of(n) in mapped for n in group)

    dc, ai = complete(DEBIT_CREDIT_GROUP), complete(AMOUNT_INDICATOR_GROUP)
    if not (dc or ai):
        raise MappingError(4, MSG_NO_AMOUNT_GROUP)
    if dc and ai:
        raise MappingError(5, MSG_MIXED_GROUPS)


def mapped_fields(mapping: Mapping[str, str], registry: FieldRegistry = default_registry):
    """(raw column, Field) pairs in mapping order."""
    return [(raw, registry.get_field(fid)) for raw, fid in mapping.items()]


def apply_mapping(df: DataFrame, mapping: Mapping[str, str],
                  registry: FieldRegistry = default_registry,
                  keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Keep only the mapped raw columns, renamed to canonical names.

    A mapping naming a column that is not in the data is refused before any
    job runs.  Bookkeeping columns listed in ``keep`` (the row id) pass
    through when present.  The select right after the scan lets Catalyst
    prune every unmapped column out of the Parquet read.
    """
    pairs = mapped_fields(mapping, registry)
    present = set(df.columns)
    absent = [raw for raw, _ in pairs if raw not in present]
    if absent:
        raise MappingError(0, f"Mapped columns not found in dataset: {absent}")
    kept = [qcol(k) for k in keep if k in present]
    return df.select(*kept, *[qcol(raw).alias(f.canonical_name) for raw, f in pairs])
