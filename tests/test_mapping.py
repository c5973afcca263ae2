import pytest

from ledgerlens.functions.registry import registry
from ledgerlens.operators.mapping import MappingError, apply_mapping, check_mapping


def test_valid_mapping(mapping):
    check_mapping(mapping)


def _rule(m):
    with pytest.raises(MappingError) as e:
        check_mapping(m)
    return e.value.rule, str(e.value)


def test_unknown_id(mapping):
    mapping["amount"] = "fake-id"
    assert _rule(mapping) == (1, "Invalid field ids: ['fake-id']")


def test_duplicate_id(mapping):
    mapping["test_column"] = list(mapping.values())[0]
    assert _rule(mapping) == (2, "Duplicate canonical fields in mapping")


def test_missing_mandatory(mapping):
    mapping.pop("account_number")
    assert _rule(mapping) == (3, "Mandatory fields not mapped: ['account_number']")


def test_debit_without_credit(mapping):
    mapping.pop("amount")
    mapping["debit_amount"] = registry.id_of("debit_amount")
    assert _rule(mapping)[0] == 4


def test_both_groups_complete(mapping):
    mapping["debit_amount"] = registry.id_of("debit_amount")
    mapping["credit_amount"] = registry.id_of("credit_amount")
    assert _rule(mapping) == (5, "Cannot mix debit/credit field groups. Use only one group.")


def test_partial_second_group_allowed(mapping):
    mapping["debit_amount"] = registry.id_of("debit_amount")
    check_mapping(mapping)


def test_apply_mapping_renames_and_prunes(spark):
    df = spark.createDataFrame([("1", "a", "x")], "row_id string, `Doc No` string, junk string")
    out = apply_mapping(df, {"Doc No": registry.id_of("document_number")})
    assert out.columns == ["row_id", "document_number"]


def test_apply_mapping_missing_raw_column(spark):
    df = spark.createDataFrame([("a",)], "DocNo string")
    with pytest.raises(MappingError, match="not found"):
        apply_mapping(df, {"Other": registry.id_of("document_number")})
