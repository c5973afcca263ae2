"""Journal-entry tests expressed as view requests.

The application names three tests (postings above materiality, weekend
postings, postings by given users) and a pivot with a total column; each is
an ordinary view over the transformed table, so no new operator is needed.
A first-digit (Benford) distribution is the same kind of view over the
``first_digit`` helper column.
"""

from __future__ import annotations

from ledgerlens.functions.registry import registry
from ledgerlens.plans.spec import ViewSpec


def _id(name: str) -> str:
    return registry.id_of(name)


def above_materiality(threshold: float, by: str = "account_number") -> ViewSpec:
    """Count and total of lines whose absolute amount reaches ``threshold``."""
    return ViewSpec.from_dict({
        "dimensions": [{"field_id": _id(by), "axis": "row"}],
        "measures": [{"field_id": _id("abs_amount"), "aggregations": ["count", "sum", "max"]}],
        "filters": {"op": "and", "conditions": [
            {"field_id": _id("abs_amount"), "operator": ">=", "value": threshold}]},
    })


def weekend_postings(by: str = "posting_weekday") -> ViewSpec:
    """Lines posted on Saturday (6) or Sunday (7)."""
    return ViewSpec.from_dict({
        "dimensions": [{"field_id": _id(by), "axis": "row"}],
        "measures": [{"field_id": _id("amount"), "aggregations": ["count", "sum"]}],
        "filters": {"op": "and", "conditions": [
            {"field_id": _id("posting_weekday"), "operator": "in", "value": [6, 7]}]},
    })


def postings_by_users(users: list[str]) -> ViewSpec:
    """Lines created by the given users (e.g. administrator accounts)."""
    return ViewSpec.from_dict({
        "dimensions": [{"field_id": _id("user_id"), "axis": "row"},
                       {"field_id": _id("journal_type"), "axis": "row"}],
        "measures": [{"field_id": _id("amount"), "aggregations": ["count", "sum"]}],
        "filters": {"op": "and", "conditions": [
            {"field_id": _id("user_id"), "operator": "in", "value": list(users)}]},
    })


def first_digit_distribution() -> ViewSpec:
    """Lines and money per leading digit of the absolute amount."""
    return ViewSpec.from_dict({
        "dimensions": [{"field_id": _id("first_digit"), "axis": "row"}],
        "measures": [{"field_id": _id("abs_amount"), "aggregations": ["count", "sum"]}],
    })


def pivot_with_total(row: str, column: str, values: list, measure: str = "amount",
                     aggregations=("sum",)) -> ViewSpec:
    """``measure`` per ``row`` value, one column per ``column`` value, plus totals."""
    return ViewSpec.from_dict({
        "dimensions": [{"field_id": _id(row), "axis": "row"},
                       {"field_id": _id(column), "axis": "column"}],
        "measures": [{"field_id": _id(measure), "aggregations": list(aggregations)}],
        "pivot": True,
        "pivot_values": {_id(column): list(values)},
        "pivot_total": True,
    })
