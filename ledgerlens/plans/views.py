"""Headline view requests over the transformed sample journal, with the
equivalent SQL (over a ``transformed`` relation) used by the DuckDB oracle.

Requests reference fields by id, exactly like API clients do.
"""

from __future__ import annotations

from ledgerlens.functions.registry import DERIVED_FIELDS, registry
from ledgerlens.plans import presets
from ledgerlens.sources.sample import SAMPLE_HEADER


def _id(name: str) -> str:
    return registry.id_of(name)


def _dim(name, axis="row"):
    return {"field_id": _id(name), "axis": axis}


def _m(name, *aggs):
    return {"field_id": _id(name), "aggregations": list(aggs)}


def _c(name, op, value=None):
    return {"field_id": _id(name), "operator": op, "value": value}


VIEWS: dict[str, dict] = {
    # Flagship: money by indicator and month, large postings either sign.
    "view_flagship": {
        "dimensions": [_dim("debit_credit_indicator"), _dim("posting_month")],
        "measures": [_m("amount", "sum", "count")],
        "filters": {"op": "or", "conditions": [_c("amount", ">=", 5_000_000), _c("amount", "<=", -5_000_000)]},
    },
    # All six aggregations on one measure.
    "view_all_aggregations": {
        "dimensions": [_dim("journal_type"), _dim("posting_year")],
        "measures": [_m("amount", "sum", "avg", "min", "max", "count", "count_distinct")],
    },
    # Integer measure, IN and range filter on it.
    "view_line_number_measures": {
        "dimensions": [_dim("currency")],
        "measures": [_m("line_number", "sum", "avg", "min", "max", "count", "count_distinct")],
        "filters": {"op": "and", "conditions": [_c("line_number", "in", [1, 2, 3, 4]), _c("line_number", ">", 1)]},
    },
    # Dimensions only: distinct combinations.
    "view_dimensions_only": {
        "dimensions": [_dim("currency"), _dim("journal_type"), _dim("debit_credit_indicator")],
    },
    # Measures only: one global row.
    "view_measures_only": {
        "dimensions": [],
        "measures": [_m("amount", "sum", "count", "min", "max"), _m("line_number", "sum")],
    },
    # Nested filter tree using every comparison kind; the empty group vanishes.
    "view_filter_tree": {
        "dimensions": [_dim("approval_status")],
        "measures": [_m("amount", "count", "sum")],
        "filters": {"op": "and", "conditions": [
            {"op": "or", "conditions": [_c("currency", "=", "USD"), _c("journal_type", "!=", "Manual")]},
            {"op": "or", "conditions": []},
            _c("posting_date", ">=", "1996-01-01"),
            _c("posting_date", "<", "2000-01-01"),
            _c("account_number", "not in", ["ACC-1", "ACC-2", "ACC-3"]),
            _c("debit_credit_indicator", "in", ["D", "C"]),
            _c("amount", "is not null"),
            _c("amount", "!=", 0),
            _c("amount", "<=", 9_000_000),
        ]},
    },
    # Sorted, paged result (total order through the group key).
    "view_sorted_page": {
        "dimensions": [_dim("account_number")],
        "measures": [_m("amount", "sum", "count")],
        "filters": {"op": "or", "conditions": [_c("amount", "is null"), _c("amount", ">", 0)]},
        "sorting": [{"field_id": _id("amount"), "sorting_direction": "desc"},
                    {"field_id": _id("account_number"), "sorting_direction": "asc"}],
        "pagination": {"limit": 20, "offset": 5},
    },
    # Column axis as pivot with explicit values.
    "view_pivot": {
        "dimensions": [_dim("journal_type"), _dim("debit_credit_indicator", "column")],
        "measures": [_m("amount", "sum", "count")],
        "pivot": True,
        "pivot_values": {_id("debit_credit_indicator"): ["D", "C", "UNKNOWN"]},
    },
    # Pivot over the values found, a column for rows without one included, and
    # sorted by a measure's total.
    "view_pivot_sorted": {
        "dimensions": [_dim("approval_status"), _dim("posting_hour", "column")],
        "measures": [_m("amount", "count", "sum")],
        "filters": {"op": "or", "conditions": [_c("posting_hour", "is null"), _c("posting_hour", "<", 2)]},
        "sorting": [{"field_id": _id("amount"), "sorting_direction": "desc", "aggregation": "sum"}],
        "pagination": {"limit": 2, "offset": 0},
        "pivot": True,
        "pivot_total": True,
    },
    # Sorted by an aggregation that is not the first one listed.
    "view_sorted_by_avg": {
        "dimensions": [_dim("user_id")],
        "measures": [_m("amount", "sum", "count", "avg", "sum")],
        "sorting": [{"field_id": _id("amount"), "sorting_direction": "asc", "aggregation": "avg"}],
        "pagination": {"limit": 7, "offset": 3},
    },
    # A page of the one global row.
    "view_measures_only_page": {
        "dimensions": [],
        "measures": [_m("amount", "count", "max"), _m("line_number", "min")],
        "pagination": {"limit": 5, "offset": 0},
    },
    # Column axis without pivot: grouped like a row dimension (long form).
    "view_column_axis_long": {
        "dimensions": [_dim("journal_category"), _dim("posting_year", "column")],
        "measures": [_m("amount", "avg")],
    },
    # Rows, sorted and paged: ties broken on every remaining column (no row id here).
    "view_select_all_page": {
        "dimensions": [],
        "filters": {"op": "and", "conditions": [_c("journal_type", "=", "Manual")]},
        "sorting": [{"field_id": _id("amount"), "sorting_direction": "desc"}],
        "pagination": {"limit": 25, "offset": 40},
    },
    # A page deep in all rows, sorted by a field that many share: rank selection.
    "view_select_all_deep_page": {
        "dimensions": [],
        "sorting": [{"field_id": _id("posting_date"), "sorting_direction": "desc"}],
        "pagination": {"limit": 25, "offset": 48_000},
    },
    # No dimensions, no measures: every column of the matching rows.
    "view_select_all": {
        "dimensions": [],
        "filters": {"op": "and", "conditions": [_c("journal_type", "=", "Manual"), _c("amount", ">=", 10_000_000)]},
    },
}

# Journal-entry tests as views.
VIEWS["view_above_materiality"] = presets.above_materiality(9_000_000).to_dict()
VIEWS["view_weekend_postings"] = presets.weekend_postings().to_dict()
VIEWS["view_users_postings"] = presets.postings_by_users(["USR00", "USR01"]).to_dict()
VIEWS["view_first_digit"] = presets.first_digit_distribution().to_dict()
_pt = presets.pivot_with_total("approval_status", "currency", ["USD", "EUR"], "amount", ("sum", "count"))
VIEWS["view_pivot_total"] = _pt.to_dict()


# Over a stored table.
DISTINCT_COUNTS = {
    "dimensions": [_dim("currency"), _dim("posting_year")],
    "measures": [_m("amount", "count_distinct", "sum"), _m("abs_amount", "count_distinct", "max"),
                 _m("line_number", "count_distinct", "count")],
}
DISTINCT_COUNTS_ORACLE = """
SELECT currency, posting_year, count(DISTINCT amount) AS amount_count_distinct, sum(amount) AS amount_sum,
       count(DISTINCT abs_amount) AS abs_amount_count_distinct, max(abs_amount) AS abs_amount_max,
       count(DISTINCT line_number) AS line_number_count_distinct, count(line_number) AS line_number_count
FROM transformed GROUP BY currency, posting_year"""


# Column order of the transformed sample table: canonical fields in export
# order, then the helper columns in registry order.
TRANSFORMED_COLUMNS = list(SAMPLE_HEADER.values()) + [f.canonical_name for f in DERIVED_FIELDS]
_TIEBREAK = ", ".join(f"{c} ASC NULLS LAST" for c in TRANSFORMED_COLUMNS if c != "amount")

ORACLE: dict[str, str] = {
    "view_select_all_page": f"""
SELECT * FROM transformed WHERE (journal_type = 'Manual')
ORDER BY amount DESC NULLS LAST, {_TIEBREAK}
LIMIT 25 OFFSET 40""",
    "view_select_all_deep_page": f"""
SELECT * FROM transformed ORDER BY posting_date DESC NULLS LAST, {_TIEBREAK.replace('posting_date ASC NULLS LAST, ', '')}
LIMIT 25 OFFSET 48000""",
    "view_flagship": """
SELECT debit_credit_indicator, posting_month, sum(amount) AS amount_sum, count(amount) AS amount_count
FROM transformed WHERE (amount >= 5000000 OR amount <= -5000000)
GROUP BY debit_credit_indicator, posting_month""",
    "view_all_aggregations": """
SELECT journal_type, posting_year, sum(amount) AS amount_sum, avg(amount) AS amount_avg,
       min(amount) AS amount_min, max(amount) AS amount_max, count(amount) AS amount_count,
       count(DISTINCT amount) AS amount_count_distinct
FROM transformed GROUP BY journal_type, posting_year""",
    "view_line_number_measures": """
SELECT currency, CAST(sum(line_number) AS BIGINT) AS line_number_sum, avg(line_number) AS line_number_avg,
       min(line_number) AS line_number_min, max(line_number) AS line_number_max,
       count(line_number) AS line_number_count, count(DISTINCT line_number) AS line_number_count_distinct
FROM transformed WHERE (line_number IN (1, 2, 3, 4) AND line_number > 1) GROUP BY currency""",
    "view_dimensions_only": """
SELECT DISTINCT currency, journal_type, debit_credit_indicator FROM transformed""",
    "view_measures_only": """
SELECT sum(amount) AS amount_sum, count(amount) AS amount_count, min(amount) AS amount_min,
       max(amount) AS amount_max, CAST(sum(line_number) AS BIGINT) AS line_number_sum
FROM transformed""",
    "view_filter_tree": """
SELECT approval_status, count(amount) AS amount_count, sum(amount) AS amount_sum
FROM transformed
WHERE ((currency = 'USD' OR journal_type <> 'Manual')
   AND posting_date >= DATE '1996-01-01' AND posting_date < DATE '2000-01-01'
   AND account_number NOT IN ('ACC-1', 'ACC-2', 'ACC-3')
   AND debit_credit_indicator IN ('D', 'C')
   AND amount IS NOT NULL AND amount <> 0 AND amount <= 9000000)
GROUP BY approval_status""",
    "view_sorted_page": """
SELECT account_number, sum(amount) AS amount_sum, count(amount) AS amount_count
FROM transformed WHERE (amount IS NULL OR amount > 0)
GROUP BY account_number
ORDER BY amount_sum DESC NULLS LAST, account_number ASC NULLS LAST
LIMIT 20 OFFSET 5""",
    "view_pivot": """
SELECT journal_type,
       sum(amount) FILTER (WHERE debit_credit_indicator = 'D') AS D_amount_sum,
       count(amount) FILTER (WHERE debit_credit_indicator = 'D') AS D_amount_count,
       sum(amount) FILTER (WHERE debit_credit_indicator = 'C') AS C_amount_sum,
       count(amount) FILTER (WHERE debit_credit_indicator = 'C') AS C_amount_count,
       sum(amount) FILTER (WHERE debit_credit_indicator = 'UNKNOWN') AS UNKNOWN_amount_sum,
       count(amount) FILTER (WHERE debit_credit_indicator = 'UNKNOWN') AS UNKNOWN_amount_count
FROM transformed GROUP BY journal_type""",
    "view_pivot_sorted": """
SELECT approval_status,
       count(amount) FILTER (WHERE posting_hour = 0) AS "0_amount_count", sum(amount) FILTER (WHERE posting_hour = 0) AS "0_amount_sum",
       count(amount) FILTER (WHERE posting_hour = 1) AS "1_amount_count", sum(amount) FILTER (WHERE posting_hour = 1) AS "1_amount_sum",
       count(amount) FILTER (WHERE posting_hour IS NULL) AS null_amount_count,
       sum(amount) FILTER (WHERE posting_hour IS NULL) AS null_amount_sum,
       count(amount) AS total_amount_count, sum(amount) AS total_amount_sum
FROM transformed WHERE (posting_hour IS NULL OR posting_hour < 2)
GROUP BY approval_status ORDER BY sum(amount) DESC NULLS LAST, approval_status ASC NULLS LAST LIMIT 2""",
    "view_sorted_by_avg": """
SELECT user_id, sum(amount) AS amount_sum, count(amount) AS amount_count, avg(amount) AS amount_avg
FROM transformed GROUP BY user_id ORDER BY avg(amount) ASC NULLS LAST, user_id ASC NULLS LAST LIMIT 7 OFFSET 3""",
    "view_measures_only_page": """
SELECT count(amount) AS amount_count, max(amount) AS amount_max, min(line_number) AS line_number_min FROM transformed""",
    "view_column_axis_long": """
SELECT journal_category, posting_year, avg(amount) AS amount_avg
FROM transformed GROUP BY journal_category, posting_year""",
    "view_select_all": """
SELECT * FROM transformed WHERE (journal_type = 'Manual' AND amount >= 10000000)""",
    "view_above_materiality": """
SELECT account_number, count(abs_amount) AS abs_amount_count, sum(abs_amount) AS abs_amount_sum,
       max(abs_amount) AS abs_amount_max
FROM transformed WHERE (abs_amount >= 9000000) GROUP BY account_number""",
    "view_weekend_postings": """
SELECT posting_weekday, count(amount) AS amount_count, sum(amount) AS amount_sum
FROM transformed WHERE (posting_weekday IN (6, 7)) GROUP BY posting_weekday""",
    "view_users_postings": """
SELECT user_id, journal_type, count(amount) AS amount_count, sum(amount) AS amount_sum
FROM transformed WHERE (user_id IN ('USR00', 'USR01')) GROUP BY user_id, journal_type""",
    "view_first_digit": """
SELECT first_digit, count(abs_amount) AS abs_amount_count, sum(abs_amount) AS abs_amount_sum
FROM transformed GROUP BY first_digit""",
    "view_pivot_total": """
SELECT approval_status,
       sum(amount) FILTER (WHERE currency = 'USD') AS USD_amount_sum,
       count(amount) FILTER (WHERE currency = 'USD') AS USD_amount_count,
       sum(amount) FILTER (WHERE currency = 'EUR') AS EUR_amount_sum,
       count(amount) FILTER (WHERE currency = 'EUR') AS EUR_amount_count,
       sum(amount) AS total_amount_sum, count(amount) AS total_amount_count
FROM transformed GROUP BY approval_status""",
}
