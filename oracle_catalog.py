"""DuckDB SQL twins of the catalog queries (sample catalogs + catalog jobs).

Generated from the same constants as ``ledgerlens.sources.sample_catalog``
(headers, fault keys, registry ids) so both sides describe one dataset;
the semantics are restated in SQL and evaluated by DuckDB independently.
"""

from __future__ import annotations

from ledgerlens.functions.registry import registry
from ledgerlens.operators import mapping as M
from ledgerlens.sources import sample_catalog as SC


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def _py_list_sql(arr: str) -> str:
    # ['a', 'b'] rendering, like the Spark side
    return "'[''' || array_to_string(" + arr + ", ''', ''') || ''']'"


def catalog_ctes() -> str:
    headers = " ".join(f"WHEN {i} THEN {sql_list(h)}" for i, h in enumerate(SC.HEADER_VARIANTS))
    std = ", ".join(f"({v}, {q(r)}, {q(f)})" for v in range(4) for r, f in SC.variant_mapping(v))
    other = ", ".join([
        f"(TRUE, {q('Amount')}, {q(registry.id_of('amount'))})",
        f"(TRUE, {q('DrCr')}, {q(registry.id_of('debit_credit_indicator'))})",
        f"(FALSE, {q('Debit')}, {q(registry.id_of('debit_amount'))})",
        f"(FALSE, {q('Credit')}, {q(registry.id_of('credit_amount'))})",
    ])
    reg = ", ".join(f"({q(f.id)}, {q(f.canonical_name)})" for f in registry.all())
    mandatory = sql_list(f.canonical_name for f in registry.mandatory())
    return f"""ds AS (
  SELECT 'DS' || CAST(o_orderkey AS VARCHAR) AS dataset_id, o_orderkey AS dataset_key,
    'Company ' || CAST(o_custkey % 50 AS VARCHAR) AS company_name,
    CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, o_custkey % 100 AS uploaded_by_id,
    o_orderdate AS uploaded_at,
    o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS last_accessed_at,
    CAST(o_orderkey % 4 AS INTEGER) AS header_variant,
    sha256(array_to_string(list_sort(CASE CAST(o_orderkey % 4 AS INTEGER) {headers} END), ',')) AS signature
  FROM orders),
std AS (SELECT * FROM (VALUES {std}) AS t(variant, raw_column, field_id)),
other AS (SELECT * FROM (VALUES {other}) AS t(for_dc, raw_column, field_id)),
first_entries AS (
  SELECT ds.dataset_id, std.raw_column,
    CASE WHEN ds.dataset_key % {SC.FAULT_UNKNOWN_ID} = 0 AND std.raw_column = 'Currency' THEN 'fake-id'
         ELSE std.field_id END AS field_id
  FROM ds JOIN std ON std.variant = ds.header_variant
  WHERE NOT (ds.dataset_key % {SC.FAULT_NO_ACCOUNT} = 0 AND std.raw_column = 'Account')
    AND NOT (ds.dataset_key % {SC.FAULT_NO_AMOUNT_GROUP} = 0 AND std.raw_column IN ('Amount', 'Credit'))
  UNION ALL
  SELECT dataset_id, 'Extra', {q(registry.id_of('document_number'))} FROM ds
  WHERE dataset_key % {SC.FAULT_DUPLICATE} = 0
  UNION ALL
  SELECT ds.dataset_id, other.raw_column, other.field_id
  FROM ds JOIN other ON other.for_dc = (ds.header_variant = 2)
  WHERE ds.dataset_key % {SC.FAULT_BOTH_GROUPS} = 0),
entries AS (
  SELECT dataset_id, 1 AS save_no, raw_column, field_id FROM first_entries
  UNION ALL
  SELECT ds.dataset_id, 2, std.raw_column, std.field_id
  FROM ds JOIN std ON std.variant = ds.header_variant WHERE ds.dataset_key % {SC.RESAVE_EVERY} = 0),
save_times AS (
  SELECT dataset_id, 1 AS save_no, uploaded_at + to_minutes(CAST(dataset_key % 97 AS BIGINT)) AS saved_at FROM ds
  UNION ALL
  SELECT dataset_id, 2, uploaded_at + to_minutes(CAST(1440 AS BIGINT)) FROM ds
  WHERE dataset_key % {SC.RESAVE_EVERY} = 0),
reg AS (SELECT * FROM (VALUES {reg}) AS t(field_id, canonical_name)),
per_map AS (
  SELECT e.dataset_id, e.save_no,
    coalesce(list_sort(list_distinct(list(e.field_id) FILTER (WHERE reg.canonical_name IS NULL))), [])
      AS unknown_ids,
    count(*) AS n_entries, count(DISTINCT e.field_id) AS n_fields,
    coalesce(list_distinct(list(reg.canonical_name) FILTER (WHERE reg.canonical_name IS NOT NULL)), [])
      AS mapped
  FROM entries e LEFT JOIN reg ON reg.field_id = e.field_id
  GROUP BY e.dataset_id, e.save_no),
chk AS (
  SELECT *, list_filter({mandatory}, lambda x: NOT list_contains(mapped, x)) AS missing,
    list_contains(mapped, 'debit_amount') AND list_contains(mapped, 'credit_amount') AS dc,
    list_contains(mapped, 'amount') AND list_contains(mapped, 'debit_credit_indicator') AS ai
  FROM per_map),
violations AS (
  SELECT dataset_id, save_no, 1 AS rule, 'Invalid field ids: ' || {_py_list_sql('unknown_ids')} AS message
  FROM chk WHERE len(unknown_ids) > 0
  UNION ALL SELECT dataset_id, save_no, 2, {q(M.MSG_DUPLICATES)} FROM chk WHERE n_entries <> n_fields
  UNION ALL SELECT dataset_id, save_no, 3, 'Mandatory fields not mapped: ' || {_py_list_sql('missing')}
  FROM chk WHERE len(missing) > 0
  UNION ALL SELECT dataset_id, save_no, 4, {q(M.MSG_NO_AMOUNT_GROUP)} FROM chk WHERE NOT (dc OR ai)
  UNION ALL SELECT dataset_id, save_no, 5, {q(M.MSG_MIXED_GROUPS)} FROM chk WHERE dc AND ai),
status AS (
  SELECT k.dataset_id, k.save_no, coalesce(min(v.rule), 0) AS rule,
    coalesce(arg_min(v.message, v.rule), 'ok') AS message
  FROM (SELECT DISTINCT dataset_id, save_no FROM entries) k
  LEFT JOIN violations v ON v.dataset_id = k.dataset_id AND v.save_no = k.save_no
  GROUP BY k.dataset_id, k.save_no),
saves AS (
  SELECT e.dataset_id, e.save_no,
    array_to_string(list_sort(list(e.raw_column || '=' || e.field_id)), ';') AS mapping, t.saved_at
  FROM entries e JOIN save_times t ON t.dataset_id = e.dataset_id AND t.save_no = e.save_no
  GROUP BY e.dataset_id, e.save_no, t.saved_at),
valid AS (
  SELECT s.* FROM saves s JOIN status st ON st.dataset_id = s.dataset_id AND st.save_no = s.save_no
  WHERE st.rule = 0),
sig AS (
  SELECT signature, mapping, saved_at FROM (
    SELECT ds.signature, v.mapping, v.saved_at,
      row_number() OVER (PARTITION BY ds.signature ORDER BY v.saved_at, v.dataset_id) AS rn
    FROM valid v JOIN ds ON ds.dataset_id = v.dataset_id) WHERE rn = 1)"""


# The payload of each view that events open, written out as signed text with
# {name} for the field ids and @ for the dataset id.
_DIMENSION = '{{"axis":"row","field_id":"{0}"}}'
_MEASURE = '{{"aggregation":"{1}","field_id":"{0}"}}'
_CONDITION = '{{"field_id":"{0}","operator":"{1}","type":"condition","value":{2}}}'


def _rows(pattern: str, *rows: tuple) -> str:
    """Rendered rows, fields by id, in (id, second) order."""
    return ",".join(pattern.format(*r) for r in sorted((registry.id_of(r[0]), *r[1:]) for r in rows))


def _payload(dims: str, filters: str, measures: str, pivot: str = "") -> str:
    return f'{{"dataset_id":"@","dimensions":[{dims}],"filters":{filters},"measures":[{measures}]{pivot}}}'


def _conditions(op: str, *parts: str) -> str:
    # Groups sort their parts by JSON text with ", " and ": " separators.
    spaced = sorted(parts, key=lambda p: p.replace('":', '": ').replace(',"', ', "').replace("},{", "}, {"))
    return f'{{"conditions":[{",".join(spaced)}],"op":"{op}","type":"group"}}'


def _condition(name: str, op: str, value: str) -> str:
    return _CONDITION.format(registry.id_of(name), op, value)


def event_payloads() -> dict[str, str]:
    amount = lambda *aggs: _rows(_MEASURE, *[("amount", a) for a in aggs])       # noqa: E731
    tree = _conditions(
        "and",
        _conditions("or", _condition("currency", "=", '"USD"'), _condition("journal_type", "!=", '"Manual"')),
        _conditions("or"),
        _condition("posting_date", ">=", '"1996-01-01"'), _condition("posting_date", "<", '"2000-01-01"'),
        _condition("account_number", "not in", '["ACC-1","ACC-2","ACC-3"]'),
        _condition("debit_credit_indicator", "in", '["C","D"]'),
        _condition("amount", "is not null", "null"), _condition("amount", "!=", "0"), _condition("amount", "<=", "9000000"))
    pivot = _rows('{{"axis":"{1}","field_id":"{0}"}}', ("journal_type", "row"), ("debit_credit_indicator", "column"))
    return {
        "view": _payload("", "null", ""),
        "click": _payload(_rows(_DIMENSION, ("debit_credit_indicator",), ("posting_month",)),
                          _conditions("or", _condition("amount", ">=", "5000000"), _condition("amount", "<=", "-5000000")),
                          amount("count", "sum")),
        "purchase": _payload(_rows(_DIMENSION, ("journal_type",), ("posting_year",)), "null",
                             amount("avg", "count", "count_distinct", "max", "min", "sum")),
        "signup": _payload(_rows(_DIMENSION, ("approval_status",)), tree, amount("count", "sum")),
        "error": _payload(pivot, "null", amount("count", "sum"),
                          f',"pivot":{{"total":false,"values":{{"{registry.id_of("debit_credit_indicator")}":["D","C","UNKNOWN"]}}}}'),
    }


def view_signature_sql(payload: str) -> str:
    prefix, suffix = payload.split("@")
    return f"sha256({q(prefix)} || dataset_id || {q(suffix)})"


def catalog_oracle() -> dict[str, str]:
    w = "WITH " + catalog_ctes() + "\n"
    sig_case = " ".join(f"WHEN {q(t)} THEN {view_signature_sql(p)}" for t, p in event_payloads().items())
    return {
        "catalog_header_signatures": w + """
SELECT signature, count(*) AS n_datasets, min(header_variant) AS min_variant, max(header_variant) AS max_variant
FROM ds GROUP BY signature""",
        "catalog_mapping_violations": w + "SELECT dataset_id, save_no, rule, message FROM violations",
        "catalog_mapping_status": w + "SELECT dataset_id, save_no, rule, message FROM status",
        "catalog_current_mappings": w + """
SELECT dataset_id, arg_max(mapping, saved_at) AS mapping, max(saved_at) AS saved_at FROM valid GROUP BY dataset_id""",
        "catalog_signature_mappings": w + "SELECT signature, mapping, saved_at FROM sig",
        "catalog_suggested_mappings": w + """
SELECT ds.dataset_id, CASE WHEN sig.saved_at < ds.uploaded_at THEN sig.mapping ELSE '' END AS suggested_mapping
FROM ds LEFT JOIN sig ON sig.signature = ds.signature""",
        "catalog_latest_dataset": w + """
SELECT uploaded_by_id, dataset_id, last_accessed_at FROM (
  SELECT uploaded_by_id, dataset_id,
    max(last_accessed_at) OVER (PARTITION BY uploaded_by_id) AS last_accessed_at,
    row_number() OVER (PARTITION BY uploaded_by_id ORDER BY last_accessed_at DESC, dataset_id DESC) AS rn
  FROM ds) WHERE rn = 1""",
        "catalog_view_lineage": """
WITH RECURSIVE named AS (
  SELECT 'DS' || CAST(CASE WHEN event_id % 500 < 2 THEN event_id // 500 ELSE event_id // 700 END AS VARCHAR) AS dataset_id,
    CAST(event_id AS VARCHAR) AS view_id,
    CAST(CASE WHEN event_id % 500 = 0 THEN event_id + 1 WHEN event_id % 500 = 1 THEN event_id - 1
              WHEN event_type = 'view' THEN NULL WHEN event_id % 3 = 0 THEN event_id // 4 ELSE event_id - 3 END AS VARCHAR) AS named
  FROM events),
views AS (
  SELECT n.dataset_id, n.view_id, p.view_id AS parent_view_id
  FROM named n LEFT JOIN named p ON n.dataset_id = p.dataset_id AND n.named = p.view_id),
below AS (
  SELECT dataset_id, view_id, view_id AS root_view_id, CAST(0 AS BIGINT) AS depth FROM views WHERE parent_view_id IS NULL
  UNION ALL
  SELECT v.dataset_id, v.view_id, b.root_view_id, b.depth + 1
  FROM views v JOIN below b ON v.dataset_id = b.dataset_id AND v.parent_view_id = b.view_id)
SELECT v.dataset_id, v.view_id, v.parent_view_id, b.root_view_id, b.depth, b.view_id IS NULL AS cyclic
FROM views v LEFT JOIN below b USING (dataset_id, view_id)""",
        "catalog_views": f"""
WITH acc AS (
  SELECT dataset_id, CASE event_type {sig_case} END AS signature, user_id, ts AS accessed_at
  FROM (SELECT *, 'DS' || CAST(user_id % {SC.VIEW_DATASETS} AS VARCHAR) AS dataset_id FROM events))
SELECT dataset_id, signature, min(accessed_at) AS created_at, max(accessed_at) AS last_accessed_at,
  (list(user_id ORDER BY accessed_at, user_id))[1] AS created_by, count(*) AS accesses
FROM acc GROUP BY dataset_id, signature""",
    }
