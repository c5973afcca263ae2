"""View compiler: ViewSpec -> DataFrame plan.

scan -> filter (pushed to Parquet where the predicate is on stored columns)
-> groupBy/agg (partial aggregation before the exchange, so a hot group key
costs one row per task in the shuffle) -> optional pivot -> order -> page.

Permissions are checked on the driver while the plan is built: a field must
allow the role, aggregation or filter operator it is used with.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.registry import (
    ROLE_DIMENSION, ROLE_FILTER, ROLE_MEASURE, Field, FieldRegistry, UnknownFieldError,
    registry as default_registry,
)
from ledgerlens.operators.exact_sum import Bits, exact_avg, exact_sum, used_bits
from ledgerlens.operators.mapping import qcol
from ledgerlens.operators.rank_page import DEEP_OFFSET, page
from ledgerlens.plans.spec import Condition, Group, ViewError, ViewSpec
from ledgerlens.session import checkpointed, stored as stored_once

_AGG = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "count_distinct": F.count_distinct,
}


def resolve(registry: FieldRegistry, ref) -> Field:
    """Field by id; a canonical name is accepted as a convenience."""
    try:
        return registry.get_field(ref)
    except UnknownFieldError:
        try:
            return registry.by_name(str(ref))
        except UnknownFieldError:
            raise UnknownFieldError(f"Unknown field ID: {ref}") from None


def _require_column(df: DataFrame, f: Field) -> str:
    if f.canonical_name not in df.columns:
        raise ViewError(f"Field {f.canonical_name!r} is not a column of this dataset")
    return f.canonical_name


# ----------------------------------------------------------------- literals
def _literal(value, dtype: T.DataType) -> Column:
    """Bind a filter value as a literal of the column's type (never string
    concatenation).  Bad values are refused on the driver."""
    if value is None:
        return F.lit(None).cast(dtype)
    try:
        if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            if isinstance(value, float) and not value.is_integer():
                return F.lit(float(value))  # 1.5 against an integer column: compare as double
            # Compared as bigint, whatever the column's width; beyond that as a decimal.
            wide = -(1 << 63) <= int(value) < 1 << 63
            return F.lit(str(int(value))).cast("bigint" if wide else "decimal(38,0)")
        if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.lit(float(value)).cast(T.DoubleType())
        if isinstance(dtype, T.DateType):
            d = value if isinstance(value, _dt.date) else _dt.date.fromisoformat(str(value))
            return F.lit(d)
        if isinstance(dtype, T.BooleanType):
            if isinstance(value, str):
                if value.lower() not in ("true", "false"):
                    raise ValueError(value)
                return F.lit(value.lower() == "true")
            return F.lit(bool(value))
        if isinstance(dtype, T.StringType):
            return F.lit(str(value))
    except (TypeError, ValueError) as e:
        raise ViewError(f"Filter value {value!r} does not fit column type {dtype.simpleString()}") from e
    return F.lit(value)


# ------------------------------------------------------------------ filters
def compile_filter(df: DataFrame, node, registry: FieldRegistry = default_registry) -> Column | None:
    """Filter tree -> boolean Column; empty groups vanish, ``None`` = no filter."""
    if node is None:
        return None
    if isinstance(node, Group):
        parts = [c for c in (compile_filter(df, k, registry) for k in node.conditions) if c is not None]
        if not parts:
            return None
        return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)
    if isinstance(node, Condition):
        f = resolve(registry, node.field_id)
        if not f.allows_role(ROLE_FILTER):
            raise ViewError(f"{f.canonical_name} cannot be filtered: it lacks the filter role")
        if not f.allows_filter_operator(node.operator):
            raise ViewError(f"{f.canonical_name} cannot be filtered with {node.operator!r}: not allowed")
        name = _require_column(df, f)
        c, dtype = qcol(name), df.schema[name].dataType
        op, v = node.operator, node.value
        if op == "is null":
            return c.isNull()
        if op == "is not null":
            return c.isNotNull()
        if op in ("in", "not in"):
            members = c.isin(*[_literal(x, dtype) for x in v]) if v else F.lit(False)
            return ~members if op == "not in" else members
        lit = _literal(v, dtype)
        return {"=": c == lit, "!=": c != lit, ">": c > lit, ">=": c >= lit,
                "<": c < lit, "<=": c <= lit}[op]
    raise ViewError(f"Not a filter condition or group: {type(node).__name__}")


# ----------------------------------------------------------------- measures
MONEY_SCALE = 6


def _exact_decimal(c: Column, scale: int) -> Column:
    kind = f"decimal(38,{scale})"
    value = c.try_cast(kind)
    limit = f"exact money sums hold {38 - scale} digits before and {scale} after the point; choose another money_scale"
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(F.lit(limit)).cast(kind)).otherwise(value)


def _aggregate(agg: str, c: Column, scale: int | Bits | None) -> Column:
    if scale is not None and agg in ("sum", "avg"):
        # Independent of how partial sums are combined; back to double.
        if isinstance(scale, Bits):
            return exact_sum(c, scale) if agg == "sum" else exact_avg(c, scale)
        return _AGG[agg](_exact_decimal(c, scale)).cast("double")
    return _AGG[agg](c)


def _summed_bits(df: DataFrame, spec: ViewSpec, registry: FieldRegistry) -> dict[str, Bits]:
    """Bits of the ``float`` fields that the view sums or averages."""
    names = []
    for m in spec.measures:
        f = resolve(registry, m.field_id)
        if f.dtype == "float" and {"sum", "avg"} & set(m.aggregations) and f.canonical_name not in names:
            names.append(_require_column(df, f))
    return used_bits(df, names)


def compile_measures(df: DataFrame, spec: ViewSpec, registry: FieldRegistry = default_registry,
                     exact_money: bool = False, money_scale: int = MONEY_SCALE, bits: dict[str, Bits] | None = None):
    """[(output name, field name, aggregate Column)], named ``{field}_{agg}``.

    ``exact_money`` sums and averages ``float`` fields as decimals with
    ``money_scale`` digits after the point (each value is rounded to that
    first), so totals do not depend on the order in which partial sums meet.
    Values that do not fit fail with an error that names the limits.
    ``bits`` sums and averages the fields it holds exactly instead.
    An aggregation listed twice for a field counts once.
    """
    out = []
    for m in spec.measures:
        f = resolve(registry, m.field_id)
        if not f.allows_role(ROLE_MEASURE):
            raise ViewError(f"{f.canonical_name} cannot be aggregated: it lacks the measure role")
        for agg in m.aggregations:
            if not f.allows_aggregation(agg):
                raise ViewError(f"{agg} of {f.canonical_name} is not allowed")
            name = _require_column(df, f)
            alias = f"{name}_{agg}"
            if any(alias == a for a, _, _ in out):
                continue
            scale = (bits or {}).get(name, money_scale if exact_money and f.dtype == "float" else None)
            out.append((alias, name, _aggregate(agg, qcol(name), scale).alias(alias)))
    return out


def compile_dimensions(df: DataFrame, spec: ViewSpec, registry: FieldRegistry = default_registry):
    """[(column name, axis)] for the view's dimensions."""
    out = []
    for d in spec.dimensions:
        f = resolve(registry, d.field_id)
        if not f.allows_role(ROLE_DIMENSION):
            raise ViewError(f"{f.canonical_name} cannot be grouped by: it lacks the dimension role")
        out.append((_require_column(df, f), d.axis))
    return out


# -------------------------------------------------------------------- pivot
def pivot_values(df: DataFrame, col_dim: str, limit: int) -> list:
    """Distinct values of the pivot column, a null last, refused above ``limit``.

    The distinct runs as a partial + final aggregation; only up to
    ``limit + 1`` values ever reach the driver.
    """
    vals = [r[0] for r in df.select(qcol(col_dim)).distinct().limit(limit + 1).collect()]
    if len(vals) > limit:
        raise ViewError(f"Pivot column {col_dim!r} has more than {limit} values; list them, raise pivot_limit, "
                        "or leave pivot out for the long form")
    return sorted(v for v in vals if v is not None) + ([None] if None in vals else [])


def _pivot(df: DataFrame, rows: list[str], col_dim: str, values, measures, total: bool, limit: int,
           scales: dict, hidden: list[tuple[str, Column]]) -> DataFrame:
    """Column-axis dimension as columns named ``{value}_{field}_{agg}``
    (``null_...`` for rows without a value).

    Written as conditional aggregates: one pass, partial aggregation before
    the exchange, and SQL semantics for empty cells (count 0, sum null).
    ``total`` adds ``total_{field}_{agg}`` over all values of the row group;
    ``hidden`` are further aggregates the result is sorted by.
    """
    if values is None:
        values = pivot_values(df, col_dim, limit)
    key = qcol(col_dim)
    aggs = []
    for v in values:
        here = key.isNull() if v is None else key == F.lit(v)
        for alias, fname, _ in measures:
            agg = alias[len(fname) + 1:]
            aggs.append(_aggregate(agg, F.when(here, qcol(fname)), scales.get(fname))
                        .alias(f"{'null' if v is None else v}_{alias}"))
    if total:
        aggs += [c.alias(f"total_{alias}") for alias, _, c in measures]
    grouped = df.groupBy(*[qcol(r) for r in rows])
    return grouped.agg(*aggs, *[c.alias(name) for name, c in hidden])


# ---------------------------------------------------------- distinct counts
def _by_branches(df: DataFrame, keys: list[str], measures) -> DataFrame:
    """The grouped measures with one aggregation per counted field.

    Several distinct counts in one aggregation make Spark write every row once
    per counted field, with all of their columns, into its hash tables.  Here
    each counted field has a branch of its own that reads the keys and this
    field only; the first one carries the other aggregates.  A branch meets
    its (keys, value) pairs partially aggregated and spread by value, so a hot
    group is no hot task.  The branches' rows, one per group each, are united
    and folded by the keys (null keys alike), so no join is needed.
    """
    counted = list(dict.fromkeys(f for alias, f, _ in measures if alias == f"{f}_count_distinct"))
    if len(counted) < 2:
        return df.groupBy(*[qcol(k) for k in keys]).agg(*[c for _, _, c in measures])
    parts = []
    for i, name in enumerate(counted):
        mine = [(alias, c) for alias, f, c in measures
                if (alias == f"{name}_count_distinct" and f == name) or (i == 0 and alias != f"{f}_count_distinct")]
        # Named by place: a measure may be called like a key.
        parts.append(df.groupBy(*[qcol(k).alias(f"k{n}") for n, k in enumerate(keys)])
                     .agg(*[c.alias(f"m{[a for a, _, _ in measures].index(alias)}") for alias, c in mine]))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    folded = united.groupBy(*[F.col(f"k{n}") for n in range(len(keys))]).agg(
        *[F.max(f"m{n}").alias(f"m{n}") for n in range(len(measures))])
    return folded.select(*[F.col(f"k{n}").alias(k) for n, k in enumerate(keys)],
                         *[F.col(f"m{n}").alias(alias) for n, (alias, _, _) in enumerate(measures)])


# -------------------------------------------------------------------- order
def _sort_target(s, name: str, out: DataFrame, dims, measures) -> str:
    """The output column a sort entry means: a dimension, or a measure's
    aggregation (the named one, else the first listed)."""
    if s.aggregation is None and (name in [d for d, _ in dims]
                                  or (not dims and not measures and name in out.columns)):
        return name
    wanted = None if s.aggregation is None else f"{name}_{s.aggregation}"
    target = next((alias for alias, fname, _ in measures if fname == name and wanted in (None, alias)), None)
    if target is None:
        raise ViewError(f"Cannot sort by {wanted or name!r}: not part of the view output")
    return target


def _sort_columns(spec: ViewSpec, out: DataFrame, dims, measures, registry,
                  renamed: dict | None = None) -> tuple[list[tuple[str, bool]], set]:
    """[(column, ascending)] of the sort entries.  Nulls come last both ways,
    as SQL engines such as DuckDB do by default."""
    keys, names = [], set()
    for s in spec.sorting:
        target = _sort_target(s, resolve(registry, s.field_id).canonical_name, out, dims, measures)
        target = (renamed or {}).get(target, target)
        if target in names:
            continue
        names.add(target)
        keys.append((target, s.direction == "asc"))
    return keys, names


def _tiebreak(out: DataFrame, dims, measures, sorted_names: set) -> list[tuple[str, bool]]:
    """Keys that make the order total, so a page is deterministic."""
    if dims:
        names = [d for d, _ in dims if d in out.columns] or out.columns
    elif measures:
        return []                      # one row
    elif "row_id" in out.columns:
        names = ["row_id"]
    else:
        names = out.columns
    return [(n, True) for n in names if n not in sorted_names]


# ------------------------------------------------------------------ compile
def compile_view(df: DataFrame, spec: ViewSpec | dict, registry: FieldRegistry = default_registry,
                 exact_money: bool = False, money_scale: int = MONEY_SCALE, deep_offset: int = DEEP_OFFSET,
                 exact_sums: bool = False, stored: bool = False) -> DataFrame:
    """Result of a view.  A page from ``deep_offset`` on is found by rank
    selection, which runs a few counting jobs while the plan is built.

    ``exact_sums`` sums and averages ``float`` fields without any rounding but
    that of the result (``operators/exact_sum.py``), after one aggregation of
    the filtered rows that finds the bits they use.

    ``stored`` says that ``df`` is read from a table, so that reading a few of
    its columns again is cheap: several distinct counts then get an
    aggregation each (pivots keep the single one).  Otherwise rows that are
    read more than once, by a pivot that looks for its values or by a deep page,
    are written to the scratch folder while the plan is built.
    """
    if exact_money and exact_sums:
        raise ViewError("Choose exact_money or exact_sums, not both")
    if isinstance(spec, dict):
        spec = ViewSpec.from_dict(spec)
    dims = compile_dimensions(df, spec, registry)
    compile_measures(df, spec, registry)              # refused before any job
    predicate = compile_filter(df, spec.filters, registry)
    if predicate is not None:
        df = df.filter(predicate)
    bits = _summed_bits(df, spec, registry) if exact_sums else {}
    measures = compile_measures(df, spec, registry, exact_money, money_scale, bits)

    row_dims = [d for d, axis in dims if axis == "row"]
    col_dims = [d for d, axis in dims if axis == "column"]
    sort_dims, sort_measures, renamed = dims, measures, {}
    if spec.pivot and col_dims and measures:
        if len(col_dims) > 1:
            raise ViewError("Pivot supports one column-axis dimension")
        f = resolve(registry, next(x.field_id for x in spec.dimensions if x.axis == "column"))
        values = spec.pivot_values.get(f.id, spec.pivot_values.get(f.canonical_name))
        if values is None and not stored:
            # Read twice, for the values and for the cells: the columns in use are computed once.
            used = list(dict.fromkeys([d for d, _ in dims] + [fname for _, fname, _ in measures]))
            df = stored_once(df.select(*[qcol(c) for c in used]), "pivot")
        scales = bits or {fname: money_scale for _, fname, _ in measures
                          if exact_money and resolve(registry, fname).dtype == "float"}
        # A pivot is sorted by a measure over all its columns: its total.
        sort_dims = dims = [(d, "row") for d in row_dims]
        wanted = [(alias, c) for alias, fname, c in measures
                  if any(resolve(registry, s.field_id).canonical_name == fname for s in spec.sorting)]
        renamed = {alias: f"_sort_{alias}" for alias, _ in wanted}
        out = _pivot(df, row_dims, col_dims[0], values, measures, spec.pivot_total, spec.pivot_limit, scales,
                     [(renamed[alias], c) for alias, c in wanted])
        measures = []
    elif measures and stored:
        out = _by_branches(df, [d for d, _ in dims], measures)
    elif dims and measures:
        out = df.groupBy(*[qcol(d) for d, _ in dims]).agg(*[c for _, _, c in measures])
    elif dims:
        out = df.select(*[qcol(d) for d, _ in dims]).distinct()
    elif measures:
        out = df.agg(*[c for _, _, c in measures])
    else:
        out = df

    keys, sorted_names = _sort_columns(spec, out, sort_dims, sort_measures, registry, renamed)
    if spec.pagination is not None:
        if not (dims or measures or stored) and spec.pagination.offset >= deep_offset:
            out = stored_once(out, "deep-page")             # every count reads one column of it
        if (dims or measures) and keys and spec.pagination.offset >= deep_offset:
            out = checkpointed(out)       # aggregated once, then counted and sorted
        out = page(out, keys + _tiebreak(out, dims, measures, sorted_names), spec.pagination.offset, spec.pagination.limit, deep_offset)
    elif keys:
        out = out.orderBy(*[qcol(n).asc_nulls_last() if up else qcol(n).desc_nulls_last() for n, up in keys])
    return out.drop(*renamed.values())
