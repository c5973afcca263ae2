"""Deep pages by rank selection: only the rows near a page are sorted.

A page far into a sorted result would make a top-k of everything before it, or
a sort of the whole.  Instead the sort keys are taken one after the other and
the interval of key values that holds the page is narrowed: a few split points
are drawn from the interval, one aggregation over the key column counts the
rows before and at each of them (partial counts only are shuffled), and the
interval shrinks to the values around the page's first and last rank.  If that
is one value that many rows share, the next key goes on among them; a page that
reaches over two such values is put together from both.  What is left is sorted; everything before it has been counted.

The counts are exact, so the page is the one a full sort gives; the drawn
points only decide how fast the interval shrinks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.mapping import qcol

DEEP_OFFSET = 10_000        # pages before this are a top-k of that many rows
PAGE_ROWS = 20_000          # an interval of at most this many rows is sorted
SPLIT_POINTS = 32
_DRAWN = 4_096              # rows drawn to choose split points from, about


def _order(name: str, ascending: bool) -> Column:
    return qcol(name).asc_nulls_last() if ascending else qcol(name).desc_nulls_last()


def _split_points(rows: DataFrame, name: str, ascending: bool, n: int) -> list:
    """Up to SPLIT_POINTS different values of a column, in its sort order."""
    known = rows.where(qcol(name).isNotNull()).select(qcol(name).alias("k"))
    if n > _DRAWN:
        known = known.sample(False, _DRAWN / n, seed=n % 1009)
    drawn = [r[0] for r in known.limit(2 * _DRAWN).distinct().orderBy(_order("k", ascending)).collect()]
    if not drawn:                         # mostly nulls: whatever value there is
        drawn = [r[0] for r in rows.where(qcol(name).isNotNull()).select(qcol(name)).limit(1).collect()]
    if len(drawn) <= SPLIT_POINTS:
        return drawn
    return [drawn[(i * (len(drawn) - 1)) // (SPLIT_POINTS - 1)] for i in range(SPLIT_POINTS)]


def _segments(rows: DataFrame, name: str, ascending: bool, points: list) -> list[tuple[int, int, int]]:
    """(kind, point, rows) of an interval's pieces in sort order: kind 0 lies
    before point i and after the one before it, kind 1 is point i itself, kind
    2 follows the last point, kind 3 are nulls."""
    key, counts = qcol(name), []
    for i, p in enumerate(points):
        value = F.lit(p)
        counts += [F.count_if(key < value if ascending else key > value).alias(f"b{i}"), F.count_if(key == value).alias(f"e{i}")]
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("known"), *counts).first()
    out, before = [], 0
    for i in range(len(points)):
        out += [(0, i, row[f"b{i}"] - before), (1, i, row[f"e{i}"])]
        before = row[f"b{i}"] + row[f"e{i}"]
    return [*out, (2, len(points), row["known"] - before), (3, len(points), row["n"] - row["known"])]


def _within(name: str, ascending: bool, points: list, first: tuple, last: tuple) -> Column:
    """Condition for the values from segment ``first`` to segment ``last``."""
    key = qcol(name)

    def after(p, at):
        return (key >= p if at else key > p) if ascending else (key <= p if at else key < p)

    def upto(p, at):
        return (key <= p if at else key < p) if ascending else (key >= p if at else key > p)

    if first[0] == 3:
        return key.isNull()
    known = key.isNotNull()
    if first[0] == 1:
        known = known & after(F.lit(points[first[1]]), True)
    elif first[1] > 0:
        known = known & after(F.lit(points[first[1] - 1]), False)
    if last[0] < 2:
        known = known & upto(F.lit(points[last[1]]), last[0] == 1)
    return known | key.isNull() if last[0] == 3 else known


def parts(rows: DataFrame, keys: Sequence[tuple[str, bool]], offset: int, limit: int, n: int,
          page_rows: int = PAGE_ROWS) -> list[tuple[DataFrame, int, int]]:
    """The page as (rows, offset, limit) of disjoint intervals in the order of
    ``keys``, of at most ``page_rows`` (or ``limit``) rows each, unless more
    rows agree in every key.  ``rows`` has ``n`` rows."""
    if offset >= n:
        return [(rows.where(F.lit(False)), 0, limit)]
    if n <= max(page_rows, limit) or not keys:
        return [(rows, offset, limit)]
    name, ascending = keys[0]
    points = _split_points(rows, name, ascending, n)
    pieces = _segments(rows, name, ascending, points)
    ends, total = [], 0
    for *_, size in pieces:
        total += size
        ends.append(total)
    first = next(j for j, end in enumerate(ends) if end > offset)
    last = next(j for j, end in enumerate(ends) if end >= min(offset + limit, total))
    before = offset - (ends[first] - pieces[first][2])
    if first < last and ends[last] - (offset - before) <= max(page_rows, limit):
        return [(rows.where(_within(name, ascending, points, pieces[first], pieces[last])), before, limit)]
    out, left = [], limit
    for piece in pieces[first:last + 1]:
        if piece[2]:
            # One value, or nulls: the next key decides among its rows.
            rest = keys[1:] if piece[0] in (1, 3) else keys
            take = min(left, piece[2] - before)
            out += parts(rows.where(_within(name, ascending, points, piece, piece)), rest, before, take, piece[2], page_rows)
            left, before = left - take, 0
    return out


def page(df: DataFrame, keys: Sequence[tuple[str, bool]], offset: int, limit: int, deep_offset: int = DEEP_OFFSET,
         page_rows: int = PAGE_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in the order of ``keys``
    ((column, ascending), nulls last)."""
    if not keys:                          # one row needs no order
        return (df.offset(offset) if offset else df).limit(limit)
    found = parts(df, keys, offset, limit, df.count(), page_rows) if offset >= deep_offset else [(df, offset, limit)]
    order = [_order(*k) for k in keys]
    pages = [(rows.orderBy(*order).offset(o) if o else rows.orderBy(*order)).limit(n) for rows, o, n in found]
    return pages[0] if len(pages) == 1 else reduce(DataFrame.unionByName, pages).orderBy(*order)
