"""Sums of doubles that do not depend on the order of their rows.

Each value is split into integer limbs of ``WIDTH`` bits at fixed powers of
two, and each limb is summed as a long: integer sums are exact, so partial sums
may meet in any order.  The limb totals are carried, and their exact value is
rounded to a double once (to nearest, ties to even), per group.

The powers cover the bits that the columns really use.  One aggregation finds
their smallest and largest magnitude first; amounts of cents up to a billion
need five limbs, the whole range of doubles 105.  Both passes together took two to three
times as long as a plain sum.

Rows: a limb is at most 2^20, so 2^42 rows of one group and task order fit;
beyond that Spark's long sum fails (ANSI mode) instead of wrapping.
NaN and infinities behave as in a plain sum; nulls are left out; a group
without values gives null; a sum beyond the doubles gives infinity, though one
that only passes it on the way does not.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.mapping import qcol

WIDTH = 20
_MASK = (1 << WIDTH) - 1
_LOWEST = -1074             # exponent of the last bit of a double
_SPAN = 900                 # bits that scaling crosses without overflow


class Bits(NamedTuple):
    """Powers of two: of the last bit any value has, and above every value."""
    low: int
    high: int
    finite: bool = False        # no NaN or infinity among the values

    @property
    def limbs(self) -> int:
        return max(1, -(-(self.high - self.low) // WIDTH))


def _finite(c: Column) -> Column:
    return F.abs(c) < F.lit(math.inf)                # NaN is above infinity


def used_bits(df: DataFrame, columns: list[str]) -> dict[str, Bits]:
    """The bits that each double column uses, by one aggregation of ``df``.

    A column without values other than 0 gets the bits of 1.0, one with NaN or
    infinities all bits above its smallest.
    """
    aggs = []
    for i, name in enumerate(columns):
        size = F.abs(qcol(name).cast("double"))
        aggs += [F.min(F.when((size > 0) & _finite(size), size)).alias(f"min{i}"), F.max(size).alias(f"max{i}")]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {name: bits_of(row[f"min{i}"], row[f"max{i}"]) for i, name in enumerate(columns)}


def bits_of(smallest: float | None, largest: float | None) -> Bits:
    """Bits of all doubles between two magnitudes."""
    smallest, largest = smallest or 1.0, largest or 1.0
    finite = math.isfinite(largest)
    return Bits(max(_LOWEST, math.frexp(smallest)[1] - 53), math.frexp(largest)[1] if finite else 1024, finite)


def _scaled(c: Column, power: int) -> Column:
    """c * 2^power, in steps that are doubles themselves."""
    while power > 1000:
        c, power = c * F.lit(math.ldexp(1.0, 1000)), power - 1000
    return c * F.lit(math.ldexp(1.0, power))


def _limb(c: Column, bits: Bits, k: int) -> Column:
    """Bits [low + k WIDTH, low + (k+1) WIDTH) of a value, rounded to nearest.

    The difference of the two rounded quotients is an integer of at most WIDTH
    bits, so both the subtraction and the limbs' sum are exact.
    """
    here = bits.low + k * WIDTH
    above = here + WIDTH
    value = F.rint(_scaled(c, -here))
    if k + 1 < bits.limbs:
        value = value - F.rint(_scaled(c, -above)) * F.lit(float(1 << WIDTH))
    if bits.high - bits.low > _SPAN and above + 54 < 1024:
        # Larger values have no bits here, and scaling them might overflow.
        value = F.when(F.abs(c) < F.lit(math.ldexp(1.0, above + 54)), value).otherwise(F.lit(0.0))
    return value.cast("bigint")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _carried(limbs: Column) -> Column:
    """Digits of WIDTH bits, and what is carried out of the last (below 0 for a negative total)."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    return F.aggregate(limbs, start, lambda acc, x: F.struct(
        F.shiftright(acc["carry"] + x, WIDTH).alias("carry"),
        F.concat(acc["digits"], F.array((acc["carry"] + x).bitwiseAND(F.lit(_MASK).cast("bigint")))).alias("digits")))


def _rounded(digits: Column, low: int, count: int) -> Column:
    """The double next to a number given by its digits, three zeros first.

    The four leading digits hold at least 61 bits.  One addition rounds them;
    its last bit stands for whatever the lower digits hold, which decides ties.
    """
    scales = []
    for top in range(count):
        power = low + WIDTH * (top - 3)
        first = min(max(power, -1000), 900)
        scales.append((first, power - first))
    first = F.array(*[F.lit(math.ldexp(1.0, a)) for a, _ in scales])
    second = F.array(*[F.lit(math.ldexp(1.0, b)) for _, b in scales])
    step = F.lit(1 << WIDTH).cast("bigint")
    last = F.array_max(F.transform(digits, lambda x, i: F.when(x != 0, i).otherwise(F.lit(0))))

    def at(top: Column) -> Column:
        head = digits[top + 3] * step + digits[top + 2]
        rest = digits[top + 1] * step + digits[top]
        below = F.exists(F.slice(digits, F.lit(1), top), lambda x: x != 0)
        rest = rest.bitwiseOR(F.when(below, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        number = head.cast("double") * F.lit(float(1 << 2 * WIDTH)) + rest.cast("double")
        return number * first[top] * second[top]

    return _let(F.greatest(last - 3, F.lit(0)), at)


def exact_sum(c: Column, bits: Bits) -> Column:
    """Aggregate: the sum of a double column rounded once."""
    c = c.cast("double")
    finite = c if bits.finite else F.when(_finite(c), c)
    zero = F.lit(0).cast("bigint")
    # a total has up to 63 bits above its limb: three more digits take them
    limbs = F.array(*[F.sum(_limb(finite, bits, k)) for k in range(bits.limbs)], zero, zero, zero)
    count = bits.limbs + 3

    def total(x: Column) -> Column:
        negative = x["first"]["carry"] < 0
        digits = F.when(negative, _carried(F.transform(x["limbs"], lambda v: -v))["digits"]).otherwise(x["first"]["digits"])
        padded = F.concat(F.array(zero, zero, zero), digits)
        return F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0)) * _let(padded, lambda d: _rounded(d, bits.low, count))

    value = F.when(F.count(finite) > 0, _let(limbs, lambda v: _let(
        F.struct(v.alias("limbs"), _carried(v).alias("first")), total)))
    if bits.finite:
        return value
    odd = F.sum(F.when(c.isNotNull() & ~_finite(c), c))
    return F.coalesce(odd, value)


def exact_avg(c: Column, bits: Bits) -> Column:
    """Aggregate: the exact sum, rounded, by the number of values."""
    return exact_sum(c, bits) / F.nullif(F.count(c), F.lit(0)).cast("double")


def exact_sums(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Exact sums of double columns by group: {output name: column}.

    Null keys form a group of their own; no keys give one row.
    """
    bits = used_bits(df, sorted(set(columns.values())))
    return df.groupBy(*[qcol(k) for k in keys]).agg(
        *[exact_sum(qcol(c), bits[c]).alias(name) for name, c in columns.items()])
