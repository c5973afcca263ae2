"""Row validation rules.

A rule is a pair (fault condition, message).  The validate operator turns
the list into ``is_valid`` (a plain boolean: no rule fires) and
``error_messages`` (the messages of the rules that fire, in order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.functions.registry import Field

Rule = tuple[Column, str]

# FIXED VALUES: rule messages, "{name}" is the canonical field name.
MSG_REQUIRED = "{name} is required"
MSG_INTEGER = "{name} must be integer"
MSG_FLOAT = "{name} must be decimal number"
MSG_DATE = "{name} invalid date"


def required(name: str) -> Rule:
    return F.col(name).isNull(), MSG_REQUIRED.format(name=name)


def integer(name: str) -> Rule:
    c = F.col(name)
    return c.isNotNull() & text.parse_long(c).isNull(), MSG_INTEGER.format(name=name)


def decimal(name: str) -> Rule:
    c = F.col(name)
    return c.isNotNull() & text.parse_double(c).isNull(), MSG_FLOAT.format(name=name)


def date(name: str, formats=text.DEFAULT_DATE_FORMATS) -> Rule:
    c = F.col(name)
    return c.isNotNull() & text.parse_date(c, formats).isNull(), MSG_DATE.format(name=name)


def rules_for(field: Field, date_formats=text.DEFAULT_DATE_FORMATS) -> list[Rule]:
    """Rules of one mapped field, in order: required first, then its type rule.

    ``str`` and ``datetime`` fields only get the required rule.
    """
    out = []
    name = field.canonical_name
    if field.is_required:
        out.append(required(name))
    if field.dtype == "integer":
        out.append(integer(name))
    elif field.dtype == "float":
        out.append(decimal(name))
    elif field.dtype == "date":
        out.append(date(name, text.layouts_of(date_formats, name)))
    return out


def messages(rules: list[Rule]) -> Column:
    """``array<string>`` of the messages of firing rules, in rule order.

    Built as a concat of one- or zero-element arrays: unlike a filter with a
    lambda, this keeps the projection inside whole-stage codegen.
    """
    empty = F.array().cast("array<string>")
    if not rules:
        return empty
    return F.concat(*[F.when(cond, F.array(F.lit(msg))).otherwise(empty) for cond, msg in rules])


def passes(rules: list[Rule]) -> Column:
    """True when no rule fires (every condition is a non-null boolean)."""
    if not rules:
        return F.lit(True)
    fired = rules[0][0]
    for cond, _ in rules[1:]:
        fired = fired | cond
    return ~fired


def passes_filter(rules: list[Rule]) -> Column:
    """``passes`` for a filter on rows that are not stored.

    Inlined into a whole stage, the conditions and the expressions they read
    become one generated method of more than the 8000 bytes up to which a JVM
    compiles methods by default, and run interpreted.  A higher-order function
    keeps the filter out of the stage, so that it gets methods of its own and
    evaluates a repeated expression once.
    """
    if not rules:
        return F.lit(True)
    return passes(rules[1:]) & F.forall(F.array(rules[0][0]), lambda fired: ~fired)
