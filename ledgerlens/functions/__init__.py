"""Column-expression building blocks: registry, parsing, rules, helpers."""

from ledgerlens.functions.registry import (  # noqa: F401
    CORE_FIELDS, DERIVED_FIELDS, Field, FieldRegistry, UnknownFieldError, registry, registry_frame,
)
