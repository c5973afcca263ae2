"""View request: dimensions, measures, filter tree, sorting, page.

Plain immutable dataclasses built from the JSON request shape.  The spec is
driver-side metadata; ``ledgerlens.operators.view.compile_view`` turns it
into a DataFrame plan.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any, Union

from ledgerlens.functions.registry import AGGREGATIONS, FILTER_OPERATORS


class ViewError(ValueError):
    pass


AXES = ("row", "column")
LOGICAL_OPS = ("and", "or")
DIRECTIONS = ("asc", "desc")


def _choice(value, allowed, what):
    v = str(value).lower() if value is not None else None
    if v not in allowed:
        raise ViewError(f"Invalid {what}: {value!r}; expected one of {list(allowed)}")
    return v


@dataclass(frozen=True)
class Condition:
    field_id: str
    operator: str
    value: Any = None

    def __post_init__(self):
        object.__setattr__(self, "field_id", str(self.field_id))
        object.__setattr__(self, "operator", _choice(self.operator, FILTER_OPERATORS, "filter operator"))
        if self.operator in ("in", "not in") and not isinstance(self.value, (list, tuple)):
            raise ViewError(f"Operator {self.operator!r} needs a list value")
        if isinstance(self.value, list):
            object.__setattr__(self, "value", tuple(self.value))

    def canonical(self) -> dict:
        value = self.value
        if isinstance(value, tuple):          # a null, or values of mixed kinds, still have one order
            try:
                value = sorted(value)
            except TypeError:
                value = sorted(value, key=lambda x: (type(x).__name__, json.dumps(x, default=str)))
        return {"type": "condition", "field_id": self.field_id, "operator": self.operator, "value": value}


@dataclass(frozen=True)
class Group:
    op: str
    conditions: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "op", _choice(self.op, LOGICAL_OPS, "logical operator"))
        object.__setattr__(self, "conditions", tuple(self.conditions))

    def canonical(self) -> dict:
        by_text = {json.dumps(c, sort_keys=True): c for c in (k.canonical() for k in self.conditions)}
        texts = sorted(json.dumps(k.canonical(), sort_keys=True) for k in self.conditions)
        return {"type": "group", "op": self.op, "conditions": [by_text[t] for t in texts]}


Node = Union[Condition, Group]


@dataclass(frozen=True)
class Dimension:
    field_id: str
    axis: str = "row"

    def __post_init__(self):
        object.__setattr__(self, "field_id", str(self.field_id))
        object.__setattr__(self, "axis", _choice(self.axis, AXES, "axis"))


@dataclass(frozen=True)
class Measure:
    field_id: str
    aggregations: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "field_id", str(self.field_id))
        object.__setattr__(self, "aggregations",
                           tuple(_choice(a, AGGREGATIONS, "aggregation") for a in self.aggregations))

    def expand(self):
        """One (field_id, aggregation) pair per aggregation."""
        return [(self.field_id, a) for a in self.aggregations]


@dataclass(frozen=True)
class Sort:
    field_id: str
    direction: str = "asc"
    aggregation: str | None = None            # of a measure; None: the first one listed

    def __post_init__(self):
        object.__setattr__(self, "field_id", str(self.field_id))
        if self.aggregation is not None:
            object.__setattr__(self, "aggregation", _choice(self.aggregation, AGGREGATIONS, "aggregation"))
        object.__setattr__(self, "direction", _choice(self.direction, DIRECTIONS, "sorting direction"))


@dataclass(frozen=True)
class Page:
    limit: int
    offset: int = 0

    def __post_init__(self):
        if int(self.limit) < 0 or int(self.offset) < 0:
            raise ViewError("limit and offset must be >= 0")
        object.__setattr__(self, "limit", int(self.limit))
        object.__setattr__(self, "offset", int(self.offset))


@dataclass(frozen=True)
class ViewSpec:
    dimensions: tuple = ()
    measures: tuple = ()
    filters: Group | None = None
    sorting: tuple = ()
    pagination: Page | None = None
    # Column-axis dimensions are grouped like row ones (long form) unless
    # ``pivot`` is set; pivot values may be given per field id.
    pivot: bool = False
    pivot_values: dict = field(default_factory=dict, compare=False, hash=False)
    pivot_total: bool = False
    # Most columns a pivot without listed values may get; more are refused.
    pivot_limit: int = 1000
    # The view this one was derived from; no part of its identity.
    parent_view_id: str | None = field(default=None, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "dimensions", tuple(self.dimensions))
        object.__setattr__(self, "measures", tuple(self.measures))
        object.__setattr__(self, "sorting", tuple(self.sorting))

    # ------------------------------------------------------------------ parse
    @classmethod
    def from_dict(cls, d: dict) -> "ViewSpec":
        return cls(
            dimensions=[Dimension(x["field_id"], x.get("axis", "row")) for x in d.get("dimensions") or []],
            measures=[Measure(x["field_id"], x.get("aggregations") or []) for x in d.get("measures") or []],
            filters=parse_node(d["filters"]) if d.get("filters") else None,
            sorting=[Sort(x["field_id"], x.get("sorting_direction", x.get("direction", "asc")), x.get("aggregation"))
                     for x in d.get("sorting") or []],
            pagination=Page(d["pagination"]["limit"], d["pagination"].get("offset", 0))
            if d.get("pagination") else None,
            pivot=bool(d.get("pivot", False)),
            pivot_values={str(k): list(v) for k, v in (d.get("pivot_values") or {}).items()},
            pivot_total=bool(d.get("pivot_total", False)),
            pivot_limit=int(d.get("pivot_limit", 1000)),
            parent_view_id=str(d["parent_view_id"]) if d.get("parent_view_id") else None,
        )

    @classmethod
    def from_json(cls, s: str) -> "ViewSpec":
        return cls.from_dict(json.loads(s))

    def to_dict(self) -> dict:
        d = {
            "dimensions": [{"field_id": x.field_id, "axis": x.axis} for x in self.dimensions],
            "measures": [{"field_id": x.field_id, "aggregations": list(x.aggregations)} for x in self.measures],
            "filters": node_to_dict(self.filters) if self.filters is not None else None,
            "sorting": [{"field_id": x.field_id, "sorting_direction": x.direction,
                         **({"aggregation": x.aggregation} if x.aggregation else {})} for x in self.sorting],
            "pagination": {"limit": self.pagination.limit, "offset": self.pagination.offset}
            if self.pagination else None,
        }
        if self.pivot:
            d.update(pivot=True, pivot_values={k: list(v) for k, v in self.pivot_values.items()},
                     pivot_total=self.pivot_total, pivot_limit=self.pivot_limit)
        if self.parent_view_id:
            d["parent_view_id"] = self.parent_view_id
        return d

    def expanded_measures(self):
        """(field_id, aggregation) pairs; a measure without aggregations is skipped."""
        return [pair for m in self.measures for pair in m.expand()]

    # -------------------------------------------------------------- identity
    def signature(self, dataset_id) -> str:
        """SHA-256 of the canonical JSON of the view's logical content.

        Equal views get equal signatures: filter-group children are sorted,
        list values sorted, dimensions and measures sorted; sorting and
        paging are not part of a view's identity.
        """
        return hashlib.sha256(canonical_json(self, dataset_id).encode("utf-8")).hexdigest()


def parse_node(d: dict) -> Node:
    if "field_id" in d:
        return Condition(d["field_id"], d["operator"], d.get("value"))
    if "op" in d:
        return Group(d["op"], [parse_node(c) for c in d.get("conditions") or []])
    raise ViewError(f"A filter node needs a field_id or an op: {d}")


def node_to_dict(node: Node) -> dict:
    if isinstance(node, Condition):
        v = list(node.value) if isinstance(node.value, tuple) else node.value
        return {"field_id": node.field_id, "operator": node.operator, "value": v}
    return {"op": node.op, "conditions": [node_to_dict(c) for c in node.conditions]}


# FIXED VALUES: canonical form hashed for a view signature.  Payload keys
# dataset_id / filters / dimensions / measures; condition nodes
# {"type": "condition", field_id, operator, value (lists sorted)}; group nodes
# {"type": "group", op, conditions (sorted by their JSON with sorted keys)};
# dimensions {field_id, axis} sorted by (field_id, axis); measures expanded to
# {field_id, aggregation} sorted by (field_id, aggregation); serialised with
# sorted keys and "," / ":" separators.  A pivot adds its own key.
def canonical_json(spec: ViewSpec, dataset_id) -> str:
    payload = {
        "dataset_id": str(dataset_id),
        "filters": spec.filters and spec.filters.canonical(),
        "dimensions": [{"field_id": f, "axis": a} for f, a in sorted((d.field_id, d.axis) for d in spec.dimensions)],
        "measures": [{"field_id": f, "aggregation": a} for f, a in sorted(spec.expanded_measures())],
    }
    if spec.pivot:
        payload["pivot"] = {"values": spec.pivot_values, "total": spec.pivot_total}
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))
