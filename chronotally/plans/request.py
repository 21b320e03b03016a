"""Requests: a tree of conditions, cut into what chooses the store, what chooses the mask, and a filter on tags."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.masks import ROLLED_UP
from ..functions.text import Period, parse_time_ms
from .model import PRECISION, TIME, StatConfig, UnsupportedRequest

Node = Mapping[str, Any]


@dataclass(frozen=True)
class Criteria:
    """A request resolved: times, the asked grain if any, tags that the filter and the output need, and tags rolled up."""

    config: StatConfig
    period: Period = Period()
    precision: intervals.Interval | None = None
    tree: Node | None = None
    filtered: frozenset[str] = frozenset()
    requested: tuple[str, ...] = ()
    rolled_up: frozenset[str] = field(default_factory=frozenset)


def term(name: str, condition: str, value: str | None, enabled: bool = True) -> Node:
    return {"field": name, "condition": condition, "value": value, "enabled": enabled}


def tree(op: str, *children: Node, enabled: bool = True) -> Node:
    return {"op": op, "children": list(children), "enabled": enabled}


def prune(node: Node | None) -> Node | None:
    """Without disabled terms and branches and without branches that are left empty."""
    if node is None or not node.get("enabled", True):
        return None
    if "op" not in node:
        return node
    children = [c for c in map(prune, node.get("children", [])) if c is not None]
    if node["op"] == "NOT" and len(children) > 1:
        raise UnsupportedRequest("NOT takes one child")
    return {**node, "children": children} if children else None


def collapse(node: Node | None) -> Node | None:
    """AND and OR of one child become the child."""
    if node is None or "op" not in node:
        return node
    children = [c for c in map(collapse, node["children"]) if c is not None]
    if not children:
        return None
    return children[0] if len(children) == 1 and node["op"] != "NOT" else {**node, "children": children}


def with_params(node: Node | None, params: Mapping[str, str]) -> Node | None:
    """Values with ${name} replaced."""
    if node is None:
        return None
    if "op" in node:
        return {**node, "children": [with_params(c, params) for c in node.get("children", [])]}
    value = node.get("value")
    return {**node, "value": re.sub(r"\$\{(\w+)\}", lambda m: params.get(m[1], m[0]), value)} if isinstance(value, str) else node


def terms(node: Node | None) -> list[Node]:
    if node is None:
        return []
    return [t for c in node["children"] for t in terms(c)] if "op" in node else [node]


def _special(root: Node | None, name: str) -> Node | None:
    """The one term on a field that only a direct child of an AND root may have."""
    found = [t for t in terms(root) if t.get("field") == name]
    if not found:
        return None
    if len(found) > 1:
        raise UnsupportedRequest(f"{name} may stand in one term only")
    if root is not found[0] and not (root.get("op") == "AND" and any(c is found[0] for c in root["children"])):
        raise UnsupportedRequest(f"{name} must be a direct child of AND at the root")
    return found[0]


def period_of(date: Node | None, now_ms: int, zone: str = "UTC") -> Period:
    """Half-open, so every inclusive end goes one ms on."""
    if date is None:
        return Period()
    condition, parts = date["condition"], [parse_time_ms(p, now_ms, zone) for p in (date.get("value") or "").split(",")]
    if condition == "BETWEEN":
        if len(parts) != 2 or parts[0] > parts[1]:
            raise UnsupportedRequest("BETWEEN takes two times, the earlier first")
        return Period(parts[0], parts[1] + 1)
    if len(parts) != 1:
        raise UnsupportedRequest(f"{condition} takes one time")
    [t] = parts
    known = {"EQUALS": (t, t + 1), "LESS_THAN": (None, t), "LESS_THAN_OR_EQUAL_TO": (None, t + 1), "GREATER_THAN": (t + 1, None), "GREATER_THAN_OR_EQUAL_TO": (t, None)}
    if condition not in known:
        raise UnsupportedRequest(f"{TIME} knows no {condition}")
    return Period(*known[condition])


def resolve(config: StatConfig, root: Node | None, requested: list[str], now_ms: int, zone: str = "UTC", params: Mapping[str, str] | None = None) -> Criteria:
    root = prune(with_params(root, params or {}))
    for t in terms(root):
        if not t.get("field"):
            raise UnsupportedRequest("a term needs a field")
        if t["field"] in config.static_fields() and t["field"] not in (TIME, PRECISION):
            raise UnsupportedRequest(f"{t['field']} cannot be queried")
    date, precision = _special(root, TIME), _special(root, PRECISION)
    if precision is not None and precision["condition"] != "EQUALS":
        raise UnsupportedRequest(f"{PRECISION} knows EQUALS only")
    rolled = [t for t in terms(root) if config.is_tag(t["field"]) and t.get("value") == ROLLED_UP]
    names = frozenset(t["field"] for t in rolled)
    if names and not config.supports(names):
        raise UnsupportedRequest(f"{sorted(names)} are not rolled up together")
    gone = [t for t in (date, precision, *rolled) if t is not None]

    def left(node: Node | None) -> Node | None:
        if node is None or any(node is g for g in gone):
            return None
        return {**node, "children": [c for c in map(left, node["children"]) if c is not None]} if "op" in node else node

    rest = collapse(left(root))
    return Criteria(
        config,
        period_of(date, now_ms, zone),
        intervals.interval(precision["value"]) if precision else None,
        rest,
        frozenset(t["field"] for t in terms(rest) if config.is_tag(t["field"])),
        tuple(f for f in config.fields if f in requested),
        names,
    )


def condition(node: Node | None, column: Callable[[str], Column | None]) -> Column:
    """The filter, always true or false: a term on a missing tag is false, and NOT of it true. `column` gives a tag's column
    or None for a tag that is not there, which nothing equals."""
    if node is None:
        return F.lit(True)
    if "op" in node:
        parts = [condition(c, column) for c in node["children"]]
        if node["op"] == "NOT":
            return ~parts[0]
        if node["op"] not in ("AND", "OR"):
            raise UnsupportedRequest(f"no such operator: {node['op']}")
        return reduce(and_ if node["op"] == "AND" else or_, parts)
    tag, value = column(node["field"]), node.get("value")
    if node["condition"] not in ("EQUALS", "IN"):
        raise UnsupportedRequest(f"tags know no {node['condition']}")
    if tag is None:
        return F.lit(False)
    wanted = [value] if value is None or node["condition"] == "EQUALS" else value.split(",")
    found = [v for v in wanted if v]
    # both forms are never null, and both reach the scan
    parts = [tag.eqNullSafe(found[0]) if len(found) == 1 else tag.isNotNull() & tag.isin(found)] if found else []
    return reduce(or_, parts + ([tag.isNull()] if len(found) < len(wanted) else []))
