"""Predicates: a row filter, and what of it an index can answer.

Only what stands under AND alone may prune; OR, NOT and <> contribute nothing to
pruning but are always re-applied to rows. Text hints (contains, match,
match_prefix) are allowed under AND alone."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skipscan.functions import text


class BadPredicate(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    op: str
    column: str | None = None
    value: object = None
    parts: tuple = ()

    def __and__(self, other: Node) -> Node:
        return Node("and", parts=(self, other))

    def __or__(self, other: Node) -> Node:
        return Node("or", parts=(self, other))

    def __invert__(self) -> Node:
        return Node("not", parts=(self,))


def _leaf(op: str):
    return lambda column, value: Node(op, column, value)


eq, ne, lt, lte, gt, gte, starts_with, like = map(_leaf, ("eq", "ne", "lt", "lte", "gt", "gte", "starts_with", "like"))
HINTS = ("contains", "match", "match_prefix")


def in_(column: str, values) -> Node:
    return Node("in", column, tuple(values))


def between(column: str, low, high) -> Node:
    return gte(column, low) & lte(column, high)


def _hint(op: str):
    def make(column: str, value: str) -> Node:
        if not isinstance(column, str) or not isinstance(value, str):
            raise BadPredicate(f"{op} takes one column and one string")
        return Node(op, column, value)

    return make


contains, match, match_prefix = map(_hint, HINTS)


def sql(text_of: str) -> Node:
    """A condition as SQL, which is applied to rows and prunes nothing."""
    return Node("sql", value=text_of)


def pruning(by: Node, text_of: str) -> Node:
    """A condition as SQL whose rows all meet `by`, which prunes for it."""
    return Node("pruned", value=text_of, parts=(by,))


def row_filter(p: Node) -> Column:
    c = F.col(p.column) if p.column else None
    if p.op in ("and", "or"):
        return reduce((lambda a, b: a & b) if p.op == "and" else (lambda a, b: a | b), map(row_filter, p.parts))
    if p.op == "not":
        return ~row_filter(p.parts[0])
    if p.op in ("sql", "pruned"):
        return F.expr(p.value)
    if p.op == "in":
        return c.isin(list(p.value))
    simple = {
        "eq": lambda: c == p.value, "ne": lambda: c != p.value, "lt": lambda: c < p.value, "lte": lambda: c <= p.value, "gt": lambda: c > p.value, "gte": lambda: c >= p.value,
        "starts_with": lambda: c.startswith(p.value), "like": lambda: c.like(p.value),
        "contains": lambda: text.contains_ci(c, p.value), "match": lambda: text.match(c, p.value), "match_prefix": lambda: text.match_prefix(c, p.value),
    }
    if p.op not in simple:
        raise BadPredicate(f"unknown operator {p.op}")
    return simple[p.op]()


def conjuncts(p: Node | None) -> list[Node]:
    """The leaves under AND alone; a hint anywhere else is refused."""
    if p is None:
        return []
    if p.op in ("and", "pruned"):
        return [x for part in p.parts for x in conjuncts(part)]
    if p.op in ("or", "not"):
        if any(_has_hint(x) for x in p.parts):
            raise BadPredicate("contains, match and match_prefix may stand under AND alone")
        return []
    return [] if p.op == "sql" else [p]


def _has_hint(p: Node) -> bool:
    return p.op in HINTS or p.op != "pruned" and any(map(_has_hint, p.parts))


@dataclass
class Range:
    """What >, >=, < and <= on a column leave; None is open."""

    low: str | None = None
    low_in: bool = True
    high: str | None = None
    high_in: bool = True

    def tighten(self, op: str, v: str) -> None:
        if op in ("gt", "gte") and (self.low is None or v > self.low or v == self.low and op == "gt"):
            self.low, self.low_in = v, op == "gte"
        if op in ("lt", "lte") and (self.high is None or v < self.high or v == self.high and op == "lt"):
            self.high, self.high_in = v, op == "lte"

    def over(self, c: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (c >= self.low if self.low_in else c > self.low)
        if self.high is not None:
            out = out & (c <= self.high if self.high_in else c < self.high)
        return out


def ranges(p: Node | None) -> dict[str, Range]:
    out: dict[str, Range] = {}
    for x in conjuncts(p):
        if x.op in ("lt", "lte", "gt", "gte") and isinstance(x.value, str):
            out.setdefault(x.column, Range()).tighten(x.op, x.value)
    return out


def token_regexp(column: str, pattern: str) -> Node | None:
    """The match hint of (^|[^a-z0-9])T([^a-z0-9]|$) over a lowered column, or None.

    Declined where T has k or i: lower() maps signs beyond ASCII to these, which
    the analyzer does not, so pruning could lose rows."""
    head, tail = "(^|[^a-z0-9])", "([^a-z0-9]|$)"
    if not (pattern.startswith(head) and pattern.endswith(tail)):
        return None
    term = pattern[len(head) : -len(tail)]
    if not re.fullmatch("[a-z0-9]+", term) or set(term) & {"k", "i"}:
        return None
    return match(column, term)
