"""Detection rules: model, loader, condition grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml

from skipscan.functions import text

OPS = ("match", "contains", "equals", "equals_ignore_case", "starts_with", "ends_with", "re", "gt", "gte", "lt", "lte")
LEVELS = ("info", "low", "medium", "high", "critical")
RULE_KEYS = {"id", "title", "description", "level", "table", "column", "match", "contains", "where", "detection", "condition", "min_count", "window", "tags"}
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """A column held against values; any of them will do."""

    column: str
    op: str
    values: tuple


@dataclass(frozen=True)
class Cond:
    """and, or, not over parts, or a field."""

    op: str
    parts: tuple = ()
    field: Field | None = None


@dataclass(frozen=True)
class Window:
    ts_column: str
    timeframe_ms: int
    count: int
    group_by: tuple = ()


@dataclass(frozen=True)
class Rule:
    id: str
    table: str
    condition: Cond
    title: str = ""
    level: str = "medium"
    min_count: int = 1
    window: Window | None = None
    fields: tuple = field(default_factory=tuple)

    def columns(self) -> list[str]:
        own = [f.column for f in self.fields]
        if self.window:
            own += [self.window.ts_column, *self.window.group_by]
        return list(dict.fromkeys(own))

    def why_not_on_index(self) -> str | None:
        """Why the rule needs a row scan; None if the index alone decides it."""
        if self.window:
            return "it has a window"
        if len({f.column for f in self.fields}) != 1:
            return "it has several columns"
        if any(f.op not in ("match", "contains") for f in self.fields):
            return "an operator other than match and contains"
        flat = self.condition.field or all(p.field for p in self.condition.parts)
        if not flat or self.condition.op == "not":
            return "a nested condition"
        if self.condition.op == "and" and sum(len(f.values) for f in self.fields) > 1:
            return "all of several values may stand in different rows"
        return None


def duration_ms(s: str) -> int:
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", str(s))
    if not m:
        raise RuleError(f"{s!r} is not a time such as 5m")
    return int(m[1]) * UNITS[m[2]]


def checked(column: str, op: str, values) -> Field:
    values = values if isinstance(values, list) else [values]
    if op not in OPS:
        raise RuleError(f"unknown operator {op}")
    if not column or not values:
        raise RuleError("a field needs a column and a value")
    out = []
    for v in values:
        if isinstance(v, bool):
            raise RuleError(f"YAML reads {v} as true or false; put the value in quotes")
        if v is None or isinstance(v, (list, dict)):
            raise RuleError(f"{column}: a value is missing")
        s = str(v)
        if op == "match" and (len(t := text.query_terms(s)) != 1 or not text.indexable(t[0])):
            raise RuleError(f"match takes one token, and {s!r} is not one")
        if op == "contains" and len(s.encode("utf-16-le")) < 6:
            raise RuleError(f"contains takes three signs at least: {s!r}")
        if op in ("equals", "equals_ignore_case", "starts_with", "ends_with", "re") and not s:
            raise RuleError(f"{op} takes a value that is not empty")
        if op == "re":
            try:
                re.compile(s)
            except re.error as e:
                raise RuleError(f"{s!r}: {e}") from e
        if op in ("gt", "gte", "lt", "lte") and not re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", s):
            raise RuleError(f"{op} takes a number: {s!r}")
        out.append(s)
    return Field(column, op, tuple(out))


def _entries(doc) -> list[Field]:
    """Fields of a list or mapping of {column, op: value}, one for each operator."""
    out = []
    for entry in doc if isinstance(doc, list) else [doc]:
        if not isinstance(entry, dict) or "column" not in entry:
            raise RuleError("an entry needs a column")
        ops = [k for k in entry if k != "column"]
        if not ops:
            raise RuleError(f"{entry['column']}: no operator")
        out += [checked(entry["column"], op, entry[op]) for op in ops]
    return out


def joined(op: str, parts: list[Cond]) -> Cond:
    return parts[0] if len(parts) == 1 else Cond(op, tuple(parts))


def leaf(f: Field) -> Cond:
    return Cond("field", field=f)


_TOKEN = re.compile(r"\(|\)|[^\s()]+")


def parse_condition(s: str, selections: dict[str, Cond]) -> Cond:
    """or binds least, then and, then not; `1 of` and `all of` take `them` or a name ending in *."""
    words, at, used = _TOKEN.findall(s), 0, set()

    def peek() -> str | None:
        return words[at].lower() if at < len(words) else None

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise RuleError("the condition ends too early")
        at += 1
        return words[at - 1]

    def primary() -> Cond:
        w = take()
        low = w.lower()
        if w == "(":
            out = either()
            if take() != ")":
                raise RuleError("a bracket is not closed")
            return out
        if low in ("1", "all") and peek() == "of":
            take()
            pattern = take()
            names = [n for n in selections if pattern.lower() == "them" or n == pattern or pattern.endswith("*") and n.startswith(pattern[:-1])]
            if not names:
                raise RuleError(f"{pattern} names no selection")
            used.update(names)
            return joined("or" if low == "1" else "and", [selections[n] for n in names])
        if peek() == "of":
            raise RuleError(f"only 1 of and all of are known, not {w} of")
        if low in ("and", "or", "not", "of", ")") or w not in selections:
            raise RuleError(f"{w} is no selection")
        used.add(w)
        return selections[w]

    def negated() -> Cond:
        if peek() == "not":
            take()
            return Cond("not", (negated(),))
        return primary()

    def both() -> Cond:
        parts = [negated()]
        while peek() == "and":
            take()
            parts.append(negated())
        return joined("and", parts)

    def either() -> Cond:
        parts = [both()]
        while peek() == "or":
            take()
            parts.append(both())
        return joined("or", parts)

    out = either()
    if at < len(words):
        raise RuleError(f"unexpected {words[at]}")
    if unused := set(selections) - used:
        raise RuleError(f"unused: {', '.join(sorted(unused))}")
    return out


def rule_of(doc: dict) -> Rule:
    if not isinstance(doc, dict) or not doc.get("id") or not doc.get("table"):
        raise RuleError("a rule needs an id and a table")
    if unknown := set(doc) - RULE_KEYS:
        raise RuleError(f"unknown: {', '.join(sorted(map(str, unknown)))}")
    forms = [k for k in ("column", "where", "detection") if k in doc]
    if len(forms) != 1:
        raise RuleError("one of column, where and detection")
    quantifier = str(doc.get("condition", "any-of" if forms[0] != "detection" else ""))
    if forms[0] == "detection":
        selections = {n: joined("and", [leaf(f) for f in _entries(d)]) for n, d in doc["detection"].items() if n != "condition"}
        told = doc["detection"].get("condition") or doc.get("condition")
        if not selections or not told:
            raise RuleError("a detection needs selections and a condition")
        condition = parse_condition(str(told), selections)
    else:
        if quantifier not in ("any-of", "all-of"):
            raise RuleError("the condition is any-of or all-of")
        if forms[0] == "column":
            fields = [checked(doc["column"], op, v) for op in ("match", "contains") if op in doc for v in (doc[op] if isinstance(doc[op], list) else [doc[op]])]
            if not fields:
                raise RuleError("match or contains is needed")
        else:
            fields = _entries(doc["where"])
        condition = joined("and" if quantifier == "all-of" else "or", [leaf(f) for f in fields])
    window = None
    if "window" in doc:
        w = doc["window"]
        if set(w) - {"ts_column", "timeframe", "group_by", "count"} or not {"ts_column", "timeframe", "count"} <= set(w):
            raise RuleError("a window has ts_column, timeframe, count and perhaps group_by")
        if "min_count" in doc:
            raise RuleError("min_count or a window, not both")
        if not isinstance(w["count"], int) or w["count"] < 2:
            raise RuleError("a window counts two events at least")
        group = w.get("group_by") or []
        window = Window(w["ts_column"], duration_ms(w["timeframe"]), w["count"], tuple(group if isinstance(group, list) else [group]))
    level = doc.get("level", "medium")
    if level not in LEVELS:
        raise RuleError(f"unknown level {level}")
    least = doc.get("min_count", 1)
    if not isinstance(least, int) or least < 1:
        raise RuleError("min_count is a number from 1")
    return Rule(str(doc["id"]), str(doc["table"]), condition, str(doc.get("title", "")), level, least, window, tuple(fields_of(condition)))


def fields_of(c: Cond) -> list[Field]:
    if c.field:
        return [c.field]
    return list(dict.fromkeys(f for p in c.parts for f in fields_of(p)))


def load(source: str) -> tuple[list[Rule], list[str]]:
    """(rules, what was skipped and why) of a YAML text; a rule that is wrong skips itself alone."""
    docs = [d for d in yaml.safe_load_all(source) if d is not None]
    rules, skipped, seen = [], [], set()
    for d in (r for doc in docs for r in (doc.get("rules") if isinstance(doc, dict) and "rules" in doc else doc if isinstance(doc, list) else [doc])):
        name = d.get("id", "?") if isinstance(d, dict) else "?"
        try:
            rule = rule_of(d)
            if rule.id in seen:
                raise RuleError("the id has been used")
            seen.add(rule.id)
            rules.append(rule)
        except RuleError as e:
            skipped.append(f"{name}: {e}")
    return rules, skipped


class RuleFile:
    """Rules of a file, read again when it changes; a file that cannot be read as YAML leaves the rules as they were."""

    def __init__(self, path: str):
        self.path, self.at, self.rules, self.skipped = path, None, [], []

    def current(self) -> list[Rule]:
        import os

        if (at := os.stat(self.path).st_mtime_ns) != self.at:
            with open(self.path, encoding="utf-8") as f:
                try:
                    self.rules, self.skipped = load(f.read())
                except yaml.YAMLError as e:
                    self.skipped = [f"{self.path}: {e}"]
            self.at = at
        return self.rules
