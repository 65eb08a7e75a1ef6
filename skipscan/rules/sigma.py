"""Sigma rules to rules of this package: plain YAML in, rule documents out; what has no counterpart is refused by name."""

from __future__ import annotations

import yaml

from skipscan.rules.model import RuleError

LEVELS = {"informational": "low", "low": "low", "medium": "medium", "high": "high", "critical": "critical"}
REFUSED_TYPES = ("value_count", "temporal", "temporal_ordered", "value_sum", "value_avg", "value_median", "value_percentile")
NUMBER_OPS = ("lt", "lte", "gt", "gte")


class Refused(RuleError):
    pass


class Pipeline:
    """Where a log source's rows are: table, time column and names of fields."""

    def __init__(self, table: str, ts_column: str | None = None, fields: dict[str, str] | None = None, category=None, product=None, service=None):
        if not (category or product or service):
            raise RuleError("a pipeline needs a category, product or service")
        self.table, self.ts_column, self.fields = table, ts_column, fields or {}
        self.source = {k: v for k, v in (("category", category), ("product", product), ("service", service)) if v}

    def takes(self, source: dict) -> bool:
        return all(source.get(k) == v for k, v in self.source.items())


def _value(v, modifiers: list[str]) -> tuple[str, object]:
    for m in modifiers:
        if m in NUMBER_OPS:
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise Refused(f"|{m} takes a number")
            return m, v
    if "re" in modifiers:
        return "re", v
    if v is None:
        raise Refused("null values")
    if isinstance(v, bool):
        return "equals", str(v).lower()
    if isinstance(v, (int, float)):
        return "equals", v
    for m, shape in (("contains", "*{}*"), ("startswith", "{}*"), ("endswith", "*{}")):
        if m in modifiers:
            v = shape.format(v)
    if "?" in v.replace("\\?", ""):
        raise Refused("? as a wildcard")
    lead, trail = v.startswith("*"), v.endswith("*") and not v.endswith("\\*")
    core = v[1 if lead else 0 : -1 if trail and len(v) > 1 else None]
    if not core.strip("*"):
        raise Refused("* alone")
    if "*" in core.replace("\\*", ""):
        raise Refused("* inside a value")
    core = core.replace("\\*", "*").replace("\\?", "?").replace("\\\\", "\\")
    op = "contains" if lead and trail else "starts_with" if trail else "ends_with" if lead else "equals" if "cased" in modifiers else "equals_ignore_case"
    return op, core


def _selection(name: str, doc, pipeline: Pipeline) -> dict[str, list[dict]]:
    """Selections of entries; a list of mappings is several of them."""
    maps = doc if isinstance(doc, list) else [doc]
    out = {}
    for i, m in enumerate(maps):
        if not isinstance(m, dict):
            raise Refused("keywords without a field")
        entries = []
        for key, v in m.items():
            column, *modifiers = key.split("|")
            for bad in ("cidr", "exists", "fieldref", "base64", "base64offset", "utf16", "wide", "windash", "expand", "minute", "hour", "day", "week", "month", "year"):
                if bad in modifiers:
                    raise Refused(f"|{bad}")
            column = pipeline.fields.get(column, column)
            by_op: dict[str, list] = {}
            for x in v if isinstance(v, list) else [v]:
                op, told = _value(x, modifiers)
                by_op.setdefault(op, []).append(told)
            if "all" in modifiers:
                entries += [{"column": column, op: x} for op, xs in by_op.items() for x in xs]
            elif len(by_op) > 1:
                raise Refused("values of several kinds in one field")
            else:
                entries += [{"column": column, op: xs if len(xs) > 1 else xs[0]} for op, xs in by_op.items()]
        out[name if len(maps) == 1 else f"{name}_{i}"] = entries
    return out


def convert(source: str, pipeline: Pipeline) -> list[dict]:
    """Rule documents of a Sigma YAML text (rules, then correlations on them)."""
    docs = [d for d in yaml.safe_load_all(source) if d]
    rules, out = {}, []
    for d in docs:
        if "correlation" in d:
            continue
        if not pipeline.takes(d.get("logsource", {})):
            raise Refused(f"log source {d.get('logsource')}")
        detection = dict(d["detection"])
        condition = detection.pop("condition", None)
        if not isinstance(condition, str):
            raise Refused("several conditions")
        if "timeframe" in detection or "|" in condition:
            raise Refused("aggregation in a condition")
        selections: dict = {}
        for name, s in detection.items():
            made = _selection(name, s, pipeline)
            selections |= made
            if list(made) != [name]:
                condition = " ".join("( " + " or ".join(made) + " )" if w == name else w for w in condition.replace("(", " ( ").replace(")", " ) ").split())
        doc = {"id": d.get("name") or d.get("id") or d["title"], "title": d.get("title", ""), "level": LEVELS.get(d.get("level", "medium"), "medium"), "table": pipeline.table, "detection": selections | {"condition": condition}}
        rules[doc["id"]] = doc
        out.append(doc)
    for d in docs:
        if "correlation" not in d:
            continue
        c = d["correlation"]
        if c["type"] in REFUSED_TYPES or c["type"] != "event_count":
            raise Refused(f"correlation {c['type']}")
        base = c["rules"] if isinstance(c["rules"], list) else [c["rules"]]
        if len(base) != 1 or base[0] not in rules:
            raise Refused("a correlation of several rules")
        if len(c["condition"]) != 1 or (op := next(iter(c["condition"]))) not in ("gte", "gt"):
            raise Refused("a count other than gte and gt")
        n = c["condition"][op] + (op == "gt")
        if n < 2:
            raise Refused("a count below two")
        if not pipeline.ts_column:
            raise Refused("a correlation without a time column")
        made = dict(rules[base[0]])
        out = [x for x in out if x is not made and x["id"] != made["id"]]
        group = [pipeline.fields.get(g, g) for g in c.get("group-by", [])]
        made |= {"id": d.get("name") or d.get("id") or d["title"], "title": d.get("title", ""), "level": LEVELS.get(d.get("level", "medium"), "medium"), "window": {"ts_column": pipeline.ts_column, "timeframe": c["timespan"], "count": n} | ({"group_by": group} if group else {})}
        out.append(made)
    return out


def to_yaml(docs: list[dict]) -> str:
    return yaml.safe_dump({"rules": docs}, sort_keys=False, allow_unicode=True)
