"""Rules as Columns, and as SQL that finds the same rows again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipscan.functions import kinds, text
from skipscan.rules.model import Cond, Field, Rule, RuleError

FIRST_POSITIONS, PINNED, STRETCH = 5, 500, 65_536


def _member(op: str, v: Column, value: str, kind: str) -> Column:
    if op == "match":
        return F.array_contains(text.tokens(v), text.query_terms(value)[0])
    if op == "equals":
        told = kinds.canonical_literal(value, kind) if kind in kinds.INDEXABLE - {kinds.BINARY} else value
        return v == (value if told is None else told)
    if op in ("gt", "gte", "lt", "lte"):
        n, to = v.try_cast("decimal(38,18)"), F.lit(value).cast("decimal(38,18)")
        return {"gt": n > to, "gte": n >= to, "lt": n < to, "lte": n <= to}[op]
    low, lit = F.lower(v), value.lower()
    return {"contains": low.contains(lit), "equals_ignore_case": low == lit, "starts_with": low.startswith(lit), "ends_with": low.endswith(lit), "re": v.rlike(value)}[op]


def field_column(f: Field, schema: T.StructType) -> Column:
    """True where a member of the column is as the field says; false for null."""
    t = kinds.field_type(schema, f.column)
    shape, kind = kinds.kind_of(t)
    c = F.col(f.column)
    test = lambda v: reduce(lambda a, b: a | b, [_member(f.op, v, x, kind) for x in f.values])
    if shape == "scalar":
        return F.coalesce(test(kinds.canonical(c, kind)), F.lit(False))
    of = c if shape == "list" else F.map_values(c)
    return F.coalesce(F.exists(of, lambda x: F.coalesce(test(kinds.canonical(x, kind)), F.lit(False))), F.lit(False))


def rule_column(rule: Rule, schema: T.StructType) -> Column:
    containers = [f.column for f in rule.fields if kinds.kind_of(kinds.field_type(schema, f.column))[0] != "scalar"]
    if len(containers) != len(set(containers)):
        raise RuleError("two fields on one container column could be met by different members")

    def of(c: Cond) -> Column:
        if c.field:
            return field_column(c.field, schema)
        if c.op == "not":
            return ~of(c.parts[0])
        return reduce((lambda a, b: a & b) if c.op == "and" else (lambda a, b: a | b), map(of, c.parts))

    return of(rule.condition)


def evaluate(df: DataFrame, rules: list[Rule], where: str, position: str) -> DataFrame:
    """rule_id, where, matched_rows, first_positions and field_rows of each rule and
    file with at least min_count matches: all rules in one pass over df."""
    marked = df.select(where, position, *[rule_column(r, df.schema).alias(f"r{i}") for i, r in enumerate(rules)], *[field_column(f, df.schema).alias(f"f{i}_{j}") for i, r in enumerate(rules) for j, f in enumerate(r.fields)])
    # Positions are cut down to the first few in stretches of a file, then over the stretches, so no list grows with a file.
    stretch, few = (F.col(position) / STRETCH).cast("long"), lambda c: F.slice(F.sort_array(c), 1, FIRST_POSITIONS)
    one, two = [], []
    for i, r in enumerate(rules):
        hit = F.col(f"r{i}")
        counts = F.array(F.count_if(hit), *[F.count_if(F.col(f"f{i}_{j}")) for j in range(len(r.fields))])
        one += [counts.alias(f"n{i}"), few(F.collect_list(F.when(hit, F.col(position)))).alias(f"p{i}")]
        sums = [F.sum(F.get(f"n{i}", F.lit(j))) for j in range(len(r.fields) + 1)]
        two.append(F.struct(F.lit(r.id).alias("rule_id"), sums[0].alias("matched_rows"), few(F.flatten(F.collect_list(f"p{i}"))).alias("first_positions"), F.array(*sums[1:]).alias("field_rows"), F.lit(r.min_count).alias("least")).alias(f"a{i}"))
    per = marked.groupBy(where, stretch.alias("stretch")).agg(*one).groupBy(where).agg(*two)
    out = per.select(where, F.explode(F.array(*[f"a{i}" for i in range(len(rules))])).alias("a"))
    return out.select("a.rule_id", where, "a.matched_rows", "a.first_positions", "a.field_rows").where(F.col("a.matched_rows") >= F.col("a.least"))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return ".".join(f"`{p}`" for p in column.split("."))


def _member_sql(op: str, v: str, value: str, kind: str) -> str:
    low, lit = f"lower({v})", _quoted(value.lower())
    if op == "match":  # over-returns: a substring is not yet a token
        return f"position({_quoted(text.query_terms(value)[0])} IN {low}) > 0"
    if op == "equals":
        told = kinds.canonical_literal(value, kind) if kind in kinds.INDEXABLE - {kinds.BINARY} else None
        return f"{v} = {_quoted(value if told is None else told)}"
    if op in ("gt", "gte", "lt", "lte"):
        sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[op]
        return f"TRY_CAST({v} AS DECIMAL(38,18)) {sign} CAST({_quoted(value)} AS DECIMAL(38,18))"
    return {"contains": f"contains({low}, {lit})", "equals_ignore_case": f"{low} = {lit}", "starts_with": f"startswith({low}, {lit})", "ends_with": f"endswith({low}, {lit})", "re": f"{v} RLIKE {_quoted(value)}"}[op]


def _canonical_sql(c: str, kind: str) -> str:
    if kind == kinds.DECIMAL:
        return f"CASE WHEN CAST({c} AS STRING) LIKE '%.%' THEN regexp_replace(CAST({c} AS STRING), '\\\\.?0+$', '') ELSE CAST({c} AS STRING) END"
    return f"lower(hex({c}))" if kind == kinds.BINARY else f"replace(CAST({c} AS STRING), ' ', 'T')" if kind == kinds.TIMESTAMP else f"CAST({c} AS STRING)"


def condition_sql(c: Cond, schema: T.StructType) -> str:
    if c.field:
        f = c.field
        shape, kind = kinds.kind_of(kinds.field_type(schema, f.column))
        v = _canonical_sql("x" if shape != "scalar" else _name(f.column), kind)
        test = " OR ".join(_member_sql(f.op, v, x, kind) for x in f.values)
        if shape == "scalar":
            return f"COALESCE({test}, false)"
        of = _name(f.column) if shape == "list" else f"map_values({_name(f.column)})"
        return f"COALESCE(exists({of}, x -> COALESCE({test}, false)), false)"
    if c.op == "not":
        return f"NOT COALESCE({condition_sql(c.parts[0], schema)}, false)"
    return "(" + f" {c.op.upper()} ".join(condition_sql(p, schema) for p in c.parts) + ")"


def confirmation_sql(rule: Rule, schema: T.StructType, relation: str, paths: list[str] | None = None, span: tuple | None = None, key: dict | None = None) -> str:
    """SQL that returns the rows behind an alert: of its files (left out where they
    are too many to name), or the groups of a window rule between two times."""
    where = [condition_sql(rule.condition, schema)]
    if paths and len(paths) <= PINNED:
        where.append("_metadata.file_path IN (" + ", ".join(map(_quoted, paths)) + ")")
    if not rule.window:
        return f"SELECT * FROM {relation} WHERE {' AND '.join(where)}"
    w = rule.window
    if span:
        kind = kinds.kind_of(kinds.field_type(schema, w.ts_column))[1]
        where.append(f"{_name(w.ts_column)} BETWEEN {time_literal(span[0], kind)} AND {time_literal(span[1], kind)}")
    for c, v in (key or {}).items():
        where.append(f"COALESCE(CAST({_name(c)} AS STRING), '') = {_quoted(v)}")
    by = ", ".join(map(_name, w.group_by))
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {by + ', ' if by else ''}count(*) AS n FROM {relation} WHERE {' AND '.join(where)}{group} HAVING count(*) >= {w.count}"


def time_literal(ms: int, kind: str) -> str:
    import datetime

    at = datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC)
    told = at.strftime("%Y-%m-%d %H:%M:%S.") + f"{ms % 1000:03d}"
    return {kinds.TIMESTAMP: f"TIMESTAMP_NTZ'{told}'", kinds.TIMESTAMPTZ: f"TIMESTAMP'{told} UTC'", kinds.DATE: f"DATE'{told[:10]}'", kinds.INTEGRAL: str(ms)}.get(kind, f"'{told.replace(' ', 'T')}'")


def uncovered(rules: list[Rule], schema: T.StructType) -> list[tuple[str, str]]:
    """(rule, column) for rules that name a column which the schema lacks."""
    out = []
    for r in rules:
        for c in r.columns():
            try:
                kinds.field_type(schema, c)
            except kinds.NotIndexable:
                out.append((r.id, c))
    return out
