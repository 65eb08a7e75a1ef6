"""Planning: which files a predicate can match, and the pruned read.

Bounds first, then bloom, grams and terms; each tier gets the files still in play.
A tier that is missing, stale or fails knows nothing, and its files stay."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.functions import kinds, text
from skipscan.operators import dictionary as D
from skipscan.operators.build import TIERS, Index
from skipscan.plans import predicate as P
from skipscan.plans.verdicts import ABSENT, HIT, UNKNOWN, Partition
from skipscan.sources.table import Table, within_bounds

PREFIX_TERMS = 100_000
LOG = logging.getLogger("skipscan.plan")


@dataclass
class ScanReport:
    snapshot: int | None
    total: int = 0
    in_bounds: int = 0
    kept: dict[str, int] = field(default_factory=dict)  # after each tier
    unknown: int = 0
    notes: list[str] = field(default_factory=list)
    ms: int = 0
    verdicts: dict[str, str] = field(default_factory=dict)  # of each file of the snapshot


class _Tiers:
    """Probes of one column's index, over the ordinals it covers."""

    def __init__(self, index: Index, meta: dict, files: list[dict]):
        self.index, self.meta, self.spark = index, meta, index.spark
        self.ordinal = {c["path"]: c["ordinal"] for c in meta["coverage"] if c["live"]}
        self.files = frozenset(f["path"] for f in files)
        self.notes: list[str] = []
        self.shape, self.kind = kinds.kind_of(kinds.field_type(index.table.schema, index.column))

    def of(self, ordinals) -> Partition:
        named = set(ordinals)
        return Partition.covered(self.files, self.ordinal, {p for p, o in self.ordinal.items() if o in named})

    def unknown(self) -> Partition:
        return Partition.all_unknown(self.files)

    def _literals(self, p: P.Node) -> list[str] | None:
        values = p.value if p.op == "in" else (p.value,)
        out = [kinds.canonical_literal(v, self.kind) for v in values]
        return None if any(x is None for x in out) else out

    def _gram_sets(self, p: P.Node) -> list[list[str]] | None:
        """Sets of grams, of which a matching file has one whole; None: cannot be asked."""
        n = self.meta["ngram"]
        literals = [p.value] if p.op in ("contains", "starts_with") else self._literals(p) if p.op in ("eq", "in") else None
        if literals is None or not literals:
            return None
        out = []
        for x in literals:
            for v in text.lowered_variants(x):
                if len(v) < n and p.op in ("contains", "starts_with"):
                    return None
                out.append(text.grams_of(v, n) if len(v) >= n else [v])
        return out

    def bloom(self, p: P.Node) -> Partition:
        """Says what is certainly absent, and never that something is there."""
        sets = self._gram_sets(p)
        if not self.meta["leaves"]["bloom"] or sets is None or self.meta["leaves"]["grams"]:
            return self.unknown()  # where there are grams, they decide
        words = self.spark.read.parquet(*self.meta["leaves"]["bloom"])
        might: set[int] = set()
        for s in sets:
            might |= {r[0] for r in D.bloom_might(words, "ordinal", s).where("might").collect()}
        got = self.of(might)
        return Partition(frozenset(), got.absent, got.hits | got.unknown)

    def grams(self, p: P.Node) -> Partition:
        sets = self._gram_sets(p)
        if not self.meta["leaves"]["grams"] or sets is None:
            return self.unknown()
        asked = sorted({g for s in sets for g in s})
        leaf = self.spark.read.schema(D.GRAM_LEAF).parquet(*self.meta["leaves"]["grams"]).where(F.col("gram").isin(asked))
        found: dict[str, set[int]] = {}
        for r in leaf.collect():  # as many as the literal has grams, for each leaf
            found.setdefault(r["gram"], set()).update(r["ordinals"])
        named: set[int] = set()
        for s in sets:
            named |= set.intersection(*(found.get(g, set()) for g in s))
        return self.of(named)

    def postings(self, asked: list[str]) -> dict[str, set[int]]:
        """Ordinals of each term: the leaves of the terms' ranges, read by term."""
        routes = self.meta["leaves"]["ranges"]
        paths = sorted({routes[str(_range(t))] for t in asked if str(_range(t)) in routes})
        if not paths:
            return {}
        return {r["term"]: set(r["ordinals"]) for r in self._leaves(asked).select("term", "ordinals").collect()}

    def _leaves(self, asked: list[str]) -> DataFrame:
        routes = self.meta["leaves"]["ranges"]
        paths = sorted({routes[str(_range(t))] for t in asked if str(_range(t)) in routes})
        return self.spark.read.schema(D.TERM_LEAF).parquet(*paths).where(F.col("term").isin(asked))

    def counts(self, asked: list[str]) -> dict[int, int]:
        """How often the terms together stand in each file that has one."""
        if not any(str(_range(t)) in self.meta["leaves"]["ranges"] for t in asked):
            return {}
        each = self._leaves(asked).select(F.explode(F.arrays_zip("ordinals", "counts")).alias("x"))
        return {r[0]: r[1] for r in each.groupBy("x.ordinals").agg(F.sum("x.counts")).collect()}

    def other(self, name: str, p: P.Node) -> Partition:
        """A tier of another maker; like a bloom filter it only says what is certainly absent."""
        leaf = self.meta["leaves"]["more"].get(name)
        might = TIERS[name].probe(self.spark.read.parquet(*leaf), p) if leaf and name in TIERS else None
        if might is None:
            return self.unknown()
        got = self.of(might)
        return Partition(frozenset(), got.absent, got.hits | got.unknown)

    def span(self, where) -> set[int] | None:
        """Ordinals of all terms under a condition, unless they are too many."""
        terms = self.index.terms(self.meta)
        if terms is None:
            return set()
        run = terms.where(where(F.col("term")))
        if run.limit(PREFIX_TERMS + 1).count() > PREFIX_TERMS:
            self.notes.append(f"more than {PREFIX_TERMS} terms: nothing is pruned by them")
            return None
        return {r[0] for r in run.select(F.explode("ordinals")).distinct().collect()}

    def asked(self, value: str) -> list[str] | None:
        """The terms of a literal under the index's contract; None where it does not hold them all."""
        analyzer = self.meta["analyzer"]
        terms = text.query_terms(value, analyzer)
        return terms if terms and all(text.indexable(t, self.meta["cap"], analyzer) for t in terms) else None

    def holding(self, value: str) -> Partition:
        """The files with all terms of a literal. Where its compounds are not terms, their pieces only tell what is absent."""
        terms = self.asked(value)
        if terms is None:
            return self.unknown()
        found = self.postings(terms)
        got = self.of(set.intersection(*(found.get(t, set()) for t in terms)))
        if self.meta["analyzer"] == "value" or terms == text.query_terms(value):
            return got
        return Partition(frozenset(), got.absent, got.hits | got.unknown)

    def terms(self, p: P.Node) -> Partition:
        if not self.meta["tiers"][2]:
            return self.unknown()
        value = self.meta["analyzer"] == "value"
        if value and p.op in ("eq", "in"):
            literals = self._literals(p)
            if literals is None or any(not x or not text.indexable(x, self.meta["cap"]) for x in literals):
                return self.unknown()
            return self.of(set().union(*self.postings(literals).values()))
        if value and p.op == "starts_with" and self.kind == kinds.STRING and p.value:
            named = self.span(lambda t: t.startswith(p.value))
            return self.unknown() if named is None else self.of(named)
        if p.op == "match":
            return self.holding(p.value)
        if p.op == "match_prefix":
            prefix = p.value if value else p.value.translate(str.maketrans(text.UPPER, text.LOWER))
            if not text.prefixable(prefix, self.meta["analyzer"]):
                return self.unknown()
            named = self.span(lambda t: t.startswith(prefix))
            return self.unknown() if named is None else self.of(named)
        return self.unknown()

    def term_range(self, r: P.Range) -> Partition:
        if self.meta["analyzer"] != "value" or not self.meta["tiers"][2] or self.shape != "scalar" or self.kind != kinds.STRING:
            return self.unknown()
        named = self.span(r.over)
        return self.unknown() if named is None else self.of(named)


def _range(term: str) -> int:
    return max([0, *(i for i, c in enumerate(D.RANGES) if term[:1] >= c)])


def plan(table: Table, p: P.Node | None = None, at: int | None = None) -> tuple[list[dict], ScanReport]:
    """The files that can match, and how they were chosen."""
    began, now = time.time(), table.current()
    at = at if at is not None or now is None else now.id
    files = table.files(at) if at is not None else []
    report = ScanReport(at, total=len(files), verdicts={f["path"]: ABSENT for f in files})
    leaves, spans = P.conjuncts(p), P.ranges(p)
    schema = table.schema
    files = [f for f in files if within_bounds(f, p, schema)]
    report.in_bounds = len(files)
    report.unknown = len(files)
    report.verdicts |= {f["path"]: UNKNOWN for f in files}
    if not leaves or not files:
        return files, report
    tiers: dict[str, _Tiers | None] = {}
    for column in dict.fromkeys(x.column for x in leaves):
        try:
            index = Index(table, column)
            meta = index.meta()
            tiers[column] = _Tiers(index, meta, files) if meta else None
        except (KeyError, kinds.NotIndexable) as e:
            tiers[column] = None
            report.notes.append(f"{column}: {e}")
    others = dict.fromkeys(name for t in tiers.values() if t for name in t.meta["leaves"]["more"])
    certain: dict[P.Node, frozenset] = {}  # for each conjunct, the files that certainly have it
    for name in ("bloom", *others, "grams", "terms"):
        verdict = Partition.all_unknown(f["path"] for f in files)
        for x in leaves:
            got = _asked(tiers.get(x.column), files, report, lambda t, x=x: t.other(name, x) if name in others else getattr(t, name)(x))
            certain[x] = certain.get(x, frozenset()) | got.hits
            verdict = verdict.both(got)
        if name == "terms":
            for column, r in spans.items():
                verdict = verdict.both(_asked(tiers.get(column), files, report, lambda t, r=r: t.term_range(r)))
        for path in verdict.absent:
            report.verdicts[path] = ABSENT
        kept = verdict.kept()
        files = [f for f in files if f["path"] in kept]
        report.kept[name] = len(files)
    # A hit is a file that every conjunct's tier names.
    for f in files:
        report.verdicts[f["path"]] = HIT if all(f["path"] in certain[x] for x in leaves) else UNKNOWN
    report.unknown = sum(report.verdicts[f["path"]] == UNKNOWN for f in files)
    report.ms = int((time.time() - began) * 1000)
    LOG.info("table=%s snapshot=%s files_in=%d files_kept=%d ms=%d", table.path, report.snapshot, report.total, len(files), report.ms)
    return files, report


def _asked(t: _Tiers | None, files: list[dict], report: ScanReport, probe) -> Partition:
    paths = frozenset(f["path"] for f in files)
    if t is None:
        return Partition.all_unknown(paths)
    t.files = paths
    try:
        got = probe(t)
        report.notes += [f"{t.index.column}: {x}" for x in t.notes]
        t.notes.clear()
        return got
    except Exception as e:  # a tier that fails knows nothing: its files stay, and the report says so
        report.notes.append(f"{t.index.column}: {type(e).__name__}: {str(e)[:200]}")
        return Partition.all_unknown(paths)


def scan(table: Table, p: P.Node | None = None, at: int | None = None) -> tuple[DataFrame, ScanReport]:
    """The matching rows: the pruned read with the whole predicate applied again."""
    files, report = plan(table, p, at)
    df = table.frame(files)
    return (df.where(P.row_filter(p)) if p is not None else df), report


def scan_sql(table: Table, where: str, at: int | None = None) -> tuple[DataFrame, ScanReport]:
    """scan() of a condition in SQL text (plans.sqltext)."""
    from skipscan.plans.sqltext import parse

    return scan(table, parse(table.spark, where), at)
