"""Index builds: full, incremental, restamped, compacting, in passes, and by scope.

Leaves are written first and the one JSON document that points to them last. A
file keeps its ordinal for as long as the index lives; files that go are marked
dead in place, and a compaction renumbers and rewrites every posting at once.

The document is numbered: a build publishes the number after the one it began from,
so where two builds run in spite of the lease, the second to end is refused."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.functions import kinds, text
from skipscan.operators import dictionary as D
from skipscan.sources import store
from skipscan.sources.table import Table, name_of, within_bounds

DEAD_FILES, DEAD_SHARE = 16, 0.25
#: Leaves of grams or blooms that may stand beside each other before they are merged.
LEAVES = 8
#: Most live files whose renumbering is broadcast.
BROADCAST_FILES = 1_000_000
LEASE_MS = 12 * 3600 * 1000


class BuildRefused(RuntimeError):
    pass


@dataclass
class Settings:
    analyzer: str = "tokens"  # or another of text.ANALYZERS
    cap: int = text.CAP
    ngram: int = text.NGRAM
    bloom: bool = True
    grams: bool = True
    terms: bool = True
    fpp: float = 0.01
    scope: object = None  # a predicate on the table's bounded columns
    dead_files: int = DEAD_FILES
    dead_share: float = DEAD_SHARE
    pass_bytes: int | None = None  # most bytes of new files in a pass; one file is always taken
    more: tuple[str, ...] = ()  # tiers of other makers, by name
    most_grams: int | None = None  # (file, gram) pairs of a pass, beyond which the gram tier is given up until a full build
    most_bloom_bytes: int | None = None  # bytes of a pass's bloom filters, and
    most_terms: int | None = None  # (file, term) pairs of a pass, beyond which a build is refused
    extra: dict = field(default_factory=dict)

    def contract(self) -> str:
        if self.cap <= 0 or not 2 <= self.ngram <= 8 or self.analyzer not in text.ANALYZERS:
            raise BuildRefused("cap, n-gram size or analyzer out of range")
        return f"skipscan-{self.analyzer}-v1-max{self.cap}/grams-v1-n{self.ngram}"


def resolved(column: dict, table: dict, deployment: dict) -> Settings:
    """Settings by column, then table, then deployment; a tier that the deployment turns off stays off."""
    known = {k for k in Settings.__dataclass_fields__ if k != "extra"}
    merged = {k: v for level in (deployment, table, column) for k, v in level.items() if k in known}
    for tier in ("bloom", "grams", "terms"):
        flags = [level[tier] for level in (deployment, table, column) if tier in level]
        if any(not isinstance(x, bool) for x in flags):
            raise BuildRefused(f"{tier} is true or false")
        if deployment.get(tier) is False:
            merged[tier] = False
    return Settings(**merged)


@dataclass(frozen=True)
class Tier:
    """A tier of another maker: build(rows (ordinal, v), type) gives a DataFrame with the column ordinal,
    one or more rows a file; probe(leaf, predicate) gives the ordinals that may match, or None if it cannot say."""

    build: object
    probe: object


TIERS: dict[str, Tier] = {}


def register_tier(name: str, build, probe) -> None:
    TIERS[name] = Tier(build, probe)


class Index:
    """The index of one column."""

    def __init__(self, table: Table, column: str):
        self.table, self.column, self.spark = table, column, table.spark
        self.root = f"{table.path}/index/{table.field_id(column)}" + ("-" + column.replace(".", "-") if "." in column else "")

    def meta(self) -> dict | None:
        return store.read_latest(self.spark, f"{self.root}/meta")[1]

    def _lease(self, owner: str, now_ms: int) -> None:
        path = f"{self.root}/lease.json"
        if store.create_only(self.spark, path, {"owner": owner, "expires_ms": now_ms + LEASE_MS}):
            return
        try:
            held = store.read_json(self.spark, path) or {}
        except ValueError:
            held = {}
        if held.get("expires_ms", 0) > now_ms and held.get("owner") != owner:
            raise BuildRefused(f"{held['owner']} is building")
        store.delete(self.spark, path)
        if not store.create_only(self.spark, path, {"owner": owner, "expires_ms": now_ms + LEASE_MS}):
            raise BuildRefused("another build has just begun")

    def build(self, settings: Settings | None = None, per_pass: int | None = None, owner: str | None = None) -> list[dict]:
        """Brings the index up to the current snapshot; the reports of its passes."""
        settings, owner = settings or Settings(), owner or uuid.uuid4().hex
        settings.contract()
        self._lease(owner, int(time.time() * 1000))
        try:
            reports = [self._pass(settings, per_pass)]
            while reports[-1]["partial"]:
                reports.append(self._pass(settings, per_pass))
            return reports
        finally:
            if (store.read_json(self.spark, f"{self.root}/lease.json") or {}).get("owner") == owner:
                store.delete(self.spark, f"{self.root}/lease.json")

    def _pass(self, settings: Settings, per_pass: int | None) -> dict:
        table = self.table
        number, old = store.read_latest(self.spark, f"{self.root}/meta")
        now = table.current()
        schema = table.schema
        files = [f for f in (table.files(now.id) if now else []) if within_bounds(f, settings.scope, schema)]
        current = {f["path"] for f in files}
        tiers = [settings.bloom, settings.grams, settings.terms, *settings.more]
        full = not old or old["contract"] != settings.contract() or old["tiers"] != tiers or not self._readable(old)
        coverage = [] if full else [dict(c) for c in old["coverage"]]
        departed = [c["path"] for c in coverage if c["live"] and c["path"] not in current]
        revived = [c["path"] for c in coverage if not c["live"] and c["path"] in current]
        for c in coverage:
            c["live"] = c["path"] in current
        known = {c["path"] for c in coverage}
        new = [p for p in sorted(current) if p not in known]
        dead = sum(not c["live"] for c in coverage)
        compacting = dead >= max(1, settings.dead_files) and dead >= settings.dead_share * len(coverage)
        part = new[:per_pass] if per_pass else new
        if settings.pass_bytes:
            size, upto = {f["path"]: f["bytes"] for f in files}, 0
            for i, p in enumerate(part):
                upto += size[p]
                if i and upto > settings.pass_bytes:
                    part = part[:i]
                    break
        next_ordinal = max((c["ordinal"] for c in coverage), default=-1) + 1
        added = [{"path": p, "ordinal": next_ordinal + i, "live": True} for i, p in enumerate(part)]
        report = {
            "build_id": uuid.uuid4().hex, "previous_build_id": old["build_id"] if old else None, "kind": "full" if full else "compacting" if compacting else "incremental" if part else "restamp",
            "added": part, "departed": departed, "revived": revived, "partial": len(part) < len(new), "warnings": [], "snapshot": now.id if now else None,
        }
        remap = None
        if compacting:
            live = [c for c in coverage if c["live"]] + added
            remap = {c["ordinal"]: i for i, c in enumerate(live)}
        given_up = [] if full else list(old.get("given_up", ()))
        at = {f["path"]: f for f in files}
        leaves = self._write(settings, None if full else old, [(at[c["path"]], c["ordinal"]) for c in added], remap, report, given_up)
        coverage = coverage + added
        if remap is not None:
            coverage = [dict(c, ordinal=remap[c["ordinal"]]) for c in coverage if c["ordinal"] in remap]
        exact = (full or old["counts_exact"]) and not departed and not revived
        meta = {
            "build_id": report["build_id"], "contract": settings.contract(), "analyzer": settings.analyzer, "cap": settings.cap, "ngram": settings.ngram, "fpp": settings.fpp,
            "tiers": tiers, "given_up": given_up, "coverage": coverage, "leaves": leaves, "partial": report["partial"], "counts_exact": exact,
            "snapshot": report["snapshot"], "delete_files": now.delete_files if now else 0, "built_ms": int(time.time() * 1000),
        }
        if not store.put_next(self.spark, f"{self.root}/meta", number, meta):
            raise BuildRefused("another build was published first")
        store.create_only(self.spark, f"{self.root}/reports/{number + 1:012d}-{report['build_id']}.json", report)
        return report

    def _readable(self, meta: dict) -> bool:
        """Whether all leaves are still there; where one is not, the index is built anew."""
        leaves = meta["leaves"]
        paths = [*leaves["ranges"].values(), *leaves["grams"], *leaves["bloom"], *(p for own in leaves["more"].values() for p in own)]
        return all(store.exists(self.spark, p) for p in dict.fromkeys(paths))

    def reports(self) -> list[dict]:
        """The reports of all builds, oldest first."""
        return [store.read_json(self.spark, f"{self.root}/reports/{n}") for n in store._names(self.spark, f"{self.root}/reports", ".json")]

    def _write(self, s: Settings, old: dict | None, added: list[tuple[dict, int]], remap: dict | None, report: dict, given_up: list[str]) -> dict:
        spark, at = self.spark, f"{self.root}/leaves/{report['build_id']}"
        leaves = dict(old["leaves"]) if old else {"ranges": {}, "grams": [], "bloom": [], "more": {}}
        if not added and remap is None:
            return leaves
        t = kinds.field_type(self.table.schema, self.column)
        rows = None
        if added:
            # Files are told apart by their whole path, blocks by their name; the pairs are as many as the new files.
            names = spark.createDataFrame([(name_of(f), o) for f, o in added], "name string, ordinal int")
            told = self.table.named([f for f, _ in added]).select(F.col(self.column).alias("v"), F.col("#name").alias("name"))
            rows = told.join(F.broadcast(names) if len(added) <= BROADCAST_FILES else names, "name").select("ordinal", "v")
        moved = None
        if remap is not None:
            moved = spark.createDataFrame(list(remap.items()), "old int, new int")
        if s.terms:
            new = None
            if rows is not None:
                new = D.dictionary_of(rows, t, s.analyzer, s.cap).withColumn("range", D.range_of(F.col("term")))
                new = self._stored(new, f"{at}/new-terms")
                if s.most_terms is not None and (n := new.agg(F.coalesce(F.sum("file_count"), F.lit(0))).first()[0]) > s.most_terms:
                    raise BuildRefused(f"{n} terms of files, more than {s.most_terms}: index fewer files in a pass")
            touched = set(range(len(D.RANGES))) if remap is not None else {r[0] for r in new.select("range").distinct().collect()}
            before = [leaves["ranges"][str(r)] for r in sorted(touched) if str(r) in leaves["ranges"]]
            parts = [] if new is None else [new.drop("range")]
            if before:
                kept = spark.read.schema(D.TERM_LEAF).parquet(*before).select("term", "file_count", "total_count", "ordinals", "counts")
                parts.append(kept if moved is None else D.renumbered(kept, "term", moved))
            out = parts[0] if len(parts) == 1 else D.merged(*parts) if parts else None
            if out is not None:
                out = out.withColumn("range", D.range_of(F.col("term")))
                out.repartitionByRange("range", "term").sortWithinPartitions("range", "term").write.option("compression", "zstd").partitionBy("range").parquet(f"{at}/terms")
                have = {r[0] for r in spark.read.parquet(f"{at}/terms").select("range").distinct().collect()} if store.listed(spark, f"{at}/terms") else set()
                leaves["ranges"] = {k: v for k, v in leaves["ranges"].items() if int(k) not in touched} | {str(r): f"{at}/terms/range={r}" for r in have}
        sets = None
        if rows is not None and (s.grams and "grams" not in given_up or s.bloom):
            sets = self._stored(D.gram_sets(rows, t, s.ngram), f"{at}/grams-of-files")
            full = sets.where(D.saturated(F.col("n"), F.col("signs"), s.ngram)).select("ordinal").distinct().count()
            if full:
                report["warnings"].append(f"{full} files hold about all grams of their alphabet")
            n = sets.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0] if s.most_grams is not None or s.most_bloom_bytes is not None else 0
            if s.bloom and s.most_bloom_bytes is not None and (size := D.bloom_bytes(n, s.fpp)) > s.most_bloom_bytes:
                raise BuildRefused(f"bloom filters of {size} bytes, more than {s.most_bloom_bytes}: index fewer files in a pass")
            if s.grams and s.most_grams is not None and n > s.most_grams and "grams" not in given_up:
                # Leaves that lack some covered files would call these absent, so none may stay.
                given_up.append("grams")
                leaves["grams"] = []
                report["warnings"].append(f"{n} grams of files, more than {s.most_grams}: no gram tier until a full build")
        if s.grams and "grams" not in given_up and (sets is not None or remap is not None):
            # New files get a leaf of their own; leaves are merged when there are many, or when files are renumbered.
            parts = [] if sets is None else [D.gram_places(sets)]
            if leaves["grams"] and (moved is not None or len(leaves["grams"]) >= LEAVES):
                prior = spark.read.schema(D.GRAM_LEAF).parquet(*leaves["grams"])
                parts.append(prior if moved is None else D.renumbered(prior, "gram", moved))
                leaves["grams"] = []
            if parts:
                both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
                both = both.groupBy("gram").agg(F.sort_array(F.flatten(F.collect_list("ordinals"))).alias("ordinals"))
                both.repartitionByRange("gram").sortWithinPartitions("gram").write.option("compression", "zstd").parquet(f"{at}/grams")
                leaves["grams"] = [*leaves["grams"], f"{at}/grams"]
        if s.bloom and (sets is not None or remap is not None):
            new = [] if sets is None else [D.bloom_of(sets, s.fpp)]
            leaves["bloom"] = self._leaf(leaves["bloom"], new, moved, f"{at}/bloom")
        for name in s.more:
            new = [] if rows is None else [TIERS[name].build(rows, t)]
            leaves["more"] = leaves["more"] | {name: self._leaf(leaves["more"].get(name, []), new, moved, f"{at}/{name}")}
        return leaves

    def _leaf(self, have: list[str], new: list[DataFrame], moved: DataFrame | None, path: str) -> list[str]:
        """The leaves of a tier with rows by ordinal, after new ones; many are merged, and renumbered ones rewritten."""
        if have and (moved is not None or len(have) >= LEAVES):
            prior = self.spark.read.parquet(*have)
            if moved is not None:
                prior = prior.join(F.broadcast(moved), F.col("ordinal") == F.col("old")).drop("ordinal", "old").withColumnRenamed("new", "ordinal")
            new, have = [*new, prior], []
        if not new:
            return have
        (new[0] if len(new) == 1 else new[0].unionByName(new[1])).write.option("compression", "zstd").parquet(path)
        return [*have, path]

    def _stored(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def terms(self, meta: dict | None = None) -> DataFrame | None:
        paths = sorted((meta or self.meta())["leaves"]["ranges"].values())
        return self.spark.read.schema(D.TERM_LEAF).parquet(*paths) if paths else None

    def status(self) -> dict:
        """How far the index is behind its table."""
        meta, snaps = self.meta(), self.table.snapshots()
        if not meta or not snaps:
            return {"indexed": False, "behind_ms": None, "behind_snapshots": len(snaps), "dead_share": 0.0}
        late = [s.ts_ms for s in snaps if meta["snapshot"] is None or s.id > meta["snapshot"]]
        dead = sum(not c["live"] for c in meta["coverage"])
        return {"indexed": True, "behind_ms": int(time.time() * 1000) - late[0] if late else 0, "behind_snapshots": len(late), "dead_share": dead / max(1, len(meta["coverage"])), "partial": meta["partial"], "counts_exact": meta["counts_exact"]}
