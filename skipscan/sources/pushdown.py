"""A Python data source that prunes files for plain SQL: LIKE '%x%', LIKE 'x%', =, IN and ranges.

Spark pushes the conjuncts; they choose files through the index, and every filter
is handed back, so that Spark applies it to the rows again."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringStartsWith

from skipscan.plans import predicate as P

MAKERS = {EqualTo: P.eq, In: P.in_, GreaterThan: P.gt, GreaterThanOrEqual: P.gte, LessThan: P.lt, LessThanOrEqual: P.lte, StringContains: P.contains, StringStartsWith: P.starts_with}


def predicate_of(filters) -> P.Node | None:
    out = None
    for f in filters:
        make = MAKERS.get(type(f))
        if make and len(f.attribute) == 1:
            node = make(f.attribute[0], f.value)
            out = node if out is None else out & node
    return out


class File(InputPartition):
    """A data file, and the blocks to read of it where these are not all."""

    def __init__(self, path: str, blocks: list[str] | None = None):
        self.path, self.blocks = path, blocks


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, manifest: list[dict]):
        self.schema, self.path, self.files = schema, path, manifest
        self.kept: list[str] | None = None

    def pushFilters(self, filters):
        filters = list(filters)
        from skipscan.sources.table import within_bounds

        p = predicate_of(filters)
        self.kept = [f["path"] for f in self.files if within_bounds(f, p, self.schema)]
        self.kept = through_index(self.path, self.kept, p)
        yield from filters

    def partitions(self):
        kept, plain, blocks = None if self.kept is None else set(self.kept), [], {}
        for f in self.files:
            if kept is not None and f["path"] not in kept:
                continue
            if "block" in f:
                blocks.setdefault((f["file"], f["of"]), []).append(f["block"])
            else:
                plain.append(File(f["path"]))
        return plain + [File(p, own if len(own) < of else None) for (p, of), own in blocks.items()]

    def read(self, partition: File):
        import pyarrow.compute as pc

        own = None if partition.blocks is None else pc.field("#block").isin(partition.blocks)
        yield from opened(partition.path).to_batches(columns=self.schema.names, filter=own)


def opened(path: str):
    import pyarrow.dataset as ds
    import pyarrow.fs as fs

    if "://" not in path:
        return ds.dataset(path.removeprefix("file:"), format="parquet")
    where, at = fs.FileSystem.from_uri(path)
    return ds.dataset(at, format="parquet", filesystem=where)


def _documents(folder: str) -> list[dict]:
    import json
    import os

    if not os.path.isdir(folder):
        return []
    out = []
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".json") and not n.startswith(".")):
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            out.append(json.load(f))
    return out


def _postings(leaves: list[str], key: str, asked: list[str]) -> dict[str, set[int]]:
    import pyarrow.compute as pc

    have: dict[str, set[int]] = {}
    for leaf in leaves:
        rows = opened(leaf).to_table(columns=[key, "ordinals"], filter=pc.field(key).isin(asked))
        for k, o in zip(rows[key].to_pylist(), rows["ordinals"].to_pylist(), strict=True):
            have.setdefault(k, set()).update(o)
    return have


def through_index(root: str, kept: list[str], p: P.Node | None) -> list[str]:
    """Drops files that grams (of substrings) or terms (of whole values) rule out; the planning process has no session, so leaves are read with Arrow."""
    import json

    from skipscan.functions import text
    from skipscan.plans.scan import _range

    base = root.removeprefix("file:")
    with open(f"{base}/table.json", encoding="utf-8") as f:
        ids = {x["name"]: x["id"] for x in json.load(f)["fields"]}
    for x in P.conjuncts(p):
        metas = _documents(f"{base}/index/{ids.get(x.column)}/meta")
        values = x.value if x.op == "in" else (x.value,)
        if not metas or not all(isinstance(v, str) for v in values):
            continue
        meta, named = metas[-1], None
        if x.op in ("contains", "starts_with") and meta["leaves"]["grams"] and all(len(v) >= meta["ngram"] for v in text.lowered_variants(x.value)):
            sets = [text.grams_of(v, meta["ngram"]) for v in text.lowered_variants(x.value)]
            have = _postings(meta["leaves"]["grams"], "gram", sorted({g for s in sets for g in s}))
            named = set().union(*(set.intersection(*(have.get(g, set()) for g in s)) for s in sets))
        elif x.op in ("eq", "in") and meta["analyzer"] == "value" and meta["tiers"][2] and all(v and text.indexable(v, meta["cap"]) for v in values):
            routes = meta["leaves"]["ranges"]
            leaves = sorted({routes[str(_range(v))] for v in values if str(_range(v)) in routes})
            named = set().union(*_postings(leaves, "term", list(values)).values())
        if named is not None:
            covered = {c["path"]: c["ordinal"] for c in meta["coverage"] if c["live"]}
            kept = [k for k in kept if k not in covered or covered[k] in named]
    return kept


class SkipScanSource(DataSource):
    """spark.read.format("skipscan").option("path", table).load(); files must be on a path that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "skipscan"

    def schema(self) -> T.StructType:
        import json

        with open(f"{self.options['path'].removeprefix('file:')}/table.json", encoding="utf-8") as f:
            return T.StructType.fromJson(json.loads(json.load(f)["schema"]))

    def reader(self, schema: T.StructType) -> Reader:
        live: dict[str, dict] = {}
        for s in _documents(f"{self.options['path'].removeprefix('file:')}/log"):
            for p in s["removed"]:
                live.pop(p, None)
            live |= {f["path"]: f for f in s["added"]}
        return Reader(schema, self.options["path"], [live[p] for p in sorted(live)])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SkipScanSource)
