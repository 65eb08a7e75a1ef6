"""Tables and indexes of the registered queries, made once a session from a folder of Parquet tables.

A segment (doc_id div 50, event_id div 500, ...) is a block of its own here, which log,
index and plans take for a file, and the blocks come in several snapshots, so that what
an index says of files can be said in SQL over the same rows. Data files hold many
blocks: a file each would cost far more than its rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipscan.operators.build import Index, Settings
from skipscan.rules.model import rule_of
from skipscan.sources.table import Table
from skipscan.streaming import watch

_MADE: dict[tuple, object] = {}


def folder(spark: SparkSession) -> str:
    """A folder that all executors share; a temporary one only for a local master where none is set."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skipscan-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def once(make):
    """Made at first use, for each session and input folder."""

    @wraps(make)
    def got(spark: SparkSession, d: str):
        key = (spark.sparkContext.applicationId, d, make.__name__)
        if key not in _MADE:
            _MADE[key] = make(spark, d)
        return _MADE[key]

    return got


def _table(spark: SparkSession, name: str, df: DataFrame, **more) -> Table:
    return Table.create(spark, f"{folder(spark)}/skipscan-lake/{name}-{uuid.uuid4().hex}", df.schema, **more)


def seg(column: str, size: int):
    return F.floor(F.col(column) / size).cast("long")


def seg_of(path: str) -> int:
    return int(re.search(r"/each=(-?[0-9]+)(/|$)", path)[1])


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@once
def documents(spark, d) -> Table:
    """All documents, in two snapshots, under a complete index of their texts."""
    df = read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    t, s = _table(spark, "documents", df), seg("doc_id", 50)
    t.append(df.where(s % 2 == 0), blocks=s)
    t.append(df.where(s % 2 == 1), blocks=s)
    Index(t, "text").build()
    return t


@once
def late(spark, d) -> Table:
    """Documents of which a third (seg mod 3 = 0) came after the index was built."""
    df = read(spark, d, "documents").select("doc_id", "text")
    t, s = _table(spark, "late", df), seg("doc_id", 50)
    t.append(df.where(s % 3 != 0), blocks=s)
    Index(t, "text").build(Settings(bloom=False))
    t.append(df.where(s % 3 == 0), blocks=s)
    return t


@once
def blooms(spark, d) -> Table:
    """Documents with bloom filters alone, built in passes."""
    df = read(spark, d, "documents").select("doc_id", "text")
    t, s = _table(spark, "blooms", df), seg("doc_id", 50)
    t.append(df, blocks=s)
    n = len(t.files())
    Index(t, "text").build(Settings(grams=False, terms=False), per_pass=max(1, -(-n // 3)))
    return t


@once
def parts(spark, d) -> Table:
    """Parts under an index of whole values."""
    df = read(spark, d, "part").select("p_partkey", "p_brand")
    t = _table(spark, "parts", df)
    t.append(df, blocks=seg("p_partkey", 100))
    Index(t, "p_brand").build(Settings(analyzer="value", grams=False, bloom=False))
    return t


@once
def worn(spark, d) -> tuple[Table, list[tuple[str, dict, list[dict]]]]:
    """Parts whose files go, come back and go for good, and the index's report and coverage after each build."""
    df = read(spark, d, "part").select("p_partkey", "p_brand")
    t, steps = _table(spark, "worn", df), []
    index, keep = Index(t, "p_brand"), Settings(analyzer="value", dead_files=10**9)

    def build(name: str, settings: Settings) -> None:
        report = index.build(settings)[-1]
        steps.append((name, report, index.meta()["coverage"]))

    t.append(df, blocks=seg("p_partkey", 100))
    build("all", keep)
    fifth = [f["path"] for f in t.files() if seg_of(f["path"]) % 5 == 0]
    t.remove(fifth)
    build("departed", keep)
    tenth = [p for p in fifth if seg_of(p) % 10 == 0]
    t.restore(tenth)
    build("revived", keep)
    t.remove(tenth)
    build("compacted", Settings(analyzer="value", dead_files=1, dead_share=0.0))
    return t, steps


@once
def customers(spark, d) -> Table:
    df = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    t = _table(spark, "customers", df)
    t.append(df, blocks=seg("c_custkey", 100))
    Index(t, "c_mktsegment").build(Settings(analyzer="value", grams=False, bloom=False))
    Index(t, "c_name").build(Settings(analyzer="value", grams=False, bloom=False))
    return t


@once
def lineitem(spark, d) -> Table:
    df = read(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    t = _table(spark, "lineitem", df)
    t.append(df, blocks=seg("l_orderkey", 1000))
    return t


STEPS = 10


@once
def events(spark, d) -> Table:
    """Events in STEPS snapshots: that of a segment is 1 + seg * STEPS div (number of segments)."""
    df = read(spark, d, "events")
    t, s = _table(spark, "events", df), seg("event_id", 500)
    last = df.agg(F.max(s)).first()[0]
    for i in range(STEPS):
        own = df.where(F.floor(s * STEPS / (last + 1)) == i)
        t.append(own, blocks=s)
    return t


@once
def by_type(spark, d) -> Table:
    """Events in files of one event type each."""
    df = read(spark, d, "events")
    t = _table(spark, "by_type", df, partitioned_by=("event_type",))
    t.append(df)
    return t


WATCHED = 4


@once
def watched(spark, d) -> list[dict]:
    """The alerts of a watcher that polls while events arrive in WATCHED snapshots, in the order of time."""
    df = read(spark, d, "events")
    t = _table(spark, "watched", df)
    rules = [
        rule_of({"id": "row", "table": "events", "where": [{"column": "event_type", "equals": "error"}, {"column": "user_id", "lt": 100}], "condition": "all-of"}),
        rule_of({"id": "window", "table": "events", "where": {"column": "event_type", "equals": "error"}, "window": {"ts_column": "ts", "timeframe": "6h", "count": 3, "group_by": "user_id"}}),
    ]
    out: list[dict] = []
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    lo, hi = df.agg(F.min(ms), F.max(ms)).first()
    quarter = F.least(F.floor((ms - lo) * WATCHED / F.lit(max(1, hi - lo))), F.lit(WATCHED - 1)).cast("long")
    at = f"{t.path}/watch/kept"
    for i in range(WATCHED):
        t.append(df.where(quarter == i).coalesce(1), each=quarter)
        # A new watcher each time: place, claims and rings come from the folder.
        watch.Watcher(t, rules, lambda a: out.extend(a) or {}, folder=at).poll()
    return out
