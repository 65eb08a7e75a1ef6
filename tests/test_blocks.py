"""Blocks: many values' rows in few data files, each a file to log, index and plans; and what is made file by file."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipscan import lake
from skipscan.functions import text
from skipscan.operators import count as C
from skipscan.operators import dictionary as D
from skipscan.operators.build import Index, Settings
from skipscan.plans import predicate as P
from skipscan.plans import scan as S
from skipscan.plans.verdicts import Partition
from skipscan.sources import pushdown
from skipscan.sources.table import Table

ODD = [
    "Node-7 at 10.0.0.1, fe80::1:2 and ::1; a-b-c 0f-1e dead-beef- .x. 1.2.3.4.5 v1.2", "", None, "Ünïcödé ŞİĞMA ΟΔΟΣ Kelvin K 1-2", "ab", "é", "😀😀 12345 1234 a", "x" * 300 + " y", "a\nb c\n1.2\n.3.4", "12:34:56 ab:cd:ef ab::cd:1 a:::b:1 2001:db8::1",
]


def rows(spark, n=400):
    return spark.range(n).select("id", F.concat(F.lit("word"), (F.col("id") % 37).cast("string"), F.lit(" common text")).alias("msg"))


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    t = Table.create(spark, str(tmp_path_factory.mktemp("b") / "t"), T.StructType.fromDDL("id long, msg string"))
    value, df = (F.col("id") / 10).cast("long"), rows(spark)
    t.append(df.where("id < 200"), blocks=value)
    t.append(df.where("id >= 200"), blocks=value)
    Index(t, "msg").build()
    return t


def test_blocks_share_data_files(blocks):
    files = blocks.files()
    assert sorted(lake.seg_of(f["path"]) for f in files) == list(range(40)) and all(f["rows"] == 10 for f in files)
    assert len({f["file"] for f in files}) <= 10
    assert all(f["bounds"]["id"] == [str(lake.seg_of(f["path"]) * 10), str(lake.seg_of(f["path"]) * 10 + 9)] for f in files)


def test_blocks_are_planned_read_counted_and_hunted(spark, blocks):
    for p in (P.match("msg", "word7"), P.contains("msg", "RD36"), P.gte("id", 395), P.contains("msg", "common"), P.contains("msg", "qqq")):
        kept, report = S.plan(blocks, p)
        want = sorted(r[0] for r in rows(spark).where(P.row_filter(p)).select("id").collect())
        assert report.total == 40 and {lake.seg_of(f["path"]) for f in kept} == {i // 10 for i in want}
        assert sorted(r[0] for r in S.scan(blocks, p)[0].select("id").collect()) == want
        assert sorted(r[0] for r in blocks.frame(kept).select("id").collect()) == [i for s in sorted({i // 10 for i in want}) for i in range(s * 10, s * 10 + 10)]
    assert C.count(blocks, "msg", "word7") == {"count": 11, "files": 11}
    assert sum(x["status"] == "hit" for x in C.hunt(blocks, "msg", ["word7"])) == 11
    pushdown.register(spark)
    found = spark.read.format("skipscan").option("path", blocks.path).load().where("msg LIKE '%word7 %'")
    assert sorted(r[0] for r in found.select("id").collect()) == list(range(7, 400, 37))


def test_many_blocks_are_joined_and_plain_files_read_beside_them(spark, blocks, tmp_path, monkeypatch):
    from skipscan.sources import table

    t = Table.create(spark, str(tmp_path / "m"), T.StructType.fromDDL("id long, msg string"))
    t.append(rows(spark, 60), blocks=(F.col("id") / 10).cast("long"))
    t.append(rows(spark, 70).where("id >= 60"), files=1)
    Index(t, "msg").build()
    gone = [f["path"] for f in t.files() if "block" in f and lake.seg_of(f["path"]) == 2]
    t.remove(gone)
    for few in (200, 1):
        monkeypatch.setattr(table, "FEW_BLOCKS", few)
        df = t.frame(t.files())
        assert sorted(r[0] for r in df.select("id").collect()) == [i for i in range(70) if i // 10 != 2]
        assert df.select(F.col("_metadata.file_path")).distinct().count() >= 2
    assert Index(t, "msg").build(Settings(dead_files=1, dead_share=0.0))[-1]["kind"] == "compacting"
    t.restore(gone)
    assert Index(t, "msg").build(Settings(dead_files=1, dead_share=0.0))[-1]["added"] == gone
    assert {r["term"]: r["total_count"] for r in Index(t, "msg").terms().collect()}["common"] == 70


def test_a_plan_gathers_kept_files_once_a_tier(blocks, monkeypatch):
    asked = []
    kept = Partition.kept
    monkeypatch.setattr(Partition, "kept", lambda self: asked.append(1) or kept(self))
    S.plan(blocks, P.contains("msg", "common"))
    assert len(asked) == 3


@pytest.mark.parametrize("analyzer", ["tokens", "pieces", "short-pieces"])
def test_terms_and_grams_made_file_by_file(spark, analyzer, monkeypatch):
    monkeypatch.setattr(D, "HELD_TERMS", 5)
    monkeypatch.setattr(D, "HELD_SIGNS", 20)
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(ODD * 2)], "ordinal int, v string").coalesce(2)
    known = lambda d: sorted(map(tuple, d.collect()))
    want = D.term_counts(df, "ordinal", D.terms_per_row(F.col("v"), T.StringType(), analyzer)).select("ordinal", "term", "occurrences")
    assert known(D.counted_terms(df, T.StringType(), analyzer).select("ordinal", "term", "occurrences")) == known(want)
    assert known(D.distinct_grams(df, T.StringType())) == known(D.file_grams(df, "ordinal", F.col("v"), T.StringType()))


def test_tokens_of_columns_and_literals_agree(spark):
    df = spark.createDataFrame([(v,) for v in ODD if v is not None], "v string")
    for v, got in df.select("v", text.tokens(F.col("v"))).collect():
        assert got == [t for t in text.tokens_of(v) if len(t) <= text.CAP]


def test_signs_of_files_are_counted_as_rows(spark):
    pairs = spark.createDataFrame([(0, g) for g in ("abc", "bcd", "a", "", "é😀x")] + [(1, "ab"), (1, "aba")], "ordinal int, gram string")
    got = D.gram_saturation(pairs, "ordinal")
    assert sorted(map(tuple, got.select("ordinal", "grams", "signs").collect())) == [(0, 5, 8), (1, 2, 2)]
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()
