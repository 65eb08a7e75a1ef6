"""Contracts of terms, limits of builds, catalogs and the upkeep of many indexes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipscan import queries
from skipscan.functions import text
from skipscan.operators import count as C
from skipscan.operators.build import BuildRefused, Index, Settings
from skipscan.operators.fleet import Fleet
from skipscan.plans import predicate as P
from skipscan.plans import scan as S
from skipscan.rules.model import rule_of
from skipscan.sources.catalog import FolderCatalog
from skipscan.sources.table import Table
from skipscan.streaming import watch as W

D = "/root/testdata/sf0.001"
LINES = ("node 10.0.0.1 is up", "node 10 0 0 1 order 1234", "order 123456 late", None)


def table(spark, path, lines=LINES):
    t = Table.create(spark, str(path), T.StructType.fromDDL("id long, msg string"))
    for i, line in enumerate(lines):
        t.append(spark.createDataFrame([(i, line)], t.schema), files=1)
    return t


def ids(t, p):
    """Ids of the files kept and of the rows found; the rows are those of a full read."""
    kept = [r.id for r in t.frame(S.plan(t, p)[0]).select("id").collect()]
    rows = sorted(r.id for r in S.scan(t, p)[0].collect())
    assert rows == sorted(r.id for r in t.frame(t.files()).where(P.row_filter(p)).collect())
    return sorted(kept), rows


def test_terms_of_the_contracts(spark):
    df = spark.createDataFrame([("At 10.0.0.1: x12345 12345 1234",)], "v string")
    from skipscan.operators import dictionary

    got = {a: sorted(df.select(dictionary.terms_per_row(F.col("v"), T.StringType(), a)).first()[0]) for a in text.ANALYZERS}
    assert got["tokens"] == sorted([*got["pieces"], "10.0.0.1"])
    assert got["pieces"] == sorted([*got["short-pieces"], "12345"]) and "x12345" in got["short-pieces"]
    assert text.query_terms("10.0.0.1 a", "pieces") == ["10", "0", "1", "a"] and text.query_terms("A b", "value") == ["A b"]
    assert not text.indexable("12345", analyzer="short-pieces") and text.indexable("12345", analyzer="pieces")
    assert [text.prefixable("12", a) for a in text.ANALYZERS] == [True, True, False, True]
    assert [text.prefixable("1.2", a) for a in text.ANALYZERS] == [True, False, False, True]
    assert len({Settings(analyzer=a).contract() for a in text.ANALYZERS}) == 4
    with pytest.raises(BuildRefused):
        Settings(analyzer="words").contract()


@pytest.mark.parametrize("analyzer", ["tokens", "pieces", "short-pieces"])
def test_contracts_lose_no_rows(spark, tmp_path, analyzer):
    t = table(spark, tmp_path / "t")
    Index(t, "msg").build(Settings(analyzer=analyzer, grams=False, bloom=False))
    assert ids(t, P.match("msg", "Order")) == ([1, 2], [1, 2])
    # Without compounds the address's pieces keep the second file too, but do not make it a hit.
    assert ids(t, P.match("msg", "10.0.0.1")) == (([0] if analyzer == "tokens" else [0, 1]), [0])
    assert ids(t, P.match("msg", "123456")) == ([0, 1, 2, 3] if analyzer == "short-pieces" else [2], [2])
    assert ids(t, P.match_prefix("msg", "123")) == ([0, 1, 2, 3] if analyzer == "short-pieces" else [1, 2], [1, 2])
    hunted = [h["status"] for h in C.hunt(t, "msg", ["10.0.0.1"])]
    assert hunted.count("hit") == (1 if analyzer == "tokens" else 0) and hunted.count("unresolved") == (0 if analyzer == "tokens" else 2)
    assert C.count(t, "msg", "1234") == {"count": 1, "files": 1}
    if analyzer == "short-pieces":
        with pytest.raises(C.CountRefused, match="not_indexable"):
            C.count(t, "msg", "123456")
    often = W.on_index(t, rule_of({"id": "r", "table": "t", "column": "msg", "match": "10.0.0.1", "min_count": 2}))
    assert [x["status"] for x in often].count("hit") == 0


def test_a_full_prefix_tells(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    Index(t, "msg").build(Settings(grams=False, bloom=False))
    monkeypatch.setattr(S, "PREFIX_TERMS", 1)
    files, report = S.plan(t, P.match_prefix("msg", "1"))
    assert len(files) == 4 and any("more than 1 terms" in n for n in report.notes)


def test_limits_of_builds(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    index = Index(t, "msg")
    for limit in ({"most_bloom_bytes": 1}, {"most_terms": 3}):
        with pytest.raises(BuildRefused, match="index fewer files"):
            index.build(Settings(**limit))
        assert index.meta() is None
    # A pass within the limits, then one beyond: the gram tier goes as a whole and takes no file with it.
    own = Settings(bloom=False, terms=False, most_grams=18)
    reports = index.build(own, per_pass=1)
    assert any("no gram tier" in w for r in reports for w in r["warnings"])
    assert index.meta()["given_up"] == ["grams"] and index.meta()["leaves"]["grams"] == []
    assert ids(t, P.contains("msg", "is up")) == ([0, 1, 2, 3], [0])
    t.append(spark.createDataFrame([(9, "is up")], t.schema), files=1)
    index.build(Settings(bloom=False, terms=False))
    assert index.meta()["leaves"]["grams"] == []  # until a full build, here by another n
    assert ids(t, P.contains("msg", "is up"))[1] == [0, 9]
    index.build(Settings(bloom=False, terms=False, ngram=4))
    assert ids(t, P.contains("msg", "is up")) == ([0, 9], [0, 9]) and index.meta()["given_up"] == []


def test_catalog_and_fleet(spark, tmp_path):
    for name in ("a", "b"):
        table(spark, tmp_path / name, LINES[:2])
    (tmp_path / "other").mkdir()
    catalog = FolderCatalog(spark, str(tmp_path))
    assert catalog.names() == ["a", "b"] and catalog.load("a") is catalog.load("a")
    kept = catalog.load("a")
    catalog.invalidate("a")
    assert catalog.load("a") is not kept
    for wrong in ("zz", "../a", ""):
        with pytest.raises(KeyError):
            catalog.load(wrong)
    light = Settings(grams=False, bloom=False)
    fleet = Fleet(catalog, lambda name, t: {"msg": light} if name == "a" else {"msg": light, "nope": light})
    assert [(x["indexed"], x["behind_snapshots"]) for x in fleet.status() if x["column"] == "msg"] == [(False, 2)] * 2
    first = fleet.turn()
    assert [(x["table"], x["column"], x["outcome"]) for x in first] == [("a", "msg", "built"), ("b", "msg", "built"), ("b", "nope", "refused")]
    t = catalog.load("a")
    late = t.append(spark.createDataFrame([(7, "new")], t.schema), files=1)
    told = {(x["table"], x["column"]): x for x in fleet.status(late.ts_ms + 5000)}
    assert told["a", "msg"]["behind_seconds"] == 5 and told["b", "msg"]["behind_seconds"] == 0 and told["b", "nope"]["refused"]
    assert fleet.order() == ["b", "a"]
    assert [(x["table"], x["outcome"]) for x in fleet.turn()] == [("b", "current"), ("b", "refused"), ("a", "built")]
    assert len(fleet.refused) == 1


def test_short_pieces_equal_sql(spark, same):
    same(queries.QUERIES["short_piece_terms"](spark, D), queries.SQL["short_piece_terms"], {"documents": f"{D}/documents.parquet"})
