"""What builds deal between tasks: postings of many files at once, and grams by file, equal to what is made pair by pair."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipscan.operators import dictionary as D
from tests.test_blocks import ODD

known = lambda d: sorted(map(tuple, d.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i % 3, v) for i, v in enumerate(ODD * 2)], "ordinal int, v string").coalesce(2)


def test_a_task_deals_a_term_once_for_many_files():
    files = [pa.RecordBatch.from_arrays([pa.array([i] * 2, pa.int32()), pa.array([b"the same Words", b"the-end"])], ["ordinal", "v"]) for i in range(40)]
    told = {t: (o, n) for b in D._term_counter("tokens", 256)(files) for t, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert told == {t: (list(range(40)), [n] * 40) for t, n in (("the", 2), ("same", 1), ("words", 1), ("end", 1))}
    rows = [r for b in D._gram_dealer()([pa.RecordBatch.from_arrays([pa.array([3, 5], pa.int32()), pa.array([["abc", "x"], ["abc"]])], ["o", "g"])]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert rows == [("abc", [3, 5]), ("x", [3])]


@pytest.mark.parametrize("held", [5, 1_000_000])
def test_dictionary_of_texts(odd, held, monkeypatch):
    monkeypatch.setattr(D, "HELD_TERMS", held)
    for analyzer in ("tokens", "pieces", "short-pieces"):
        want = D.term_dictionary(D.term_counts(odd, "ordinal", D.terms_per_row(F.col("v"), T.StringType(), analyzer)), "ordinal")
        assert known(D.text_dictionary(odd, analyzer)) == known(want)


def test_a_term_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD_TERMS", 1)
    df = spark.range(6000).select((F.col("id") % 2500).cast("int").alias("ordinal"), F.concat(F.lit("a the b"), F.col("id") % 3, F.lit(" zz")).alias("v")).coalesce(1)
    want = D.term_dictionary(D.term_counts(df, "ordinal", D.terms_per_row(F.col("v"), T.StringType(), "tokens")), "ordinal")
    assert known(D.text_dictionary(df, "tokens")) == known(want)


@pytest.mark.parametrize("most", [4, 200_000])
def test_gram_sets_and_what_is_made_of_them(odd, most, monkeypatch):
    monkeypatch.setattr(D, "SET", most)
    monkeypatch.setattr(D, "HELD_SIGNS", 20)
    for n in (3, 2):
        sets, pairs = D.gram_sets(odd, T.StringType(), n), D.file_grams(odd, "ordinal", F.col("v"), T.StringType(), n)
        assert known(sets.select("ordinal", "n", "signs").distinct()) == known(D.gram_saturation(pairs, "ordinal", n).select("ordinal", "grams", "signs"))
        assert known(D.bloom_of(sets)) == known(D.bloom_words(pairs, "ordinal").select("ordinal", "m", "k", "word", "bits"))
        got = D.gram_places(sets).groupBy("gram").agg(F.sort_array(F.flatten(F.collect_list("ordinals"))).alias("ordinals"))
        assert known(got) == known(D.gram_dictionary(pairs, "ordinal"))


def test_bloom_query_makes_no_row_for_each_gram(spark, same):
    from skipscan import queries

    df = queries.QUERIES["leaf_bloom_no_miss"](spark, "/root/testdata/sf0.001")
    same(df, queries.SQL["leaf_bloom_no_miss"], {"documents": "/root/testdata/sf0.001/documents.parquet"})
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
