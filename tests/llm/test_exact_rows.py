"""Ids beyond 2**53 beside nulls, empty tables, ties, repeated rows and clashing columns."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

BIG = 2**60 + 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(BIG, "a b c", "x"), (None, "x", "y"), (BIG + 2, "a b c", None)], "doc_id long, text string, n_dropped string").coalesce(1)


def test_ids_stay_exact(spark, docs):
    from skipscan.llm import html, licences, minhash, packing, pii, quality, sharding

    want = {BIG, None, BIG + 2}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    for made, name in (
        (pii.pseudonyms(docs, b"k"), "doc_id"), (html.extract(pages), "page_id"), (packing.packed(docs, packing.vocabulary_path), "doc_id"), (licences.scan(docs), "doc_id"),
        (minhash.near_duplicates(docs), "doc_id"), (quality.judge(docs), "doc_id"), (sharding.shard(docs, 7), "doc_id"),
    ):
        assert {r[0] for r in made.select(name).collect()} == want, made.columns
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert (got[BIG + 2].component_id, got[BIG + 2].kept, got[BIG].kept, got[None].component_id) == (BIG, False, True, None)
    alone = sharding.shard(docs.where("doc_id IS NOT NULL"), 40).collect()
    assert {(r.doc_id, r.shard, r.grown_shard) for r in alone} <= {(r.doc_id, r.shard, r.grown_shard) for r in sharding.shard(docs, 40).collect()}


def test_jump_against_the_scalar_form():
    import numpy as np

    from skipscan.llm import sharding

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    keys = [0, 1, 2, BIG, -1, -(2**63), 2**63 - 1, *range(1000, 1300)]
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(np.array(keys, np.int64), n).tolist() == [jump(k % 2**64, n) for k in keys]


def test_slots_do_not_depend_on_partitions(docs, monkeypatch):
    from skipscan.llm import sharding

    many = docs.sparkSession.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int") % 7).alias("text"))
    many = many.unionByName(many.limit(50))
    one = sorted(map(tuple, sharding.shard(many.repartition(5), 3).collect()))
    monkeypatch.setattr(sharding, "STRETCH", 10)
    assert one == sorted(map(tuple, sharding.shard(many.repartition(2), 3).collect()))


def test_clashing_columns_and_rows_of_one_id(spark, docs):
    from skipscan.llm import decontaminate, linededup, minhash, quality

    assert linededup.dedup_lines(docs).columns == ["doc_id", "text", "n_dropped"]
    odd = docs.select("doc_id", "text", F.lit(1).alias("gone"), F.lit(2).alias("kept"), F.lit(3).alias("d"), F.lit(4).alias("th"), F.lit(5).alias("w"), F.lit(6).alias("x.y"))
    items = spark.createDataFrame([(1, "a b c", "z")], "item_id long, text string, window string")
    for made in (linededup.dedup_lines(odd, count=None), minhash.keep_first(odd), decontaminate.clean(odd, items), quality.keep_good(odd)):
        assert made.columns == odd.columns and made.count() in (0, 1, 2, 3)
    assert {r[0] for r in decontaminate.clean(odd, items).select("doc_id").collect()} == {None}
    assert decontaminate.clean(odd, items.limit(0)).count() == 3
    # texts of one doc_id that differ link what is like each of them
    rows = [(1, "p q r s t u v"), (2, "k l m n o i j"), (3, "p q r s t u v"), (3, "k l m n o i j"), (4, "other words stand here alone now")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_tables_without_rows(spark):
    from skipscan.llm import chat, html

    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "<p>", 1)], "page_id long, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in html.extract(pages).collect()] == [("", 0)] * 3 and html.extract(pages.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "a", 1), (1, 0, "user", "a", 2), (1, 0, "assistant", "b", 3), (1, None, None, None, 4)], "conv_id long, turn long, role string, text string, i int")
    assert chat.digests(chat.windows(turns.limit(0))).count() == 0
    got = chat.digests(chat.windows(turns)).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == [(4, 1)]


def test_control_strings_have_their_own_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    from skipscan.llm.tokens import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    told, own = Tokenizer.from_file(path), Encoder(path)
    own.STRETCH = 40
    texts = ["end <|endoftext|> next", "<|endoftext|><|endoftext|>", "", "plain it's 12.5", "<|endoftext|", " a" * 60, "x<|endoftext|>"]
    ids, counts = own.encode(texts)
    want = [told.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for y in want for x in y] and counts.tolist() == [len(y) for y in want]


def test_functions_reach_workers_without_this_repository(tmp_path):
    """Executors have public packages alone; the driver finds the package where it is."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from skipscan.llm import packing, minhash
d = s.createDataFrame([(1, "a b c")], "doc_id long, text string")
assert packing.packed(d, packing.vocabulary_path).count() == 1 and minhash.near_duplicates(d).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
