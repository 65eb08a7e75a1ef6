"""corpus_pipeline stage by stage against plain Python, on a small corpus with known faults."""

import collections
import random

import pytest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = "the of and to in that is was for with as at by be this from or on".split() + ["".join(rng.choice("aeiourstlnmd") for _ in range(rng.randrange(3, 9))) for _ in range(400)]

    def line(n):
        return " ".join(rng.choices(vocabulary[:18], k=1)[0] if rng.random() < 0.45 else rng.choice(vocabulary) for _ in range(n)).capitalize() + "."

    def text(n=12):
        return "\n".join(line(rng.randrange(15, 30)) for _ in range(n))

    rows = [[i, text(), "en", "s", None] for i in range(60)]
    passage = line(60)
    item = line(30)
    for i in (5, 9):
        rows[i][1] += "\n" + passage
    rows[20][1] = rows[3][1]  # an exact copy
    rows[30][1] = rows[30][1] + " " + item  # a benchmark passage inside a line
    rows += [[100, None, "en", "s", 0], [101, "", "en", "s", 0], [102, "short", None, None, 5], [103, "#$% " * 200, "en", "s", 1], [None, text(), "en", "s", 1]]
    for r in rows:
        r[4] = len(r[1] or "")
    root = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_dropped string").repartition(3)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, passage, item


def test_stages(spark, corpus):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    root, rows, passage, item = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, root).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert len(seen[name]) == docs.count()
    assert set(seen["quality rules"]) == {r[0] for r in rows} - {100, 101, 102, 103}
    before, after = seen["quality rules"], seen["line dedup"]
    lines = collections.defaultdict(set)
    for i, r in before.items():
        for x in r.text.split("\n"):
            lines[x].add((-1 if i is None else i))
    for i, r in before.items():
        want = [x for x in r.text.split("\n") if min(lines[x]) == (-1 if i is None else i)]
        assert after[i].text == "\n".join(want) and after[i].n_chars == len(after[i].text) and after[i].n_dropped == "own"
    assert passage in after[5].text and passage not in after[9].text and after[20].text == ""
    sets = {}
    for i, r in after.items():
        w = r.text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    gone = {i for i in sets if i is not None and any(j is not None and j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)}
    assert set(seen["near-dedup"]) == set(after) - gone
    assert set(seen["near-dedup"]) - set(seen["decontamination"]) == {30}
    told = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, root).collect():
        pieces[r.doc_id] += r.length
    assert dict(pieces) == {i: len(told.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in seen["decontamination"].items()}
    whole = corpus_pipeline.run(spark, root).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in whole} == dict(pieces)


def test_empty_corpus(spark, corpus, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_of_stages_are_deleted(spark, corpus):
    import os

    import corpus_pipeline
    from skipscan.llm import common

    at = f"{common.shared_dir(spark)}/skipscan"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    corpus_pipeline.run(spark, corpus[0]).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before}
    # what the last stage reads, and small tables
    assert left <= {"decontamination", "pieces", "gone", "named", "rows"}
