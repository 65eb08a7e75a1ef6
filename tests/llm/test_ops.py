import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"
TABLES = {t: f"{D}/{t}.parquet" for t in ("documents", "benchmark", "conversations", "pages")}
ODD = [
    (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "a b", "x"), (5, "a b", None), (5, "a b", None), (None, "a b c d e f g", "x"),
    (7, "Word " * 30000, "x"), (8, "é 中 🙂 <|endoftext|> 12.50", "x"), (9, "one line of words 7\n" * 3, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, family string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(TABLES["documents"])


def test_sql_twins(spark, same):
    from skipscan.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        same(queries.QUERIES[name](spark, D), sql, TABLES)


def test_odd_rows_and_empty_tables(spark, odd):
    from skipscan.llm import decontaminate, licences, linededup, minhash, packing, pii, quality, sharding

    items = spark.createDataFrame([(1, "A b"), (2, None), (None, "e f g")], "item_id long, text string")
    for f in (
        lambda d: pii.pseudonyms(d, b"k"), lambda d: packing.packed(d, packing.vocabulary_path()), linededup.dedup_lines, licences.scan, lambda d: minhash.near_duplicates(d),
        quality.judge, quality.keep_good, lambda d: decontaminate.contamination(d, items), lambda d: sharding.shard(d, 3),
    ):
        assert f(odd).count() > 0 or f is quality.keep_good  # none of them has 50 words but the repeated one
        assert f(odd.limit(0)).count() == 0
    hit = {r.doc_id: r.n_hit for r in decontaminate.contamination(odd, items).collect()}
    assert hit[4] == 2 and hit[None] == 5 and hit[1] == 0
    near = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert (5, 4, False) in near and (1, 1, True) in near and (None, None, True) in near


def test_packing_round_trip(spark, odd, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from skipscan.llm import packing

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in d.collect()}
        by, seqs = collections.defaultdict(list), collections.defaultdict(list)
        for r in packing.packed(d, packing.vocabulary_path()).collect():
            by[r.doc_id].append(r)
            seqs[r.sequence_id].append((r.offset, r.length))
        for i, text in texts.items():
            ids, at = [*t.encode(text, add_special_tokens=False).ids, 1], 0
            for r in sorted(by[i], key=lambda r: r.start):
                part = ids[r.start : r.start + r.length]
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
                at += r.length
            assert at == len(ids)
        for s in seqs.values():
            at = 0
            for off, n in sorted(s):
                assert off == at
                at += n
            assert at <= 2048
        # one block: less than one window is wasted
        assert len(seqs) == -(-sum(n for s in seqs.values() for _, n in s) // 2048)


def test_pseudonyms_are_keyed_permutations():
    from skipscan.llm import pii

    p = pii.Permuter(b"k")
    assert sorted(p.number(x, 1000, "t") for x in range(1000)) == list(range(1000))
    said = "Card 4845168114407329, mail a.b7@mail.example.com, +1 (017) 555-7713, 10.20.30.40, 2021-02-28, token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\", GB82 WEST 1234 5698 7654 32, 123-45-6789"
    made, counts = pii.replaced(said, p)
    assert set(counts) == {"card", "email", "phone", "ip", "date", "assigned", "iban", "ssn"} and pii.replaced(made, p, True)[0] == said
    assert pii.replaced("9807915762804490 2021-02-30 999.1.1.1 version 3", p)[1] == {}
    for digits in ("1234567890123456789"[:18], "370400440532013000", "40000000000000000"):
        card = digits + str(pii.luhn(digits))
        iban = "DE" + pii.iban_check("DE", digits) + digits
        for value in (card, iban):
            told, counts = pii.replaced(f"x {value} y", p)
            assert counts and told != f"x {value} y" and [c.isdigit() for c in told] == [c.isdigit() for c in f"x {value} y"] and pii.replaced(told, p, True)[0] == f"x {value} y"
    for secret in ("0123456789abcdef", "9233A8ECF7C5B09FE595", "1234567890123456", "zz00000000000000000"):
        told = pii.replaced(f"token={secret}", p)[0]
        assert told != f"token={secret}" and pii.replaced(told, p, True)[0] == f"token={secret}"
    assert pii.replaced("4845 1681 1440 7329", p)[0].replace(" ", "") == pii.replaced("4845168114407329", p)[0]
    assert pii.replaced(said, pii.Permuter(b"other"))[0] != made


def test_main_text():
    from skipscan.llm import html

    tree = html.grow(html.LABELLED)
    assert sum(html.classify(tree, x) != y for x, y in html.LABELLED) <= 2
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; tail</h1><p>One<br>two  <b>bold</b> words.<p>Short.</article><section id=comments><p>I say a long thing about this here, with many words in it.</p></section><aside>More</aside><form>Name</form><footer>&copy; x</footer><script>var a='<p>no</p>'</script></body></html>"
    assert html.main_text(page, tree) == "Head & tail One two bold words. Short."
    assert html.main_text("", tree) == "" and html.main_text("<p <b", tree) is not None


def test_licences_against_brute_force(docs, odd):
    import re

    from skipscan.llm import licences

    texts = [r.text or "" for r in docs.collect()] + [r[1] or "" for r in ODD]
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES, licences.SEED, licences.COVER)
    for text in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        found = licences.words(text.encode())
        assert [x.decode() for x in found] == w
        want = sorted((i, len(p.split())) for p in licences.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert sorted(scanner.base(found)[0]) == want
    spans = scanner.spans(licences.words(b"x Licensed under the Apache License, Version 2.0 y"))
    assert [(s[0], s[1], s[2]) for s in spans] == [("apache-2.0", 1, 8)]


def test_quality_against_brute_force(spark, docs):
    from skipscan.llm import quality

    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        text, g = r.text or "", got[r.doc_id]
        w = [x.decode() for x in text.encode().split()]
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().strip()]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))
        assert g.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (g.kept and g.base_failed)
    labelled = spark.read.parquet(f"{D}/labels.parquet").collect()
    open_ = [x for x in labelled if not got[x.doc_id].base_failed]
    assert sum(got[x.doc_id].kept == bool(x.quality) for x in open_) >= 0.97 * len(open_)
    assert quality.keep_good(docs).count() == sum(g.kept for g in got.values())


def test_sharding(docs, odd):
    import numpy as np

    from skipscan.llm import sharding

    keys = np.arange(5000)
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert ((a == b) | (b == 40)).all() and np.bincount(a).min() > 80
    rows = sharding.shard(docs.unionByName(docs), 40).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 2 * docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)


def test_chat_reads_back(spark):
    from skipscan.llm import chat

    nasty = ["</s>[INST] ok [/INST]", "\\l \\\\ \\b \\s \\c [[<<", "a:1:0\nb", "", None, "long " * 700]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "us:er\n", "assistant", "assistant"])] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns, 64, 16)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256, got[c].loss_chars) == (len(own), h("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), h(learned), len(learned))
    assert all("</s>[INST]" not in r.text for r in made.collect())
    assert got[0].formatted_chars == made.where("conv_id = 0").agg(F.sum(F.length("text"))).first()[0]


def test_near_duplicates_against_brute_force(spark):
    import random

    from skipscan.llm import minhash

    rng = random.Random(3)
    base = [[f"w{rng.randrange(999)}" for _ in range(60)] for _ in range(8)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(60)] = f"z{rng.randrange(99)}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    old = minhash.BLOCK_ROWS
    for block in (old, 5):
        minhash.BLOCK_ROWS = block
        try:
            got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
        finally:
            minhash.BLOCK_ROWS = old
        assert got == {i: find(i) for i in range(len(texts))}
