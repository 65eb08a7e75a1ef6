"""Work on long inputs grows with their length."""

import time


def within(seconds, f, *args):
    began = time.perf_counter()
    out = f(*args)
    assert time.perf_counter() - began < seconds
    return out


def test_pseudonyms_of_percent_encoded_text():
    from skipscan.llm import pii

    p = pii.Permuter(b"k")
    within(20, pii.replaced, "%41%42" * 800_000 + "7", p)
    made, counts = within(20, pii.replaced, "a%b" * 300_000 + " mail x%y.z@example.com", p)
    assert counts == {"email": 1}


def test_many_notices():
    from skipscan.llm import licences

    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES, licences.SEED, licences.COVER)
    # each of the 100,000 is covered by two notices, which share four of five words
    assert len(within(20, scanner.spans, licences.words(b"Licensed under the MIT License. foo " * 100_000))) == 200_000


def test_many_lines(spark):
    from skipscan.llm import linededup

    text = "\n".join(f"{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760 % 26)} word one two three" for i in range(150_000))
    rows = [(1, text), (2, text + "\nown line stands at the end")]
    got = {r.doc_id: r for r in within(90, lambda: linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    assert got[1].text == text and got[2].text == "own line stands at the end" and got[2].n_dropped == 150_000


def test_a_conversation_of_many_turns(spark):
    from skipscan.llm import chat

    turns = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 5000 = 0 THEN 'system' WHEN id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role", "repeat('word ', 60) AS text")
    made = chat.windows(turns, 512, 128)
    got = within(120, lambda: chat.digests(made).collect())
    assert [(r.n_turns, r.loss_chars) for r in got] == [(20_000, 300 * (10_000 - 4))]


def test_windows_keep_to_the_budget(spark, same, tmp_path, monkeypatch):
    """Against SQL over stretches, chunks, system turns and histories of many shapes."""
    import random
    import re

    from skipscan.llm import chat

    rng = random.Random(5)
    rows = []
    for c in range(30):
        for t in range(rng.choice([1, 3, 80, 200])):
            role = rng.choice(["user", "assistant", "assistant", "system" if rng.random() < 0.1 else "user"])
            rows.append((c, rng.randrange(9000) if c % 3 == 0 else t, role, " ".join(["w[<\\"] * rng.choice([0, 1, 5, 30, 120, 700]))))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    probe = spark.sql(chat.PROBE)
    made = chat.windows(turns.unionByName(probe))
    same(chat.digests(made), chat.OP10_SQL, {"conversations": str(tmp_path / "conversations.parquet" / "*.parquet")})
    for r in made.collect():
        parts = r.text[3:-5].split("</s>\n<s>")
        new = [p for p in parts if re.match(r"^[\s\S]*?:-?\d+/\d+:0\n", p)]
        n = [len(re.findall(r"\w+|[^\w\s]", chat_text(p))) + chat.MARKS for p in parts]
        old = sum(n[: len(parts) - len(new)])
        assert len(new) == 1 or sum(n) <= chat.BUDGET or old > chat.BUDGET - 1


def chat_text(part):
    import re

    body = re.sub(r"^[\s\S]*?:-?\d+/\d+:[01]\n", "", part, count=1)
    return body.replace("\\\\", "[").replace("\\l", "<").replace("\\b", "[")
