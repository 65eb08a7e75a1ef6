"""Quality rules under weak supervision.

Each rule votes good (1), bad (0) or abstains (2). Votes are counted by pattern
over all documents (at most 3**rules patterns, whatever the corpus), and
expectation-maximisation over the pattern counts gives the share of good
documents and what each rule votes on good and on bad ones. A document is kept
if its posterior probability of being good is at least KEEP, and if it has not
failed the two base rules outright.

Edge cases: null, empty and white-space texts have no words and fail the base;
repeated rows are judged alike; an empty table gives no rows; ties in the first
majority count as good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.llm.common import batch_of, discard, materialize, shingle_hashes, small_batches, table, text_bytes

KEEP = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
ABSTAIN = 2

#: Frequent words of English, French, German and Spanish.
COMMON_WORDS = frozenset(
    "the and of to a in that is was for with on it be as at by he are this from or la de que el en los las del un una se por con no le les des et une est dans du au pour qui sur pas ce il der die und den von das ist ein eine zu mit im dem nicht für auf sich als auch".split()
)


def latin(f: dict[str, np.ndarray]) -> np.ndarray:
    return 2 * f["n_other"] <= f["n_letters"]


#: Rule, then vote from the features: (bad if, good if). Rules on words of Latin letters abstain where most letters are of other scripts.
RULES = {
    "symbols": (lambda f: f["n_symbols"] > 0.1 * f["n_words"], lambda f: f["n_symbols"] <= 0.01 * f["n_words"]),
    "dup_lines": (lambda f: f["n_dup_lines"] > 0.3 * f["n_lines"], lambda f: (f["n_dup_lines"] == 0) & (f["n_lines"] >= 3)),
    "repeats": (lambda f: f["n_repeat_words"] > 0.3 * f["n_words"], lambda f: f["n_repeat_words"] <= 0.05 * f["n_words"]),
    "word_length": (lambda f: latin(f) & ((f["word_chars"] > 7 * f["n_words"]) | (f["word_chars"] < 3 * f["n_words"])), lambda f: latin(f) & (f["word_chars"] >= 4.2 * f["n_words"]) & (f["word_chars"] <= 6.5 * f["n_words"])),
    "capitals": (lambda f: f["n_upper"] > 0.5 * f["n_letters"], lambda f: f["n_upper"] <= 0.1 * f["n_letters"]),
    "variety": (lambda f: (f["n_words"] >= 100) & (f["n_distinct"] < 0.25 * f["n_words"]), lambda f: f["n_distinct"] >= 0.4 * f["n_words"]),
    "common_words": (lambda f: latin(f) & (f["n_common"] < 0.02 * f["n_words"]), lambda f: f["n_common"] >= 0.1 * f["n_words"]),
    "letters": (lambda f: f["n_letters"] < 0.75 * f["word_chars"], lambda f: f["n_letters"] >= 0.9 * f["word_chars"]),
    "shouting": (lambda f: f["n_bangs"] > 0.2 * f["n_words"], lambda f: f["n_bangs"] <= 0.05 * f["n_words"]),
    "length": (lambda f: f["n_words"] < LEAST_WORDS, lambda f: f["n_words"] >= 2 * LEAST_WORDS),
}

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_common", "n_bangs", "n_other"]


def features(data: bytes) -> tuple[int, ...]:
    """FEATURES of a text."""
    words = data.split()
    if not words:
        return (0,) * len(FEATURES)
    joined = b"".join(words).decode("utf-8", "replace")
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, hashes = shingle_hashes(data, 3, lower=False)
    repeated = 0
    if n >= 3:
        _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        if twice.any():
            inside = np.zeros(n, bool)
            for i in range(3):
                inside[i : i + len(twice)] |= twice
            repeated = int(inside.sum())
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    common = sum(c for w, c in distinct.items() if len(w) < 12 and w.strip(b".,;:!?").lower().decode("utf-8", "replace") in COMMON_WORDS)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    upper = int(((cp >= 65) & (cp <= 90) | (cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7)).sum())
    folded = cp | np.uint32(32)
    letters = int(((folded >= 97) & (folded <= 122) & (cp < 128) | (cp >= 0xAA)).sum())
    other = int((cp >= 0x250).sum())
    symbols = sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    return n, len(joined), symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, len(distinct), common, data.count(b"!"), other


def votes(frame: dict[str, np.ndarray]) -> np.ndarray:
    """Rows by rules: 1 good, 0 bad, 2 abstains."""
    columns = []
    for bad, good in RULES.values():
        b, g = bad(frame), good(frame)
        columns.append(np.where(b, 0, np.where(g, 1, ABSTAIN)))
    return np.stack(columns, axis=1) if columns else np.zeros((0, 0))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(log odds of good, log-likelihood ratio [rule, vote]) by expectation-maximisation.

    It starts from the majority and adds one to each count, so that no vote is proof."""
    if not len(counts):
        return 0.0, np.zeros((len(RULES), 3))
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    p = np.clip((good + 1) / (good + bad + 2), 0.05, 0.95)
    p = np.where(bad * 2 > good, np.minimum(p, 0.2), p)
    hot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    weights = np.zeros((patterns.shape[1], 3))
    prior = 0.0
    for _ in range(rounds):
        shares = []
        for q in (p, 1 - p):
            c = np.einsum("i,ijk->jk", counts * q, hot) + 1
            shares.append(c / c.sum(1, keepdims=True))
        weights = np.log(shares[0]) - np.log(shares[1])
        total = (counts * p).sum() + 1, (counts * (1 - p)).sum() + 1
        prior = float(np.log(total[0]) - np.log(total[1]))
        odds = prior + np.einsum("ijk,jk->i", hot, weights)
        now = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    # Good documents are those for which more rules say so.
    if (weights[:, 1] - weights[:, 0]).sum() < 0:
        prior, weights = -prior, -weights
    return prior, weights


def measured_votes(docs: DataFrame) -> DataFrame:
    """doc_id, the features and the votes of each row, as a table."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([features(t.as_py()) for t in b.column("text")], np.int64).reshape(b.num_rows, len(FEATURES))
            frame = {c: got[:, i] for i, c in enumerate(FEATURES)}
            yield batch_of(doc_id=b.column("doc_id"), **frame, votes=pa.array(["".join(map(str, v)) for v in votes(frame).tolist()], pa.string()))

    schema = "doc_id long, " + "".join(f"{c} long, " for c in FEATURES) + "votes string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, schema)


def model(voted: DataFrame) -> tuple[float, np.ndarray]:
    """Fits the rules to the votes of all documents; what is collected is the pattern counts, at most 3**rules."""
    rows = voted.groupBy("votes").count().orderBy("votes").collect()
    patterns = np.array([[int(c) for c in r[0]] for r in rows], np.int64).reshape(len(rows), len(RULES))
    return fit(patterns, np.array([r[1] for r in rows], float))


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    posterior and kept for each row of docs."""
    voted = materialize(measured_votes(docs), "votes")
    prior, weights = model(voted)
    odds = F.lit(prior)
    for j in range(len(RULES)):
        vote = F.substring("votes", j + 1, 1)
        odds = odds + F.when(vote == "0", float(weights[j, 0])).when(vote == "1", float(weights[j, 1])).otherwise(float(weights[j, 2]))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    out = voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps."""
    voted = materialize(measured_votes(docs).select("votes"), "votes")
    prior, weights = model(voted)
    discard(voted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            got = np.array([features(t.as_py()) for t in texts], np.int64).reshape(b.num_rows, len(FEATURES))
            frame = {c: got[:, i] for i, c in enumerate(FEATURES)}
            v = votes(frame)
            odds = prior + weights[np.arange(len(RULES)), v].sum(1)
            keep = ~base_failed(frame["n_words"], frame["n_repeat_words"]) & (1 / (1 + np.exp(-np.clip(odds, -50, 50))) >= KEEP)
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=names).filter(pa.array(keep))

    # By place, as names may hold dots or clash with ours.
    names = docs.columns
    return docs.select("*", text_bytes().alias("text bytes")).toDF(*(f"c{i}" for i in range(len(names) + 1))).mapInArrow(run, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
