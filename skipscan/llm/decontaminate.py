"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

A window is `size` consecutive words of an item (all of a shorter item's words), and
its tokens are its two-word shingles (the word itself where it has one alone). A
document holds a window only if it holds the window's rarest shingle, so rarity is
counted over all documents, each window is filed under its rarest shingle and that
shingle's place in it (a prefix of one token suffices, as all must be there), and
documents bring only places of such shingles, with the words around them. Bounds on
length (the window must fit in) and position (the rarest shingle fixes where it
starts) come before the exact comparison of all words.

Documents are read through a sieve: one byte for each residue of the wanted shingles'
hashes, of a size that follows their number up to 2**SIEVE bytes. It lets every
wanted shingle pass, and of the others a few; the join after it decides. So there is
one plan for benchmarks of all sizes. Everything is DataFrame functions.

Edge cases: a null or empty text has no words, hits or items; an item without
words has no window; items of equal text all count; rows of one doc_id and text
are judged alike; a null doc_id is kept as null; a null item_id counts as an item
but is not listed; an empty benchmark leaves every document clean; other columns
are not looked at, and clean() keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skipscan.llm.common import ascii_lower, discard, materialize, measured, table, without

#: Signs between words, one by one: a class of ranges takes some twenty times as long in Java's patterns.
GAPS = "".join(f"\\x{c:02X}" for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))
WORD = f"[^{GAPS}]+"
SIZE = 10
#: Powers of two: bytes of a sieve, at least and at most.
SIEVE = (16, 24)
#: Most filed windows that are broadcast (some 150 bytes each); beyond, both sides are shuffled.
BROADCAST_WINDOWS = 250_000


def words_of(col: str) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item_id, window (array of words), one row for each distinct window of an item."""
    w = items.select(F.col("item_id"), words_of("text").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()


def shingles(words: Column) -> Column:
    """The hash of each word and the next; at the last one, of the word alone."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def sieve(wanted: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that all values of a column (64-bit) pass, and few others.

    What comes to the driver is a bitmap of the residues, bounded by the sieve's size."""
    n = wanted.count()
    size = 1 << max(SIEVE[0], min(SIEVE[1], (8 * n).bit_length()))
    bits = wanted.select((F.pmod(key, F.lit(size)) + 1).alias("r")).groupBy(F.bitmap_bucket_number("r").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("r")).alias("bits"))
    spread = [bytes(byte >> i & 1 for i in range(8)) for byte in range(256)]
    found = {r["at"]: b"".join(spread[byte] for byte in bytes(r["bits"])) for r in bits.collect()}
    blank = bytes(32768)
    held = F.lit(b"".join(found.get(i + 1, blank) for i in range(size // 32768)))
    return lambda x: F.substring(held, F.pmod(x, F.lit(size)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def keys_of(windows: DataFrame) -> DataFrame:
    """window, at, sh: the shingles of each distinct window and their places from 0."""
    w = windows.select("window").distinct()
    n = F.greatest(F.size("window") - 1, F.lit(1))
    return w.select("window", F.posexplode(F.slice(shingles(F.col("window")), F.lit(1), n)).alias("at", "sh"))


def spots(words: Column, passes: Callable[[Column], Column], alone: bool) -> Column:
    """(i, sh) of each place whose shingle passes, or if wanted its word alone."""
    kept = lambda hashes: F.filter(F.transform(hashes, lambda x, i: F.when(passes(x), F.struct(i.cast("int").alias("i"), x.alias("sh")))), lambda x: x.isNotNull())
    pairs = kept(shingles(words))
    return F.array_distinct(F.concat(pairs, kept(F.transform(words, lambda x: F.xxhash64(x))))) if alone else pairs


def filed(docs: DataFrame, windows: DataFrame, alone: bool) -> tuple[DataFrame, tuple[int, int]]:
    """Windows under their rarest shingle over all documents: sh, at (its place in the window, from 0); written and counted."""
    vocabulary = materialize(keys_of(windows), "vocabulary")
    passes = sieve(vocabulary.select("sh").distinct(), "sh")
    said = docs.select(words_of("text").alias("w")).select(F.explode(F.transform(spots(F.col("w"), passes, alone), lambda x: x["sh"])).alias("sh"))
    seen = said.groupBy("sh").agg(F.count("*").alias("c"))
    ranked = vocabulary.join(seen, "sh", "left").select("window", "at", "sh", F.coalesce("c", F.lit(0)).alias("seen"))
    rare = ranked.groupBy("window").agg(F.min(F.struct("seen", "sh", "at")).alias("m")).select("window", "m.sh", "m.at")
    out = measured(windows.join(rare, "window").select("item_id", "window", "sh", "at"), "prefix")
    discard(vocabulary)
    return out


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(documents, occurrences), both written: doc_id, th, n_words of each distinct row, and
    doc_id, th, item_id, start, length of each place where a window stands."""
    windows = materialize(windows_of(items, size), "windows")
    alone = not windows.where("size(window) = 1").isEmpty()
    prefix, (n, _) = filed(docs, windows, alone)
    passes = sieve(prefix.select("sh").distinct(), "sh")
    # A text is known by doc_id and a hash; equal rows have equal results.
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string"), F.col("text").isNull()).alias("th"), words_of("text").alias("w"))
    around = lambda x: F.struct(x["i"].alias("i"), x["sh"].alias("sh"), F.greatest(x["i"] - size + 1, F.lit(0)).alias("from"), F.slice("w", F.greatest(x["i"] - size + 2, F.lit(1)), F.least(x["i"] + 1, F.lit(size)) + size - 1).alias("near"))
    rows = materialize(read.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.transform(spots(F.col("w"), passes, alone), around).alias("places")), "places")
    met = rows.select("doc_id", "th", "n_words", F.explode("places").alias("p")).select("doc_id", "th", "n_words", "p.*")
    met = met.join(F.broadcast(prefix) if n <= BROADCAST_WINDOWS else prefix, "sh")
    start = F.col("i") - F.col("at")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    same = F.slice("near", start - F.col("from") + 1, F.size("window")) == F.col("window")
    found = met.where(fits).where(F.when(fits, same)).select("doc_id", "th", "item_id", start.cast("long").alias("start"), F.size("window").cast("long").alias("length"))
    found = materialize(found.distinct(), "occurrences")
    discard(windows, prefix)
    return rows, found


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    rows, found = hits(docs, items, size)
    rows = rows.select("doc_id", "th", "n_words")
    spans = found.groupBy("doc_id", "th", "start").agg(F.max("length").alias("length"))
    order = Window.partitionBy("doc_id", "th").orderBy("start")
    reach = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("length")
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))), F.lit(0))
    covered = spans.select("doc_id", "th", fresh.alias("fresh")).groupBy("doc_id", "th").agg(F.sum("fresh").alias("n_hit"))
    held = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"), (F.count_distinct("item_id") + F.max(F.col("item_id").isNull().cast("long"))).alias("n_items"))
    c, h = covered.alias("c"), held.alias("h")
    per = h.join(c, F.expr("h.doc_id <=> c.doc_id AND h.th = c.th")).select(F.col("h.doc_id").alias("d"), F.col("h.th").alias("t"), "ids", "n_items", "n_hit")
    out = rows.join(per, F.expr("doc_id <=> d AND th = t"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    joined = F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item."""
    rows, found = hits(docs, items, size)
    own = "th of clean"
    dirty = found.select(F.col("doc_id").alias("d of clean"), F.col("th").alias(own)).distinct()
    told = F.xxhash64(docs["text"].cast("string"), docs["text"].isNull())
    out = without(docs, dirty, docs["doc_id"].cast("long").eqNullSafe(F.col("d of clean")) & (told == F.col(own)))
    discard(rows, found)
    return out


def op8(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS x FROM b)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS x FROM d, ns WHERE len(w) >= n),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
"""
