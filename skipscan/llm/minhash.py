"""MinHash near-dedup: universal-hash minima, banding, signature and full-set
verification, components by large-star and small-star.

1. Each text gives the 64-bit hashes of its distinct word windows, their number,
   a 128-bit fingerprint of the set, and the minima under n universal hashes.
   Texts of equal sets are one class from here on, and classes link, not copies.
2. Rows of minima are banded. Whatever links shares a bucket. No bucket is expanded
   into pairs: its least class is its hub, and each class is compared with one hub,
   the one it meets in most buckets. The components of these links are labels.
3. A bucket that still holds several labels is open. Its classes of other labels than
   its most frequent one are compared with all its classes, in blocks of bounded
   size, and only across labels; a pair is compared in the first bucket that both
   share. In a block, the sizes must allow the similarity and the signatures must
   agree in nearly as many places; what is left of the block is read again with full
   sets, which decide. A block returns a spanning forest of its links, not the pairs.
4. The components of all links are the groups.

A pair at the threshold shares no band with a probability below MISS.

Edge cases: null, empty and white-space texts have an empty set and link with
nothing; with fewer words than a window has, the whole sequence is the one
window; rows of one doc_id are one node; rows with a null doc_id stay by
themselves (component_id null, kept). Other columns are not looked at, and
keep_first() keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.llm.common import batch_of, discard, materialize, measured, mixed, shingle_hashes, small_batches, table, text_bytes, without
from skipscan.llm.components import components

ROWS = 8
MISS = 1e-5
#: Minima of which a signature keeps a byte.
SIGNED = 128
#: Classes, and window hashes of their sets, in one block.
BLOCK_ROWS, BLOCK_HASHES = 1000, 1_000_000
#: Rows of block pairs in a bin, on average, and pairs that are looked at together.
BIN_ROWS, PAIRS = 1000, 100_000
#: Most classes whose ids, sizes and fingerprints are broadcast (32 bytes each).
BROADCAST_CLASSES = 250_000
#: Standard deviations by which an estimate may fall below the threshold.
SLACK = 5


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingle_set(data: bytes, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(data, k, lower=True)[1])


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set fingerprint (a, b), band keys, one byte of each minimum."""
    n = bands * ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(91))
        mul = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        add = rng.integers(0, 2**32, n, dtype=np.uint32)
        salt = rng.integers(1, 2**63, bands, dtype=np.uint64)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                x = (s >> np.uint64(32)).astype(np.uint32)
                least = np.full(n, 2**32 - 1, np.uint32)
                for i in range(0, len(x), 512):
                    np.minimum(least, (x[i : i + 512, None] * mul + add).min(axis=0), out=least)
                with np.errstate(over="ignore"):
                    key = salt.copy()
                    for r in range(ROWS):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS])
                    prints = s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                out.append((len(s), *(int(p.astype(np.int64)) for p in prints), key.astype(np.int64), (least[:SIGNED] & 255).astype(np.uint8).tobytes()))
            size, first, second, keys, sig = zip(*out, strict=True) if out else [()] * 5
            yield batch_of(doc_id=batch.column("doc_id"), n=pa.array(size, pa.int64()), a=pa.array(first, pa.int64()), b=pa.array(second, pa.int64()), bands=pa.array(keys, pa.list_(pa.int64())), sig=pa.array(sig, pa.binary()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n long, a long, b long, bands array<long>, sig binary")


def with_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, n, items: the full sets of the classes of wanted (node, rep, n, a, b), read from a text of the row rep."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column("text")]
            first = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            yield batch_of(rep=batch.column("rep"), sum=pa.array(first, pa.int64()), items=pa.array([s.tobytes() for s in sets], pa.binary()))

    few, (n, _) = measured(wanted, "wanted")
    known = F.broadcast(few) if n <= BROADCAST_CLASSES else few
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_bytes().alias("text")).join(known.select("rep"), "rep", "left_semi")
    met = texts.mapInArrow(full, "rep long, sum long, items binary").join(known, "rep").where("length(items) = 8 * n AND sum = a")
    out = materialize(met.dropDuplicates(["node"]).select("node", "n", "items"), "sets")
    discard(few)
    return out


def blocks_of(rows: str, hashes: str):
    """How many blocks so many classes with so many window hashes make."""
    return F.greatest(F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(hashes) / BLOCK_HASHES)), F.lit(1)).cast("int")


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: the pairs (node, hub) that link. A hub's classes are dealt to blocks, and it is sent to each."""
    sized = pairs.join(sets.select("node", "n"), "node")
    counts = sized.groupBy("hub").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes")).select("hub", blocks_of("rows", "hashes").alias("blocks"))
    members = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node")
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        is_hub = rows["node"] == rows["hub"]
        hub = np.frombuffer(rows["items"][is_hub].iloc[0], np.uint64)
        out = []
        for node, v, items in rows.loc[~is_hub, ["node", "hub", "items"]].itertuples(index=False):
            s = np.frombuffer(items, np.uint64)
            if 100 * min(len(s), len(hub)) >= percent * max(len(s), len(hub)):
                both = len(np.intersect1d(s, hub, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(hub) - both):
                    out.append((node, v))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return members.unionByName(hubs).join(sets, "node").groupBy("hub", "block").applyInPandas(compare, "u long, v long")


def pairs_of(group: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs to compare, about PAIRS at a time, in rows that stand in order of their groups
    (key, i, j): of block i with block j, or within one block."""
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    left, right, held = [], [], 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        one, two = a + np.flatnonzero(block[a:b] == i[a]), a + np.flatnonzero(block[a:b] == j[a])
        step = max(1, PAIRS // max(1, len(two)))
        for c in range(0, len(one), step):
            x, y = np.repeat(one[c : c + step], len(two)), np.tile(two, len(one[c : c + step]))
            if i[a] == j[a]:
                x, y = x[x < y], y[x < y]
            left.append(x)
            right.append(y)
            held += len(x)
            if held >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def candidates(rows: pa.Table, percent: int, agree: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(rows in order of their groups, places of the pairs that may link): across labels, by sizes
    and signatures, and only in the first bucket that both share."""
    rows = rows.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")]).combine_chunks()
    column = lambda c: rows.column(c).to_numpy()
    n, label, key, i, j = map(column, ("n", "label", "key", "i", "j"))
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(n), -1)
    place = (bands == key[:, None]).argmax(1)
    _, ids = np.unique(np.stack([key, i.astype(np.int64), j.astype(np.int64)]), axis=1, return_inverse=True)
    out = []
    for x, y in pairs_of(ids.ravel(), column("block"), i, j):
        able = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[able], y[able]
        able = (bands[x] == bands[y]).argmax(1) == place[x]
        x, y = x[able], y[able]
        able = (sig[x] == sig[y]).sum(1) >= agree
        out.append((x[able], y[able]))
    none = np.zeros(0, np.int64)
    return rows, np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(y for _, y in out)])


def open_links(met: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, agree: int) -> DataFrame:
    """u, v: a spanning forest, by block, of the links across labels in the buckets of met (key, node)."""
    size = classes.select("node", "n")
    rows = met.select("key", "node").join(size, "node").join(labels.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes"))
    buckets = by_label.groupBy("key").agg(F.max(F.struct("rows", "hashes", "label")).alias("most"), F.count("*").alias("labels"), F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes")).where("labels > 1")
    buckets = buckets.select("key", F.col("most.label").alias("most"), F.col("most.rows").alias("r"), F.col("most.hashes").alias("h"), (F.col("rows") - F.col("most.rows")).alias("r1"), (F.col("hashes") - F.col("most.hashes")).alias("h1"))
    buckets = buckets.select("key", "most", blocks_of("r1", "h1").alias("few"), blocks_of("r", "h").alias("many"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("most"), F.col("many")).otherwise(F.col("few"))).cast("int")
    rows = rows.join(buckets, "key").withColumn("block", F.when(F.col("label") == F.col("most"), F.col("few") + mine).otherwise(mine))
    last = F.when(F.col("label") == F.col("most"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    dealt = rows.select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0), last)).alias("to"))
    dealt, (many, _) = measured(dealt.select("key", "node", "label", "block", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j")), "dealt")
    names = ["key", "i", "j", "node", "label", "block"]

    def look(rows: pa.Table) -> pa.Table:
        rows, x, y = candidates(rows, percent, agree)
        return rows.select(names).take(pa.array(np.union1d(x, y)))

    def link(rows: pa.Table) -> pa.Table:
        rows, x, y = candidates(rows, percent, agree)
        items, node = rows.column("items").combine_chunks(), rows.column("node").to_numpy()
        parent = list(range(len(node)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        out: list[tuple[int, int]] = []
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            a, b = root(u), root(v)
            if a == b:
                continue
            one, two = (np.frombuffer(items[k].as_buffer(), np.uint64) for k in (u, v))
            both = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * both >= percent * (len(one) + len(two) - both):
                parent[max(a, b)] = min(a, b)
                out.append((int(node[u]), int(node[v])))
        left, right = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    # Small groups are dealt to bins, so that a call has many of them; none is split.
    binned = lambda d, rows: d.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, rows // BIN_ROWS))))
    wide = dealt.join(classes.select("node", "n", "bands", "sig"), "node")
    kept, (found, _) = measured(binned(wide, many).groupBy("bin").applyInArrow(look, "key long, i int, j int, node long, label long, block int"), "kept")
    wide = kept.join(classes.select("node", "n", "bands", "sig"), "node").join(sets.select("node", "items"), "node")
    out = materialize(binned(wide, found).groupBy("bin").applyInArrow(link, "u long, v long"), "links")
    discard(dealt, kept)
    return out


def linked(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """u, v: links between classes that give their components, as a table."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1").select("key", "hub")
    met = materialize(keyed.join(least, "key"), "met")
    sets = with_sets(docs, classes.select("node", "rep", "n", "a", "b").join(met.select("node").distinct(), "node", "left_semi"), k)
    often = met.where("node != hub").groupBy("node", "hub").agg(F.count("*").alias("c"))
    pairs = often.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("m")).select("node", "m.hub")
    first = materialize(hub_links(pairs, sets, percent), "links")
    labels = components(first)
    at = percent / 100
    agree = math.floor(SIGNED * at - SLACK * math.sqrt(SIGNED * at * (1 - at)))
    second = open_links(met, classes, sets, labels, percent, agree)
    out = materialize(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u != v").unionByName(second), "links")
    discard(met, sets, first, labels, second)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    if not 0 < percent <= 100 or k < 1:
        raise ValueError("k must be positive and percent in 1..100")
    small_batches(docs.sparkSession)
    signed = materialize(signatures(docs, k, bands_for(min(percent, 99))), "signatures")
    rows, (total, _) = measured(signed.select("doc_id", "n", "a", "b"), "rows")
    live = rows.where("n > 0 AND doc_id IS NOT NULL")
    key = ["n", "a", "b"]
    reps = live.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    # A class goes by its least doc_id, but where rows of one doc_id differ, by a hash; such rows link their classes.
    several = live.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x != y").select("doc_id")
    several, (twice, _) = measured(several, "several")
    node = F.col("rep")
    if twice:
        reps = reps.join(several.select(F.col("doc_id").alias("rep"), F.lit(True).alias("differs")), "rep", "left")
        node = F.when(F.col("differs"), F.xxhash64(*key)).otherwise(node)
    reps = materialize(reps.select(*key, "rep", "c", node.alias("node")), "reps")
    whole = signed.join(reps.select(F.col("rep").alias("doc_id"), *key, "rep", "node"), ["doc_id", *key]).dropDuplicates(["node"])
    classes = materialize(whole.select("node", "rep", *key, "bands", "sig"), "classes")
    discard(signed)
    found = linked(docs, classes, k, percent)
    links = found
    if twice:
        both = live.join(several, "doc_id", "left_semi").join(reps, key).select("doc_id", "node")
        links = found.unionByName(both.join(both.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").select(F.col("node").alias("u"), "v").where("u != v"))
    labels = components(links)
    discard(classes, several, found)
    # What is not linked and has one text needs no join: its component is its own.
    named = reps.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("c").alias("of")).where("of > 1")
    named = materialize(named.select(*key, "c", "component").join(least, "component").select(*key, "c", "component_id"), "named")
    discard(reps, labels)
    # A class of more than a thousandth of all rows, of which there are fewer than a thousand, is broadcast; so no task gets a large class.
    large = max(1000, total // 1000)
    hot, cold = F.broadcast(named.where(F.col("c") > large).drop("c")), named.where(F.col("c") <= large).drop("c")
    own = rows.where("n > 0 AND doc_id IS NOT NULL")
    alone = rows.where("NOT n > 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    of = own.join(hot, key).unionByName(own.join(hot, key, "left_anti").join(cold, key, "left")).unionByName(alone)
    out = of.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps."""
    gone = near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias("doc_id of a copy")).distinct()
    return without(docs, gone, docs["doc_id"].cast("long") == F.col("doc_id of a copy"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS items FROM w),
n AS (SELECT doc_id, len(items) AS n FROM s),
x AS (SELECT doc_id, unnest(items) AS item FROM s),
p AS (SELECT l.doc_id AS x, r.doc_id AS y, count(*) AS c FROM x l JOIN x r ON l.item = r.item AND l.doc_id < r.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
b AS (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE b.v > r.root)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
