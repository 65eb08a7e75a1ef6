"""Sharding by jump consistent hashing.

The key and the shard count decide; there is no ring table. With one more shard
a row either stays or goes to the new shard. Slots number a shard's rows without
gaps, in the order of a mix of key and checksum, then key, size and checksum: rows are
counted by shard and stretch of that mix, the counts of the stretches before are
added, and only a stretch's rows are sorted together. So two runs number alike,
whatever the partitions, and no shard is sorted by itself.

Edge cases: a null doc_id has the key 0; a null text has 0 bytes and the checksum 0; repeated rows get the
same shard and slots of their own; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skipscan.llm.common import batch_of, materialize, table

#: Bytes that a row takes beside its text.
ROW_BYTES = 16
#: Rows of a shard in a stretch, on average.
STRETCH = 20_000
#: Slots follow doc_id * MIX + checksum, modulo SPREAD.
MIX, SPREAD = 1_073_741_789, 1 << 32


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    key = keys.astype(np.uint64, copy=True)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while (going := ahead < shards).any():
        at[going] = ahead[going]
        with np.errstate(over="ignore"):
            key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[going] = ((at[going] + 1) * (float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
    return at


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    if shards < 1:
        raise ValueError("there must be a shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_id").fill_null(0).to_numpy()
            at, grown = jump(keys, shards).astype(np.int32), jump(keys, shards + 1).astype(np.int32)
            yield batch_of(**{c: b.column(c) for c in ("doc_id", "size", "text_crc32")}, shard=at, grown_shard=grown)

    placed = materialize(rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, grown_shard int"), "placed")
    stretches = max(1, -(-placed.count() // (shards * STRETCH)))
    mixed = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SPREAD)) * F.lit(MIX) + F.col("text_crc32"), F.lit(SPREAD))
    placed = placed.withColumn("mixed", mixed).withColumn("stretch", F.floor(F.col("mixed") / F.lit(-(-SPREAD // stretches))).cast("int"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("shard", "stretch").agg(F.count("*").alias("n")).select("shard", "stretch", F.coalesce(before, F.lit(0)).alias("skip"))
    own = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("mixed", "doc_id", "size", "text_crc32"))
    out = placed.select("*", own.alias("nth")).join(F.broadcast(counts) if shards * stretches <= 1_000_000 else counts, ["shard", "stretch"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("nth") - 1 + F.col("skip")).cast("long").alias("slot"), "grown_shard")


def op9(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40)


#: The checksum by a table of 256 entries, the jumps by recursion in 128-bit integers.
OP9_SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_concat([x::UBIGINT], range(0, 8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS t),
b AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes FROM documents),
c AS (SELECT r, doc_id, size, xor(list_reduce(list_concat([4294967295::UBIGINT], bytes), lambda c, x: xor(t[xor(c % 256, x)::BIGINT + 1], c // 256)), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM b, t),
m AS (SELECT r, n, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::HUGEINT AS key, -1::BIGINT AS spot, 0::BIGINT AS ahead FROM c, (VALUES (40), (41)) AS v(n)
  UNION ALL SELECT r, n, k, ahead, floor((ahead + 1) * (2147483648::DOUBLE / ((k // 8589934592)::DOUBLE + 1)))::BIGINT FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM m WHERE ahead < n)),
s AS (SELECT r, n, max(spot)::INTEGER AS shard FROM m GROUP BY r, n),
p AS (SELECT c.*, x.shard, y.shard AS grown_shard, ((((coalesce(doc_id, 0) % {SPREAD}) + {SPREAD}) % {SPREAD}) * {MIX} + text_crc32) % {SPREAD} AS mixed FROM c JOIN s x ON x.r = c.r AND x.n = 40 JOIN s y ON y.r = c.r AND y.n = 41)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY mixed, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM p
"""
