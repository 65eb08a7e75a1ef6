"""Packing: Karmarkar-Karp multiway differencing into windows of a fixed capacity.

A document's ids, with the end id, are cut into full windows and one rest. Rests
are dealt by a hash into blocks of bounded size, and each block is packed by
itself: every rest starts as a partition of one filled and k-1 empty windows; the
two partitions of the largest imbalance are merged with their orders opposed,
until one is left. Its windows are near-equal; the few ids by which some exceed
the capacity are cut off and go to windows with room, and k rises where there is
no room left. So a block wastes less than one window.

Edge cases: a null text is an empty one (its only id is the end id); repeated
rows are packed as documents of their own; a null doc_id is kept as null; an
empty table gives no pieces; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.llm.common import batch_of, materialize, small_batches, table, text_bytes
from skipscan.llm.tokens import Encoder

CAPACITY = 2048
END_ID = 1
#: Rests in a block, on average; a task holds one block at a time.
BLOCK = 512

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of indexes into sizes, by largest differencing.

    A partition holds its non-empty windows alone, from the fullest; the k - len
    others are empty. Its imbalance is the fullest minus the emptiest window."""
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, tie, b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)  # so many of a's emptiest windows meet b's fullest
        merged = a[: len(a) - over] + b[over:] + [(a[-1 - j][0] + b[j][0], a[-1 - j][1] + b[j][1]) for j in range(over)]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], tie, merged))
    return [w[1] for w in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length), each of at most capacity together."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = [[(i, 0, sizes[i]) for i in w] for w in difference(sizes, k)]
        windows += [[] for _ in range(k - len(windows))]
        spare = []
        for w in windows:
            over = sum(x[2] for x in w) - capacity
            w.sort(key=lambda x: -x[2])
            while over > 0:
                i, start, n = w.pop(0)
                if n > over:
                    w.append((i, start, n - over))
                    n, start = over, start + n - over
                spare.append((i, start, n))
                over -= n
        for w in windows:
            room = capacity - sum(x[2] for x in w)
            while room > 0 and spare:
                i, start, n = spare.pop()
                if n > room:
                    spare.append((i, start + room, n - room))
                    n = room
                w.append((i, start, n))
                room -= n
        if not spare:
            return [w for w in windows if w]
        k += 1


def pieces(docs: DataFrame, vocabulary: str | Callable[[], str], capacity: int, blocks: int) -> DataFrame:
    """One row for each full window (block -1; it is a sequence by itself) and each rest, which carries its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(vocabulary if isinstance(vocabulary, str) else vocabulary()), 0
        for batch in batches:
            texts = [t.as_py().decode("utf-8", "replace") for t in batch.column("text")]
            known = batch.column("doc_id").to_pylist()
            ids, counts = encoder.encode(texts)
            ids, at, out = ids.astype("<u4"), 0, []
            for i, n in enumerate(counts.tolist()):
                raw = ids[at : at + n].tobytes() + END_ID.to_bytes(4, "little")
                at, n = at + n, n + 1
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    crc = zlib.crc32(raw[4 * start : 4 * (start + size)])
                    if size == capacity:
                        out.append((known[i], start, size, crc, n, -1, None))
                    else:
                        out.append((known[i], start, size, crc, n, zlib.crc32(f"{known[i]} {n} {crc} {row}".encode()) % blocks, raw[4 * start :]))
                row += 1
            yield arrow(out, PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(cut, PIECES)


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of the columns that schema names, long or binary."""
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return batch_of(**{c: pa.array(x, pa.binary() if t == "binary" else pa.int64()) for (c, t), x in zip(names, columns, strict=True)})


def packed(docs: DataFrame, vocabulary: str | Callable[[], str], capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Rows of PACKED: where each piece of each document stands.

    A document's ids are in its pieces once each, by start and length. vocabulary is
    the tokenizers file on the executors, or a function that finds it there."""
    if capacity < 2:
        raise ValueError("capacity must be 2 at least")
    small_batches(docs.sparkSession)
    names = PACKED.replace(" long", "").split(", ")
    blocks = max(1, -(-docs.count() // block))
    cut = materialize(pieces(docs, vocabulary, capacity, blocks), "pieces")

    def fill(rests: pa.Table) -> pa.Table:
        rows = sorted(zip(*(rests.column(c).to_pylist() for c in ("length", "doc_id", "ids_crc32", "start", "doc_tokens", "ids")), strict=True), key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2]))
        number, out = rests.column("block")[0].as_py(), []
        for i, window in enumerate(pack([r[0] for r in rows], capacity)):
            at = 0
            for j, start, n in window:
                _, doc_id, _, first, tokens, ids = rows[j]
                out.append((doc_id, first + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, 2 * (i * blocks + number), at))
                at += n
        return pa.Table.from_batches([arrow(out, PACKED)])

    full = cut.where("block < 0").select(*names[:5], (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.where("block >= 0").groupBy("block").applyInArrow(fill, PACKED).unionByName(full)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary_path)
