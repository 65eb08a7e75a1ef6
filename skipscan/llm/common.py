"""What the operators share: table access, shared-folder tables, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most ids that may be broadcast by name, where they have been counted (8 bytes each).
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local master where none is set."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skipscan-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Where materialize() has written the tables that are still in use.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, survives
    a lost executor and gives the planner true sizes. discard() deletes it; what a
    lazy result still reads is the caller's to clear after the job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skipscan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize(), once all that was made of them is written."""
    for t in tables:
        if path := _WRITTEN.pop(t, None):
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def without(docs: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """docs without the rows that meet one of gone, whose columns must not clash with those of docs.

    gone is not looked at again once this returns: it is written and counted first. Up to BROADCAST_IDS rows it is broadcast, so that
    texts stay where they are; beyond, both sides are shuffled."""
    gone, (n, _) = measured(gone, "gone")
    return docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, on, "left_anti")


def measured(df: DataFrame, name: str, *keys: str) -> tuple[DataFrame, tuple[int, int]]:
    """materialize(), with the number of rows and an order-free checksum of keys,
    both gathered by the job that writes."""
    seen = Observation()
    check = F.sum(F.xxhash64(*keys).cast("decimal(38,0)")) if keys else F.lit(0)
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), check.alias("check")), name)
    got = seen.get
    return out, (int(got.get("n") or 0), int(got.get("check") or 0))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that carry whole texts to Python, by rows and bytes.

    Spark reads these settings when a query runs, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def batch_of(**columns) -> pa.RecordBatch:
    """An Arrow batch; Arrow's own arrays pass as they are, so that 64-bit ids beside nulls stay exact."""
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes; Python then gets them undecoded. Null: empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(data: bytes, k: int, lower: bool, alnum: bool = False) -> tuple[int, np.ndarray]:
    """(number of words, hash of each k-word window in order) of a text.

    Words are runs without ASCII white space, or with alnum runs of ASCII letters
    and digits and of what is beyond ASCII. With fewer than k words, but one,
    the whole sequence is the one window."""
    words = word_hashes(data, lower, alnum)
    n = len(words)
    if not n:
        return 0, words
    m = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - m + 1, np.uint64(m * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), np.uint64)
        for i in range(m):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
            out += words[i : i + n - m + 1]
        return n, mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_tables() -> dict:
    """Random values of bytes, and powers of an odd base and of its inverse."""
    rng = np.random.Generator(np.random.PCG64(20240607))
    base = 0x5851F42D4C957F2D
    size = 1 << 16
    with np.errstate(over="ignore"):
        power = lambda b: np.cumprod(np.array([1] + [b] * size, np.uint64), dtype=np.uint64)
        return {
            "bytes": rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            "up": power(base),
            "down": power(pow(base, -1, 2**64)),
            "size": size,
        }


_TABLES: dict = {}


def word_hashes(data: bytes, lower: bool, alnum: bool) -> np.ndarray:
    """A 64-bit polynomial hash of each word, in order, from prefix sums over the
    bytes; done in stretches that end between words, so that memory is bounded by
    one stretch and 8 bytes a word. A word longer than a stretch is hashed by
    pieces that are chained."""
    if not _TABLES:
        _TABLES.update(hash_tables())
    size = _TABLES["size"]
    gaps = bytes(c for c in range(128) if not chr(c).isalnum()) if alnum else b" \t\n\x0b\f\r"
    fold = bytes(32 if c in gaps else c + 32 if lower and 65 <= c <= 90 else c for c in range(256))
    data = data.translate(fold)
    out, at, carry = [], 0, None
    while at < len(data):
        end = min(len(data), at + size)
        whole = end == len(data)
        if not whole and (cut := data.rfind(b" ", at, end)) >= at:
            end, whole = cut + 1, True
        got = _hash_stretch(np.frombuffer(data, np.uint8, end - at, at))
        if carry is not None:
            with np.errstate(over="ignore"):
                joined = mixed(np.array([carry], np.uint64))[0] + (got[0] if data[at] != 32 and len(got) else np.uint64(0))
            got = np.concatenate(([joined], got[1:] if data[at] != 32 else got)).astype(np.uint64)
            carry = None
        if not whole and data[end - 1] != 32:
            carry, got = got[-1], got[:-1]
        out.append(got)
        at = end
    if carry is not None:
        out.append(np.array([carry], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hash_stretch(raw: np.ndarray) -> np.ndarray:
    inside = np.concatenate(([False], raw != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLES["bytes"][raw] * _TABLES["up"][: len(raw)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * _TABLES["down"][starts])
