"""Small JSON documents beside the data, through Hadoop's file systems, so that any store Spark reads will do.

A document is a folder of numbered versions. A version is written aside and put in
place only where no other has its number, so of two writers one fails and reads
again, and a reader sees a whole version or none. The highest number is current."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str):
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create_only(spark: SparkSession, path: str, doc) -> bool:
    """Puts a whole document at path if nothing is there yet; whether it did.

    On a local file system by a hard link, elsewhere by a rename that does not
    overwrite, which the file system must make atomic (as HDFS does)."""
    fs, p = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(json.dumps(doc, sort_keys=True).encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), p.toUri().getPath())
            return True
        return not fs.exists(p) and fs.rename(aside, p)
    except FileExistsError:
        return False
    finally:
        if fs.exists(aside):
            fs.delete(aside, False)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str, end: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(end) and not n.startswith((".", "_")))


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, path, ".json")]


def version_path(path: str, n: int) -> str:
    return f"{path}/{n:012d}.json"


def read_latest(spark: SparkSession, path: str):
    """(number, document) of the highest version, or (0, None)."""
    have = versions(spark, path)
    return (have[-1], read_json(spark, version_path(path, have[-1]))) if have else (0, None)


def put_next(spark: SparkSession, path: str, after: int, doc) -> bool:
    """Writes version after + 1, unless another writer has; whether it did."""
    return create_only(spark, version_path(path, after + 1), doc)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files under a folder, also in folders of partition values, by path."""
    fs, p = _fs(spark, path)
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        at = it.next().getPath()
        if at.getName().endswith(".parquet"):
            found.append(at.toString())
    return sorted(found)


def same_path(path: str) -> str:
    """A path in one spelling, however many slashes follow its scheme."""
    scheme, colon, rest = path.partition(":/")
    return f"{scheme}:/{rest.lstrip('/')}" if colon else f"file:/{path.lstrip('/')}"
