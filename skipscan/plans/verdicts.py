"""Three-valued verdicts on files: hit, absent or unknown; only absent may drop a file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIT, ABSENT, UNKNOWN = "hit", "absent", "unknown"


@dataclass(frozen=True)
class Partition:
    """A three-way split of a plan's files, by their places in it."""

    hits: frozenset = field(default_factory=frozenset)
    absent: frozenset = field(default_factory=frozenset)
    unknown: frozenset = field(default_factory=frozenset)

    def __post_init__(self):
        if self.hits & self.absent or self.hits & self.unknown or self.absent & self.unknown:
            raise ValueError("a file has one verdict")

    @staticmethod
    def all_unknown(files) -> Partition:
        return Partition(unknown=frozenset(files))

    @staticmethod
    def covered(files, covered, named) -> Partition:
        """Covered and named: hit; covered and not named: absent; not covered: unknown."""
        files, covered = frozenset(files), frozenset(covered)
        hits = files & covered & frozenset(named)
        return Partition(hits, (files & covered) - hits, files - covered)

    def both(self, other: Partition) -> Partition:
        files = self.files()
        if files != other.files():
            raise ValueError("verdicts on different files")
        absent = self.absent | other.absent
        hits = (self.hits & other.hits) - absent
        return Partition(hits, absent, files - absent - hits)

    def either(self, other: Partition) -> Partition:
        files = self.files()
        hits = self.hits | other.hits
        absent = (self.absent & other.absent) - hits
        return Partition(hits, absent, files - hits - absent)

    def negated(self) -> Partition:
        return Partition(self.absent, self.hits, self.unknown)

    def files(self) -> frozenset:
        return self.hits | self.absent | self.unknown

    def kept(self) -> frozenset:
        return self.hits | self.unknown


def verdicts(files: DataFrame, covered: DataFrame, named: DataFrame, where: str) -> DataFrame:
    """where, verdict for each file, as one plan; covered and named hold distinct files."""
    c = covered.select(where, F.lit(True).alias("covered"))
    n = named.select(where, F.lit(True).alias("named"))
    out = files.select(where).join(c, where, "left").join(n, where, "left")
    return out.select(where, F.when(F.col("covered").isNull(), UNKNOWN).when(F.col("named").isNotNull(), HIT).otherwise(ABSENT).alias("verdict"))


def holding_all(postings: DataFrame, key: str, where: str, wanted: list[str]) -> DataFrame:
    """Files in the postings (key, where) of every wanted key."""
    wanted = list(dict.fromkeys(wanted))
    return postings.where(F.col(key).isin(wanted)).select(key, where).distinct().groupBy(where).agg(F.count("*").alias("c")).where(F.col("c") == len(wanted)).select(where)
