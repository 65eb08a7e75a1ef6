"""Where tables come from by name: a catalog loads a table, keeps it, and forgets it when told."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import SparkSession

from skipscan.sources import store
from skipscan.sources.table import Table


class Catalog(Protocol):
    """What a host puts in place of FolderCatalog to serve tables of its own."""

    def names(self) -> list[str]: ...

    def load(self, name: str) -> Table: ...

    def invalidate(self, name: str) -> None: ...


class FolderCatalog:
    """The tables directly below a folder. A loaded table keeps its schema and the snapshots it
    has read until it is invalidated, as after it was dropped and made anew; its log is always read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._loaded: dict[str, Table] = {}

    def names(self) -> list[str]:
        return [n for n in store._names(self.spark, self.root, "") if store.exists(self.spark, f"{self.root}/{n}/table.json")]

    def load(self, name: str) -> Table:
        if not name or "/" in name or name in (".", ".."):
            raise KeyError(name)
        if name not in self._loaded:
            table = Table(self.spark, f"{self.root}/{name}")
            try:
                table.head()
            except ValueError as e:
                raise KeyError(name) from e
            self._loaded[name] = table
        return self._loaded[name]

    def invalidate(self, name: str) -> None:
        self._loaded.pop(name, None)
