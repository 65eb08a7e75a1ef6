"""Upkeep of the indexes of many tables, one turn at a time."""

from __future__ import annotations

import logging
import time
import zlib
from collections.abc import Callable

from skipscan.functions import kinds
from skipscan.operators.build import BuildRefused, Index, Settings
from skipscan.sources.catalog import Catalog
from skipscan.sources.table import Table

LOG = logging.getLogger("skipscan.fleet")


class Fleet:
    """Brings the indexes of a catalog's tables up to date.

    wanted(name, table) gives the columns to index with their settings. Each turn begins
    one table further on, so that none always comes last. What a column's type, its absence
    or its settings refuse is refused again until the schema or the settings change, so it
    is remembered and not tried; a refusal by a limit or by another's lease is tried again."""

    def __init__(self, catalog: Catalog, wanted: Callable[[str, Table], dict[str, Settings]]):
        self.catalog, self.wanted, self.turns = catalog, wanted, 0
        self.refused: dict[tuple[str, str, int, str], str] = {}

    def order(self) -> list[str]:
        names = self.catalog.names()
        at = self.turns % len(names) if names else 0
        return names[at:] + names[:at]

    @staticmethod
    def _shape(table: Table) -> int:
        return zlib.crc32(table.head()["schema"].encode())

    def turn(self) -> list[dict]:
        """One pass over all tables: (table, column, outcome) with the kinds of builds, or why there was none."""
        out = []
        for name in self.order():
            self.catalog.invalidate(name)
            try:
                table = self.catalog.load(name)
                asked = self.wanted(name, table)
            except (KeyError, ValueError) as e:  # gone since it was listed, or no settings to be had
                out.append({"table": name, "column": None, "outcome": "failed", "why": str(e)})
                continue
            out += [{"table": name, "column": column, **self._column(name, table, column, s)} for column, s in asked.items()]
        self.turns += 1
        return out

    def _column(self, name: str, table: Table, column: str, settings: Settings) -> dict:
        key = (name, column, self._shape(table), repr(settings))
        if key in self.refused:
            return {"outcome": "refused", "why": self.refused[key]}
        try:
            settings.contract()
            kinds.kind_of(kinds.field_type(table.schema, column))
        except (BuildRefused, KeyError, kinds.NotIndexable) as e:
            self.refused[key] = str(e)
            LOG.warning("%s.%s is not indexed: %s", name, column, e)
            return {"outcome": "refused", "why": str(e)}
        try:
            index = Index(table, column)
            state = index.status()
            if state["indexed"] and not state["behind_snapshots"] and not state["partial"]:
                return {"outcome": "current"}
            return {"outcome": "built", "kinds": [r["kind"] for r in index.build(settings)]}
        except Exception as e:  # one table's failure leaves the others their turn
            LOG.warning("%s.%s: %s", name, column, e)
            return {"outcome": "failed", "why": f"{type(e).__name__}: {str(e)[:200]}"}

    def status(self, now_ms: int | None = None) -> list[dict]:
        """Each table and wanted column: whether it is indexed, by how many seconds and snapshots it is behind, and why it is refused."""
        out, now = [], now_ms or int(time.time() * 1000)
        for name in self.catalog.names():
            table = self.catalog.load(name)
            for column, settings in self.wanted(name, table).items():
                row = {"table": name, "column": column, "indexed": False, "behind_seconds": None, "behind_snapshots": len(table.snapshots()), "refused": self.refused.get((name, column, self._shape(table), repr(settings)))}
                if row["refused"] is None:
                    try:
                        state = Index(table, column).status()
                    except KeyError as e:
                        row["refused"] = str(e)
                    else:
                        late = table.snapshots()[-state["behind_snapshots"] :] if state["behind_snapshots"] else []
                        row |= {"indexed": state["indexed"], "behind_snapshots": state["behind_snapshots"], "behind_seconds": max(0, now - late[0].ts_ms) // 1000 if late else 0}
                out.append(row)
        return out
