"""Exact counts from the term dictionary, or a refusal with its reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from skipscan.functions import kinds, text
from skipscan.operators import dictionary as D
from skipscan.operators.build import Index
from skipscan.plans.scan import PREFIX_TERMS, _range, _Tiers
from skipscan.sources.table import Table


class CountRefused(RuntimeError):
    def __init__(self, code: str, reason: str):
        super().__init__(f"{code}: {reason}")
        self.code = code


def count(table: Table, column: str, term: str | None = None, prefix: str | None = None) -> dict:
    """Occurrences (rows, on a value index) and files of a term or of all terms with a prefix."""
    if (term is None) == (prefix is None):
        raise CountRefused("bad_request", "give a term or a prefix")
    now = table.current()
    if not now:
        return {"count": 0, "files": 0}
    try:
        kinds.field_type(table.schema, column)
        index = Index(table, column)
    except (KeyError, kinds.NotIndexable) as e:
        raise CountRefused("no_column", str(e)) from e
    meta = index.meta()
    if not meta or not meta["tiers"][2]:
        raise CountRefused("no_index", "no term index")
    if now.delete_files:
        raise CountRefused("deletes", "rows may have been deleted")
    value = meta["analyzer"] == "value"
    if prefix is not None:
        prefix = prefix if value else prefix.translate(str.maketrans(text.UPPER, text.LOWER))
        if not text.prefixable(prefix, meta["analyzer"]):
            raise CountRefused("prefix", "no term can start so")
    else:
        asked = text.query_terms(term, meta["analyzer"])
        if len(asked) != 1:
            raise CountRefused("terms", f"{len(asked)} terms, not one")
        if not text.indexable(asked[0], meta["cap"], meta["analyzer"]):
            raise CountRefused("not_indexable", "such terms are not in the index")
    if meta["snapshot"] != now.id:
        raise CountRefused("stale", "the index is behind the table")
    if meta["partial"]:
        raise CountRefused("partial", "the index is being built")
    if not meta["counts_exact"]:
        raise CountRefused("inexact", "files have gone since the last full build")
    terms = index.terms(meta)
    if terms is None:
        return {"count": 0, "files": 0}
    if prefix is not None:
        run = terms.where(F.col("term").startswith(prefix))
        if run.limit(PREFIX_TERMS + 1).count() > PREFIX_TERMS:
            raise CountRefused("prefix_terms", "too many terms start so")
        n = run.agg(F.sum("total_count")).first()[0] or 0
        return {"count": n, "files": run.select(F.explode("ordinals")).distinct().count()}
    # One term stands in one leaf.
    leaf = meta["leaves"]["ranges"].get(str(_range(asked[0])))
    if leaf is None:
        return {"count": 0, "files": 0}
    row = table.spark.read.schema(D.TERM_LEAF).parquet(leaf).where(F.col("term") == asked[0]).select("total_count", "file_count").first()
    return {"count": row[0], "files": row[1]} if row else {"count": 0, "files": 0}


def hunt(table: Table, column: str, terms: list[str], any_of: bool = True) -> list[dict]:
    """Every live file as hit, miss or unresolved, from the index alone."""
    files = table.files()
    paths = [f["path"] for f in files]
    try:
        index = Index(table, column)
        meta = index.meta()
    except KeyError:
        meta = None
    if not meta or not meta["tiers"][2]:
        return [{"path": p, "status": "unresolved"} for p in paths]
    tiers = _Tiers(index, meta, files)
    out = None
    for t in terms:
        verdict = tiers.holding(t)
        out = verdict if out is None else out.either(verdict) if any_of else out.both(verdict)
    out = out or tiers.unknown()
    return [{"path": p, "status": "hit" if p in out.hits else "miss" if p in out.absent else "unresolved"} for p in paths]


def hunt_lines(results: list[dict]) -> list[str]:
    """JSON lines: a summary, then each hit and each unresolved file; misses are counted alone."""
    import json
    from collections import Counter

    n = Counter(r["status"] for r in results)
    return [json.dumps({"type": "summary", "hit": n["hit"], "miss": n["miss"], "unresolved": n["unresolved"]})] + [json.dumps({"type": "file", **r}) for r in results if r["status"] != "miss"]
