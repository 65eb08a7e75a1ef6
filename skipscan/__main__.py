"""python -m skipscan index|status|hunt|count TABLE COLUMN [...]: one JSON document (hunt: JSON lines) on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from skipscan.functions import text
from skipscan.operators import count as C
from skipscan.operators.build import BuildRefused, Index, Settings
from skipscan.sources.table import Table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skipscan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "status", "hunt", "count"):
        c = sub.add_parser(name)
        c.add_argument("table")
        c.add_argument("column")
        if name == "index":
            c.add_argument("--analyzer", choices=text.ANALYZERS, default="tokens")
            c.add_argument("--per-pass", type=int)
            for tier in ("bloom", "grams", "terms"):
                c.add_argument(f"--no-{tier}", action="store_true")
        elif name == "hunt":
            c.add_argument("terms", nargs="+")
            c.add_argument("--all", action="store_true", help="files that hold all terms, and not any")
        elif name == "count":
            c.add_argument("--term")
            c.add_argument("--prefix")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("skipscan").getOrCreate()
    table = Table(spark, a.table)
    try:
        if a.command == "index":
            settings = Settings(analyzer=a.analyzer, bloom=not a.no_bloom, grams=not a.no_grams, terms=not a.no_terms)
            print(json.dumps(Index(table, a.column).build(settings, per_pass=a.per_pass)))
        elif a.command == "status":
            print(json.dumps(Index(table, a.column).status()))
        elif a.command == "hunt":
            print("\n".join(C.hunt_lines(C.hunt(table, a.column, a.terms, any_of=not a.all))))
        else:
            print(json.dumps(C.count(table, a.column, a.term, a.prefix)))
    except (BuildRefused, C.CountRefused, KeyError, ValueError) as e:
        print(f"skipscan: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
