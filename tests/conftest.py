import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("wh"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("cp"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame has the rows that DuckDB's SQL gives over named Parquet tables."""
    import duckdb

    def check(df, sql, tables):
        c = duckdb.connect()
        for name, path in tables.items():
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        want = c.sql(sql)
        columns = sorted(want.columns)
        assert sorted(df.columns) == columns
        key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
        assert key(df.select(*columns).collect()) == key(want.select(*[f'"{x}"' for x in columns]).fetchall())

    return check
