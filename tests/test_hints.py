"""Hints on rows: asked of the text itself, with the answers of its tokens."""

from pyspark.sql import functions as F

from skipscan.functions import text
from tests.test_blocks import ODD

MORE = ["License license2 xlicense", "LICENSE", "a LicenSe.", "lıcense Kelvin Kelvin kelvin", "élicense licenseé", "license\nmit", "Dead-Beef deadbeef", "y" * 256, "y" * 257, "z" * 255 + " " + "z" * 300, "mit", "10.0.0.1.", "x10.0.0.1", "0f-1e-"]


def test_hints_are_what_tokens_say(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ODD + MORE)], "id int, v string").cache()
    found = lambda p: sorted(r[0] for r in df.where(p).select("id").collect())
    starting = lambda a: lambda t: t.startswith(a)
    have = text.tokens(F.col("v"))
    for asked in ("License", "MIT license", "kelvin", "y" * 256, "y" * 257, "z" * 255, "10.0.0.1", "0F-1E", "dead", "e", "1", "dead-beef", "a b", "2001:db8::1", "é9"):
        want = F.lit(True)
        for t in text.query_terms(asked):
            want = want & F.array_contains(have, t)
        assert found(text.match(F.col("v"), asked)) == found(F.coalesce(want, F.lit(False))), asked
    for asked in ("Lic", "license", "k", "y", "y" * 256, "y" * 257, "z" * 100, "dead", "dead-", "10.", "10", "0F-", "2001:"):
        assert found(text.match_prefix(F.col("v"), asked)) == found(F.coalesce(F.exists(have, starting(asked.lower())), F.lit(False))), asked


def test_pieces_are_found_without_taking_a_text_apart(spark):
    df = spark.createDataFrame([("a",)], "v string")
    for p in (text.match(F.col("v"), "MIT License"), text.match_prefix(F.col("v"), "Licen")):
        assert "regexp_extract_all" not in df.where(p)._jdf.queryExecution().optimizedPlan().toString()
