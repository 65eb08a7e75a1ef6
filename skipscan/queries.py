"""Registered queries of the engine's operators, each with DuckDB's SQL for the same rows.

A logical segment (doc_id div 50, event_id div 500, ...) stands for a data file, so
that what an index says of files can be said in SQL too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipscan.functions import kinds, text
from skipscan.operators import dictionary as D
from skipscan.rules import compile as C
from skipscan.rules.model import rule_of
from skipscan.streaming import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def read(s, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def docs(s, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", (F.col("doc_id") / 50).cast("long").alias("seg"), "text")


def events(s, d: str) -> DataFrame:
    return read(s, d, "events").withColumn("seg", (F.col("event_id") / 500).cast("long"))


STRING = T.StringType()
LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PIECES = f"regexp_extract_all({LOW}, '[a-z0-9]+')"
RUNS = f"list_transform(regexp_extract_all({LOW}, '[a-z0-9.:_-]+'), lambda r: trim(r, '.:_-'))"
IS_COMPOUND = r"(regexp_full_match(r, '[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9a-f]+([-_][0-9a-f]+)+') OR (regexp_full_match(r, '[0-9a-f:]+') AND length(r) - length(replace(r, ':', '')) BETWEEN 2 AND 7 AND NOT contains(r, ':::') AND length(r) - length(replace(r, '::', '')) <= 2 AND regexp_matches(r, '[0-9]') AND NOT regexp_matches(r, '[0-9a-f]{5}')))"
TOKENS = f"list_filter(list_concat({PIECES}, list_filter({RUNS}, lambda r: {IS_COMPOUND})), lambda t: length(t) <= 256)"
SEG = "doc_id // 50"
DICT = f"(SELECT {SEG} AS seg, unnest({TOKENS}) AS term FROM documents)"
WINDOWS = "list_concat(regexp_extract_all(c, '(?s).{3}'), regexp_extract_all(c[2:], '(?s).{3}'), regexp_extract_all(c[3:], '(?s).{3}'))"
GRAM_PAIRS = f"(SELECT DISTINCT seg, unnest(CASE WHEN length(c) < 3 THEN [c] ELSE {WINDOWS} END) AS gram FROM (SELECT {SEG} AS seg, lower(text) AS c FROM documents))"
SEGS = f"(SELECT DISTINCT {SEG} AS seg FROM documents)"


def doc_counts(s, d: str) -> DataFrame:
    return D.term_counts(docs(s, d), "seg", D.terms_per_row(F.col("text"), STRING, "tokens"))


def doc_grams(s, d: str) -> DataFrame:
    return D.file_grams(docs(s, d), "seg", F.col("text"), STRING)


def segs(df: DataFrame) -> DataFrame:
    return df.select("seg").distinct()


# -- text analysis ---------------------------------------------------------------


@query("tokens_count", f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_distinct({TOKENS}))::BIGINT AS n_terms FROM documents")
def tokens_count(s, d):
    t = docs(s, d).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("compound_tokens", f"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter({RUNS}, lambda r: {IS_COMPOUND})) AS term FROM documents) GROUP BY term")
def compound_tokens(s, d):
    return docs(s, d).select(F.explode(text.compounds(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


SHORT_PIECES = f"list_filter({PIECES}, lambda t: length(t) <= 256 AND NOT regexp_full_match(t, '[0-9]{{5,}}'))"


@query("short_piece_terms", f"SELECT term, count(DISTINCT seg) AS file_count, count(*) AS total_count FROM (SELECT {SEG} AS seg, unnest({SHORT_PIECES}) AS term FROM documents) GROUP BY term")
def short_piece_terms(s, d):
    counts = D.term_counts(docs(s, d), "seg", D.terms_per_row(F.col("text"), STRING, "short-pieces"))
    return D.term_dictionary(counts, "seg").select("term", "file_count", "total_count")


@query("grams_distinct", f"SELECT seg, count(*) AS n_grams FROM {GRAM_PAIRS} GROUP BY seg")
def grams_distinct(s, d):
    return doc_grams(s, d).groupBy("seg").agg(F.count("*").alias("n_grams"))


@query("query_terms")
def query_terms(s, d):
    asked = ["User Login", "10.0.0.1 timeout", "fe80::1", "dead-beef_01 x", "a.b:c"]
    return s.createDataFrame([(q, text.query_terms(q)) for q in asked], "query string, terms array<string>")


@query("canonical_int", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS canon FROM orders")
def canonical_int(s, d):
    return read(s, d, "orders").select("o_orderkey", kinds.canonical(F.col("o_custkey"), kinds.INTEGRAL).alias("canon"))


@query("canonical_decimal", r"SELECT o_orderkey, regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '\.?0+$', '') AS canon FROM orders")
def canonical_decimal(s, d):
    return read(s, d, "orders").select("o_orderkey", kinds.canonical(F.col("o_totalprice").cast("decimal(18,2)"), kinds.DECIMAL).alias("canon"))


@query("canonical_binary", "SELECT c_custkey, lower(hex(encode(c_name))) AS canon FROM customer")
def canonical_binary(s, d):
    return read(s, d, "customer").select("c_custkey", kinds.canonical(F.col("c_name").cast("binary"), kinds.BINARY).alias("canon"))


# -- index tiers -----------------------------------------------------------------


@query("term_dictionary", f"SELECT term, count(DISTINCT seg) AS file_count, count(*) AS total_count, array_to_string(list_sort(list_distinct(list(seg))), ',') AS ordinals FROM {DICT} GROUP BY term")
def term_dictionary(s, d):
    return D.term_dictionary(doc_counts(s, d), "seg").drop("counts").withColumn("ordinals", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ","))


@query("gram_dictionary", f"SELECT gram, array_to_string(list_sort(list(seg)), ',') AS ordinals FROM {GRAM_PAIRS} GROUP BY gram")
def gram_dictionary(s, d):
    return D.gram_dictionary(doc_grams(s, d), "seg").withColumn("ordinals", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ","))


@query("value_dictionary", "SELECT p_brand AS term, count(DISTINCT p_partkey // 100) AS file_count, count(*) AS total_count FROM part GROUP BY 1")
def value_dictionary(s, d):
    p = read(s, d, "part").select((F.col("p_partkey") / 100).cast("long").alias("seg"), "p_brand")
    return D.term_dictionary(D.term_counts(p, "seg", D.terms_per_row(F.col("p_brand"), STRING, "value")), "seg").drop("ordinals", "counts")


@query("list_terms", f"SELECT term, count(*) AS total_count FROM (SELECT unnest(list_distinct(list_filter({PIECES}, lambda t: length(t) <= 256))) AS term FROM documents) GROUP BY term")
def list_terms(s, d):
    rows = docs(s, d).select("seg", text.pieces(F.col("text")).alias("v"))
    return D.term_dictionary(D.term_counts(rows, "seg", D.terms_per_row(F.col("v"), T.ArrayType(STRING), "value")), "seg").select("term", "total_count")


@query("range_leaf_sizes", f"SELECT CASE WHEN term[1] < '0' THEN 0 WHEN term[1] > 'z' THEN 35 WHEN term[1] <= '9' THEN ord(term[1]) - 48 WHEN term[1] < 'a' THEN 9 ELSE ord(term[1]) - 87 END::INTEGER AS leaf, count(*) AS terms FROM (SELECT DISTINCT term FROM {DICT}) GROUP BY 1")
def range_leaf_sizes(s, d):
    return doc_counts(s, d).select("term").distinct().groupBy(D.range_of(F.col("term")).alias("leaf")).agg(F.count("*").alias("terms"))


@query("dictionary_merge", f"SELECT term, count(DISTINCT seg) AS file_count, count(*) AS total_count FROM {DICT} GROUP BY term")
def dictionary_merge(s, d):
    c = doc_counts(s, d)
    return D.merged(D.term_dictionary(c.where("seg % 2 = 0"), "seg"), D.term_dictionary(c.where("seg % 2 = 1"), "seg")).drop("ordinals", "counts")


@query("gram_saturation", f"SELECT seg, count(DISTINCT gram) AS grams, count(DISTINCT c) AS signs FROM (SELECT seg, gram, unnest(string_split(gram, '')) AS c FROM {GRAM_PAIRS}) GROUP BY seg")
def gram_saturation(s, d):
    return D.gram_saturation(doc_grams(s, d), "seg").select("seg", "grams", "signs")


@query("bloom_might_contain")
def bloom_might_contain(s, d):
    return D.bloom_might(D.bloom_words(doc_grams(s, d), "seg"), "seg", text.grams_of("license"))


# -- plans -----------------------------------------------------------------------


def plan_sql(named: str, covered: str = "true") -> str:
    return f"SELECT seg, CASE WHEN NOT ({covered}) THEN 'unknown' WHEN seg IN ({named}) THEN 'hit' ELSE 'absent' END AS verdict FROM {SEGS}"


def having_grams(*grams: str) -> str:
    return " INTERSECT ".join(f"SELECT seg FROM {GRAM_PAIRS} WHERE gram = '{g}'" for g in grams)


def having_terms(*terms: str) -> str:
    return " INTERSECT ".join(f"SELECT seg FROM {DICT} WHERE term = '{t}'" for t in terms)


# -- rules -----------------------------------------------------------------------


def rule_query(name: str, doc: dict, sql: str) -> None:
    """Rows of events per segment that a rule finds, with its first positions."""
    rule = rule_of({"id": name, "table": "events"} | doc)
    least = rule.min_count

    @query(name, f"SELECT seg, count(*) AS matched_rows, array_to_string(list_sort(list(event_id))[1:5], ',') AS first_positions FROM (SELECT event_id // 500 AS seg, * FROM events) WHERE {sql} GROUP BY seg HAVING count(*) >= {least}")
    def run(s, d):
        e = events(s, d)
        out = C.evaluate(e, [rule], "seg", "event_id")
        return out.select("seg", "matched_rows", F.array_join(F.transform("first_positions", lambda x: x.cast("string")), ",").alias("first_positions"))


rule_query("rule_match", {"column": "event_type", "match": "click"}, "list_contains(regexp_extract_all(lower(event_type), '[a-z0-9]+'), 'click')")
rule_query("rule_contains", {"column": "event_type", "contains": "lic"}, "contains(lower(event_type), 'lic')")
rule_query("rule_equals", {"where": {"column": "user_id", "equals": 7}}, "user_id = 7")
rule_query("rule_equals_ignore_case", {"where": {"column": "event_type", "equals_ignore_case": "CLICK"}}, "lower(event_type) = 'click'")
rule_query("rule_starts_with", {"where": {"column": "event_type", "starts_with": "P"}}, "starts_with(lower(event_type), 'p')")
rule_query("rule_ends_with", {"where": {"column": "event_type", "ends_with": "R"}}, "ends_with(lower(event_type), 'r')")
rule_query("rule_re", {"where": {"column": "props", "re": '"k": [0-9]{2}\\}'}}, "regexp_matches(props, '\"k\": [0-9]{2}\\}')")
rule_query("rule_gt", {"where": {"column": "user_id", "gt": 100}}, "user_id > 100")
rule_query("rule_gte", {"where": {"column": "user_id", "gte": 100}}, "user_id >= 100")
rule_query("rule_lt", {"where": {"column": "user_id", "lt": 10}}, "user_id < 10")
rule_query("rule_lte", {"where": {"column": "user_id", "lte": 10}}, "user_id <= 10")
rule_query("rule_all_of", {"where": [{"column": "event_type", "equals": "click"}, {"column": "user_id", "lt": 50}], "condition": "all-of"}, "event_type = 'click' AND user_id < 50")
rule_query("rule_detection_not_null", {"detection": {"a": {"column": "event_type", "equals": "click"}, "b": {"column": "props", "contains": "999"}, "condition": "a and not b"}}, "event_type = 'click' AND NOT coalesce(contains(lower(props), '999'), false)")
rule_query("rule_quantifiers", {"detection": {"x1": {"column": "event_type", "equals": "click"}, "x2": {"column": "user_id", "lt": 20}, "y": {"column": "user_id", "gte": 5}, "condition": "1 of x* and all of y*"}}, "(event_type = 'click' OR user_id < 20) AND user_id >= 5")
rule_query("rule_min_count", {"where": {"column": "event_type", "equals": "error"}, "min_count": 80}, "event_type = 'error'")


@query("rule_container_any", f"SELECT seg, count(*) AS matched_rows FROM (SELECT {SEG} AS seg, {PIECES} AS v FROM documents) WHERE list_contains(v, 'the') GROUP BY seg")
def rule_container_any(s, d):
    rows = docs(s, d).select("seg", "doc_id", text.pieces(F.col("text")).alias("v"))
    rule = rule_of({"id": "r", "table": "t", "where": {"column": "v", "equals": "the"}})
    return C.evaluate(rows, [rule], "seg", "doc_id").select("seg", "matched_rows")


# -- windows ---------------------------------------------------------------------

HOURS6 = 6 * 3_600_000
ERRORS = "SELECT coalesce(CAST(user_id AS VARCHAR), '') AS key, epoch_us(ts) // 1000 AS ms, event_id FROM events WHERE event_type = 'error'"


def errors(s, d):
    e = events(s, d)
    rule = rule_of({"id": "e", "table": "events", "where": {"column": "event_type", "equals": "error"}})
    return e.where(C.rule_column(rule, e.schema)).select(W.key_of(["user_id"]).alias("key"), W.epoch_ms("ts", e.schema).alias("ms"))


@query("window_lag_candidates", f"SELECT key, ms, first_ts FROM (SELECT key, ms, lag(ms, 2) OVER (PARTITION BY key ORDER BY ms) AS first_ts FROM ({ERRORS})) WHERE ms - first_ts <= {HOURS6}")
def window_lag_candidates(s, d):
    return W.candidates(errors(s, d), "key", "ms", 3, HOURS6)


@query(
    "window_trips",
    f"""WITH RECURSIVE e AS (SELECT key, ms, row_number() OVER (PARTITION BY key ORDER BY ms) AS i FROM ({ERRORS})),
r(key, i, ring, trip) AS (SELECT key, 0, []::BIGINT[], NULL::BIGINT[] FROM (SELECT DISTINCT key FROM e) UNION ALL
SELECT key, i, CASE WHEN len(g) = 3 AND g[3] - g[1] <= {HOURS6} THEN []::BIGINT[] ELSE g END, CASE WHEN len(g) = 3 AND g[3] - g[1] <= {HOURS6} THEN g END
FROM (SELECT r.key, e.i, list_append(r.ring, e.ms)[-3:] AS g FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1))
SELECT key, trip[1] AS start_ts, trip[3] AS end_ts FROM r WHERE trip IS NOT NULL""",
)
def window_trips(s, d):
    return W.trips(errors(s, d), "key", "ms", 3, HOURS6)


@query("window_grouped_confirm", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 5")
def window_grouped_confirm(s, d):
    rule = rule_of({"id": "w", "table": "events", "where": {"column": "event_type", "equals": "error"}, "window": {"ts_column": "ts", "timeframe": "6h", "count": 5, "group_by": "user_id"}})
    e = read(s, d, "events")
    e.createOrReplaceTempView("skipscan_events")
    return s.sql(C.confirmation_sql(rule, e.schema, "skipscan_events"))


# -- workloads -------------------------------------------------------------------


def workload(name: str, spark_sql: str, sql: str | None = None) -> None:
    @query(name, sql or spark_sql)
    def run(s, d):
        out = spark_sql
        for t in ("lineitem", "orders", "events", "documents", "customer", "part", "pages"):
            if t in spark_sql:
                view = f"skipscan_w_{t}"
                read(s, d, t).createOrReplaceTempView(view)
                out = out.replace(f"FROM {t}", f"FROM {view}")
        return s.sql(out)


workload("w_count", "SELECT count(*) AS n FROM lineitem")
workload("w_aggregates", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi, count(DISTINCT l_suppkey) AS d FROM lineitem")
workload("w_topk", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
workload("w_histogram", "SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1")
workload("w_extract", "SELECT extract(minute FROM ts) AS m, count(*) AS n FROM events GROUP BY 1", "SELECT extract(minute FROM ts)::INTEGER AS m, count(*) AS n FROM events GROUP BY 1")
workload("w_point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
workload("w_like", "SELECT count(*) AS n FROM documents WHERE text LIKE '%License%' AND text NOT LIKE '%Apache%'")
workload("w_having", "SELECT lang, CAST(floor(avg(length(text))) AS BIGINT) AS l, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 10")
workload("w_regexp_replace", r"SELECT regexp_replace(url, '^https?://([^/]+)/.*$', '$1') AS host, count(*) AS n FROM pages GROUP BY 1", r"SELECT regexp_replace(url, '^https?://([^/]+)/.*$', '\1') AS host, count(*) AS n FROM pages GROUP BY 1")
workload("w_wide_sum", "SELECT " + ", ".join(f"CAST(sum(l_linenumber + {k}) AS BIGINT) AS s{k}" for k in range(90)) + " FROM lineitem")
workload("w_case", "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END AS p, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01' GROUP BY 1", "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END AS p, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
workload("w_offset", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10 OFFSET 20")
workload("w_order_limit", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 10")
workload("w_terms_enum", "SELECT DISTINCT c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
workload("w_token_regexp", "SELECT count(*) AS n FROM documents WHERE lower(text) RLIKE '(^|[^a-z0-9])apache([^a-z0-9]|$)'", "SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])apache([^a-z0-9]|$)')")


from skipscan import queries_lake  # noqa: E402  (it registers queries here)


def indexed_scan(spark, sf_dir: str) -> DataFrame:
    """The flagship: documents with a phrase, through a table and its index."""
    return queries_lake.scan_contains_rows(spark, sf_dir)
