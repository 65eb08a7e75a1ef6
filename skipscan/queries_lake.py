"""Registered queries that go through tables, indexes, plans, counts, hunts and the watcher."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan import lake
from skipscan.functions import text
from skipscan.operators import count as C
from skipscan.operators import dictionary as D
from skipscan.operators.build import Index
from skipscan.plans import predicate as P
from skipscan.plans import scan as S
from skipscan.plans.scan import _Tiers
from skipscan.queries import DICT, ERRORS, GRAM_PAIRS, HOURS6, SEG, SEGS, TOKENS, having_grams, having_terms, plan_sql, query
from skipscan.rules import compile as RC
from skipscan.rules import sigma
from skipscan.rules.model import load, rule_of
from skipscan.sources import pushdown
from skipscan.streaming import watch


def rows(s, data, schema: str) -> DataFrame:
    return s.createDataFrame(list(data), schema)


def verdicts(s, table, p: P.Node) -> DataFrame:
    """seg, verdict of each file, as the plan of p gives them."""
    _, report = S.plan(table, p)
    return rows(s, ((lake.seg_of(f), v) for f, v in report.verdicts.items()), "seg long, verdict string")


def tiers(table, column: str) -> _Tiers:
    index = Index(table, column)
    return _Tiers(index, index.meta(), table.files())


def segs_of(t: _Tiers) -> dict[int, int]:
    return {o: lake.seg_of(p) for p, o in t.ordinal.items()}


# -- plans -----------------------------------------------------------------------


def document_plan(name: str, p: P.Node, sql: str) -> None:
    query(name, sql)(lambda s, d: verdicts(s, lake.documents(s, d), p))


document_plan("plan_contains", P.contains("text", "MIT lic"), plan_sql(having_grams("mit", "it ", "t l", " li", "lic")))
document_plan("plan_match_single", P.match("text", "Apache"), plan_sql(having_terms("apache")))
document_plan("plan_match_multi", P.match("text", "General Public License"), plan_sql(having_terms("general", "public", "license")))
document_plan("plan_match_prefix", P.match_prefix("text", "licen"), plan_sql(f"SELECT seg FROM {DICT} WHERE starts_with(term, 'licen')"))
document_plan("plan_conjunction", P.match("text", "license") & P.contains("text", "mit "), plan_sql(f"({having_terms('license')}) INTERSECT ({having_grams('mit', 'it ')})"))
document_plan("plan_or_not_pruned", P.eq("text", "x") | ~P.eq("text", "y"), f"SELECT seg, 'unknown' AS verdict FROM {SEGS}")
document_plan("plan_short_literal_kept", P.contains("text", "ti"), f"SELECT seg, 'unknown' AS verdict FROM {SEGS}")
document_plan("plan_absent_literal", P.contains("text", "qqqzzzq") & P.gte("doc_id", 0), f"SELECT seg, CASE WHEN seg IN ({having_grams('qqq', 'qqz', 'qzz', 'zzz', 'zzq')}) THEN 'unknown' ELSE 'absent' END AS verdict FROM {SEGS}")


@query("plan_uncovered_kept", plan_sql(having_terms("apache"), "seg % 3 <> 0"))
def plan_uncovered_kept(s, d):
    return verdicts(s, lake.late(s, d), P.match("text", "apache"))


def value_plan(name: str, p: P.Node, sql: str) -> None:
    @query(name, f"SELECT seg, bool_or({sql}) AS kept FROM (SELECT p_partkey // 100 AS seg, p_brand FROM part) GROUP BY seg")
    def run(s, d):
        table = lake.parts(s, d)
        kept = {f["path"] for f in S.plan(table, p)[0]}
        return rows(s, ((lake.seg_of(f["path"]), f["path"] in kept) for f in table.files()), "seg long, kept boolean")


value_plan("plan_eq", P.eq("p_brand", "Brand#13"), "p_brand = 'Brand#13'")
value_plan("plan_in", P.in_("p_brand", ["Brand#11", "Brand#55"]), "p_brand IN ('Brand#11', 'Brand#55')")
value_plan("plan_starts_with", P.starts_with("p_brand", "Brand#1"), "starts_with(p_brand, 'Brand#1')")
value_plan("plan_range", P.gt("p_brand", "Brand#22") & P.lte("p_brand", "Brand#24"), "p_brand > 'Brand#22' AND p_brand <= 'Brand#24'")
value_plan("plan_range_tightened", P.gt("p_brand", "Brand#10") & P.gte("p_brand", "Brand#33") & P.lt("p_brand", "Brand#35") & P.lte("p_brand", "Brand#99"), "p_brand >= 'Brand#33' AND p_brand < 'Brand#35'")


@query("plan_minmax", "SELECT l_orderkey // 1000 AS seg, max(l_shipdate) >= TIMESTAMP '1998-06-01' AS kept FROM lineitem GROUP BY 1")
def plan_minmax(s, d):
    table = lake.lineitem(s, d)
    kept = {f["path"] for f in S.plan(table, P.gte("l_shipdate", "1998-06-01 00:00:00"))[0]}
    return rows(s, ((lake.seg_of(f["path"]), f["path"] in kept) for f in table.files()), "seg long, kept boolean")


@query("plan_partition", "SELECT event_type, event_type IN ('click', 'error') AS kept, count(*) AS n FROM events GROUP BY 1")
def plan_partition(s, d):
    table = lake.by_type(s, d)
    kept = {f["path"] for f in S.plan(table, P.in_("event_type", ["click", "error"]))[0]}
    found = rows(s, ((f["partition"]["event_type"], f["path"] in kept, f["rows"]) for f in table.files()), "event_type string, kept boolean, n long")
    return found.groupBy("event_type", "kept").agg(F.sum("n").alias("n"))


# -- reads -----------------------------------------------------------------------


@query("scan_contains_rows", "SELECT doc_id FROM documents WHERE contains(lower(text), 'mit license')")
def scan_contains_rows(s, d):
    return S.scan(lake.documents(s, d), P.contains("text", "MIT License"))[0].select("doc_id")


@query("scan_match_rows", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'license') AND list_contains({TOKENS}, 'mit')")
def scan_match_rows(s, d):
    return S.scan(lake.documents(s, d), P.match("text", "MIT License"))[0].select("doc_id")


@query("scan_uncovered_rows", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'apache')")
def scan_uncovered_rows(s, d):
    return S.scan(lake.late(s, d), P.match("text", "apache"))[0].select("doc_id")


@query("scan_sql_hints", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'license') AND contains(lower(text), 'mit') AND lang IN ('en', 'de') AND doc_id BETWEEN 10 AND 900")
def scan_sql_hints(s, d):
    return S.scan_sql(lake.documents(s, d), "skipscan.match(text, 'License') = true AND skipscan.contains(text, 'MIT') AND lang IN ('en', 'de') AND doc_id BETWEEN 10 AND 900")[0].select("doc_id")


@query("scan_sql_prefix", f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda t: starts_with(t, 'licen'))) > 0 AND (lang = 'en' OR doc_id < 100) AND NOT lang = 'fr'")
def scan_sql_prefix(s, d):
    return S.scan_sql(lake.documents(s, d), "skipscan.match_prefix(text, 'Licen') AND (lang = 'en' OR doc_id < 100) AND NOT lang = 'fr'")[0].select("doc_id")


@query("scan_sql_like", "SELECT doc_id FROM documents WHERE text LIKE '%MIT License%' AND NOT text LIKE '%Apache%'")
def scan_sql_like(s, d):
    return S.scan_sql(lake.documents(s, d), "text LIKE '%MIT License%' AND NOT text LIKE '%Apache%'")[0].select("doc_id")


@query("scan_token_regexp", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])apache([^a-z0-9]|$)')")
def scan_token_regexp(s, d):
    return S.scan_sql(lake.documents(s, d), "lower(text) RLIKE '(^|[^a-z0-9])apache([^a-z0-9]|$)'")[0].select("doc_id")


@query("scan_point_lookup", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_name = 'Customer#000000077'")
def scan_point_lookup(s, d):
    return S.scan(lake.customers(s, d), P.eq("c_name", "Customer#000000077"))[0].select("c_custkey", "c_mktsegment")


@query("pushdown_like", "SELECT doc_id, lang FROM documents WHERE text LIKE '%MIT License%'")
def pushdown_like(s, d):
    pushdown.register(s)
    return s.read.format("skipscan").option("path", lake.documents(s, d).path).load().where("text LIKE '%MIT License%'").select("doc_id", "lang")


@query("pushdown_values", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#55')")
def pushdown_values(s, d):
    pushdown.register(s)
    return s.read.format("skipscan").option("path", lake.parts(s, d).path).load().where("p_brand IN ('Brand#11', 'Brand#55')").select("p_partkey")


SNAPSHOT = f"1 + (event_id // 500) * {lake.STEPS} // (SELECT max(event_id) // 500 + 1 FROM events)"


@query("incremental_scan", f"SELECT event_id, event_type FROM events WHERE {SNAPSHOT} > 3 AND {SNAPSHOT} <= 7")
def incremental_scan(s, d):
    table = lake.events(s, d)
    return table.frame(table.added_between(3, 7)).select("event_id", "event_type")


@query("time_travel_scan", f"SELECT event_type, count(*) AS n FROM events WHERE {SNAPSHOT} <= 5 GROUP BY 1")
def time_travel_scan(s, d):
    return S.scan(lake.events(s, d), None, at=5)[0].groupBy("event_type").agg(F.count("*").alias("n"))


@query("files_at_snapshot", f"SELECT event_id // 500 AS seg, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events WHERE {SNAPSHOT} <= 4 GROUP BY 1")
def files_at_snapshot(s, d):
    return rows(s, ((lake.seg_of(f["path"]), f["rows"], *map(int, f["bounds"]["event_id"])) for f in lake.events(s, d).files(at=4)), "seg long, n long, lo long, hi long")


@query("files_added_since", f"SELECT DISTINCT event_id // 500 AS seg FROM events WHERE {SNAPSHOT} > 8")
def files_added_since(s, d):
    return rows(s, ((lake.seg_of(f["path"]),) for f in lake.events(s, d).added_since(8)), "seg long")


@query("files_within_horizon", f"SELECT DISTINCT event_id // 500 AS seg FROM events WHERE {SNAPSHOT} BETWEEN 6 AND 9")
def files_within_horizon(s, d):
    table = lake.events(s, d)
    snaps = table.snapshots()
    found = table.added_within(snaps[-1].ts_ms - snaps[5].ts_ms, snaps[-1].ts_ms, [f["path"] for f in snaps[-1].added])
    return rows(s, ((lake.seg_of(f["path"]),) for f in found), "seg long")


@query("files_by_lower_bound", "SELECT seg, row_number() OVER (ORDER BY lo NULLS LAST, seg) AS place FROM (SELECT event_id // 500 AS seg, min(ts) AS lo FROM events GROUP BY 1)")
def files_by_lower_bound(s, d):
    table = lake.events(s, d)
    return rows(s, ((lake.seg_of(f["path"]), i) for i, f in enumerate(table.by_lower_bound("ts", table.files()), 1)), "seg long, place long")


# -- leaves ----------------------------------------------------------------------


@query("leaf_point_read", f"SELECT DISTINCT term, seg FROM {DICT} WHERE term IN ('license', 'mit', 'apache', 'qqqq')")
def leaf_point_read(s, d):
    t = tiers(lake.documents(s, d), "text")
    at = segs_of(t)
    return rows(s, ((k, at[o]) for k, found in t.postings(["license", "mit", "apache", "qqqq"]).items() for o in found), "term string, seg long")


@query("leaf_prefix_read", f"SELECT DISTINCT seg FROM {DICT} WHERE starts_with(term, 'soft')")
def leaf_prefix_read(s, d):
    t = tiers(lake.documents(s, d), "text")
    at = segs_of(t)
    return rows(s, ((at[o],) for o in t.span(lambda c: c.startswith("soft"))), "seg long")


@query("leaf_term_counts", f"SELECT seg, count(*) AS n FROM {DICT} WHERE term IN ('license', 'software') GROUP BY seg")
def leaf_term_counts(s, d):
    t = tiers(lake.documents(s, d), "text")
    at = segs_of(t)
    return rows(s, ((at[o], n) for o, n in t.counts(["license", "software"]).items()), "seg long, n long")


@query("leaf_terms", f"SELECT term, count(DISTINCT seg) AS file_count, count(*) AS total_count FROM {DICT} GROUP BY term")
def leaf_terms(s, d):
    return Index(lake.documents(s, d), "text").terms().select("term", "file_count", "total_count")


@query("leaf_grams", f"SELECT gram, count(*) AS files FROM {GRAM_PAIRS} GROUP BY gram")
def leaf_grams(s, d):
    meta = Index(lake.documents(s, d), "text").meta()
    return s.read.parquet(*meta["leaves"]["grams"]).select("gram", F.size("ordinals").cast("long").alias("files"))


@query("leaf_bloom_no_miss", f"{having_grams('mit', 'it ', 't l', ' li', 'lic')}")
def leaf_bloom_no_miss(s, d):
    """Files that have the grams, of those that their bloom filters let pass: none may be missing."""
    table = lake.blooms(s, d)
    kept = S.plan(table, P.contains("text", "MIT lic"))[0]
    sets = D.gram_sets(table.frame(kept).select(lake.seg("doc_id", 50).cast("int").alias("ordinal"), F.col("text").alias("v")), table.schema["text"].dataType)
    wanted = text.grams_of("MIT lic")
    own = sets.groupBy("ordinal").agg(F.sum(F.size(F.array_intersect("grams", F.array(*map(F.lit, wanted))))).alias("c"))
    return own.where(F.col("c") == len(wanted)).select(F.col("ordinal").cast("long").alias("seg"))


# -- counts and hunts ------------------------------------------------------------


def counted(name: str, sql: str, table, column: str, **asked) -> None:
    @query(name, sql)
    def run(s, d):
        found = C.count(table(s, d), column, **asked)
        return rows(s, [(found["count"], found["files"])], "n long, files long")


counted("count_term", f"SELECT count(*) AS n, count(DISTINCT seg) AS files FROM {DICT} WHERE term = 'the'", lake.documents, "text", term="The")
counted("count_prefix", f"SELECT count(*) AS n, count(DISTINCT seg) AS files FROM {DICT} WHERE starts_with(term, 'lic')", lake.documents, "text", prefix="Lic")
counted("count_absent", "SELECT 0::BIGINT AS n, 0::BIGINT AS files", lake.documents, "text", term="qqqqzzzz")
counted("count_value_rows", "SELECT count(*) AS n, count(DISTINCT c_custkey // 100) AS files FROM customer WHERE c_mktsegment = 'BUILDING'", lake.customers, "c_mktsegment", term="BUILDING")
counted("count_value_prefix", "SELECT count(*) AS n, count(DISTINCT c_custkey // 100) AS files FROM customer WHERE starts_with(c_name, 'Customer#00000001')", lake.customers, "c_name", prefix="Customer#00000001")

REFUSED = [
    ("both", "bad_request"), ("no column", "no_column"), ("no index", "no_index"), ("two terms", "terms"), ("no prefix", "prefix"), ("long", "not_indexable"), ("stale", "stale"), ("inexact", "inexact"),
]


@query("count_refusals", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in REFUSED) + ") AS v(asked, code)")
def count_refusals(s, d):
    docs = lake.documents(s, d)
    asked = {
        "both": (docs, "text", "a", "b"), "no column": (docs, "nope", "a", None), "no index": (docs, "lang", "a", None), "two terms": (docs, "text", "mit license", None), "no prefix": (docs, "text", None, "a b"),
        "long": (docs, "text", "x" * 300, None), "stale": (lake.late(s, d), "text", "the", None), "inexact": (lake.worn(s, d)[0], "p_brand", "Brand#13", None),
    }
    out = []
    for name, (table, column, term, prefix) in asked.items():
        try:
            out.append((name, str(C.count(table, column, term, prefix))))
        except C.CountRefused as e:
            out.append((name, e.code))
    return rows(s, out, "asked string, code string")


def hunted(s, found: list[dict]) -> DataFrame:
    return rows(s, ((lake.seg_of(x["path"]), x["status"]) for x in found), "seg long, status string")


def hunt_sql(named: str, covered: str = "true") -> str:
    return f"SELECT seg, CASE WHEN NOT ({covered}) THEN 'unresolved' WHEN seg IN ({named}) THEN 'hit' ELSE 'miss' END AS status FROM {SEGS}"


@query("hunt_term", hunt_sql(having_terms("token"), "seg % 3 <> 0"))
def hunt_term(s, d):
    return hunted(s, C.hunt(lake.late(s, d), "text", ["token"]))


@query("hunt_rule_anyof", hunt_sql(f"({having_terms('token')}) UNION ({having_terms('apache')})"))
def hunt_rule_anyof(s, d):
    return hunted(s, C.hunt(lake.documents(s, d), "text", ["token", "Apache"]))


@query("hunt_rule_allof", hunt_sql(having_terms("license", "mit")))
def hunt_rule_allof(s, d):
    return hunted(s, C.hunt(lake.documents(s, d), "text", ["license", "MIT"], any_of=False))


@query("hunt_lines", f"SELECT type, status, count(*) AS n FROM (SELECT 'file' AS type, status FROM ({hunt_sql(having_terms('token'), 'seg % 3 <> 0')}) WHERE status <> 'miss' UNION ALL SELECT 'summary', NULL) GROUP BY ALL")
def hunt_lines(s, d):
    lines = C.hunt_lines(C.hunt(lake.late(s, d), "text", ["token"]))
    parsed = rows(s, ((x,) for x in lines), "line string").select(F.from_json("line", "type string, status string").alias("x")).select("x.*")
    return parsed.groupBy("type", "status").agg(F.count("*").alias("n"))


# -- life of an index ------------------------------------------------------------

PART_SEGS = "(SELECT DISTINCT p_partkey // 100 AS seg FROM part)"


def coverage(s, d, step: str) -> list[dict]:
    return next(c for name, _, c in lake.worn(s, d)[1] if name == step)


@query("coverage_after_departure", f"SELECT seg, (row_number() OVER (ORDER BY seg::VARCHAR) - 1)::INTEGER AS ordinal, seg % 5 <> 0 AS live FROM {PART_SEGS}")
def coverage_after_departure(s, d):
    return rows(s, ((lake.seg_of(c["path"]), c["ordinal"], c["live"]) for c in coverage(s, d, "departed")), "seg long, ordinal int, live boolean")


@query("coverage_after_revival", f"SELECT seg, (row_number() OVER (ORDER BY seg::VARCHAR) - 1)::INTEGER AS ordinal, seg % 5 <> 0 OR seg % 10 = 0 AS live FROM {PART_SEGS}")
def coverage_after_revival(s, d):
    return rows(s, ((lake.seg_of(c["path"]), c["ordinal"], c["live"]) for c in coverage(s, d, "revived")), "seg long, ordinal int, live boolean")


@query("compaction_remap", f"SELECT seg, (row_number() OVER (ORDER BY seg::VARCHAR) - 1)::INTEGER AS ordinal FROM {PART_SEGS} WHERE seg % 5 <> 0")
def compaction_remap(s, d):
    return rows(s, ((lake.seg_of(c["path"]), c["ordinal"]) for c in coverage(s, d, "compacted")), "seg long, ordinal int")


@query("compacted_postings", "SELECT p_brand AS term, seg, count(*) AS n FROM (SELECT p_partkey // 100 AS seg, p_brand FROM part) WHERE seg % 5 <> 0 GROUP BY ALL")
def compacted_postings(s, d):
    at = rows(s, ((lake.seg_of(c["path"]), c["ordinal"]) for c in coverage(s, d, "compacted")), "seg long, ordinal int")
    terms = Index(lake.worn(s, d)[0], "p_brand").terms()
    each = terms.select("term", F.explode(F.arrays_zip("ordinals", "counts")).alias("x")).select("term", F.col("x.ordinals").alias("ordinal"), F.col("x.counts").alias("n"))
    return each.join(F.broadcast(at), "ordinal").select("term", "seg", "n")


@query(
    "build_reports",
    f"""WITH n AS (SELECT count(*) AS a, count(*) FILTER (seg % 5 = 0) AS f, count(*) FILTER (seg % 10 = 0) AS t FROM {PART_SEGS})
SELECT 'all' AS step, 'full' AS kind, a AS added, 0::BIGINT AS departed, 0::BIGINT AS revived FROM n UNION ALL SELECT 'departed', 'restamp', 0, f, 0 FROM n
UNION ALL SELECT 'revived', 'restamp', 0, 0, t FROM n UNION ALL SELECT 'compacted', 'compacting', 0, t, 0 FROM n""",
)
def build_reports(s, d):
    return rows(s, ((name, r["kind"], len(r["added"]), len(r["departed"]), len(r["revived"])) for name, r, _ in lake.worn(s, d)[1]), "step string, kind string, added long, departed long, revived long")


@query("build_passes", f"SELECT (row_number() OVER (ORDER BY seg::VARCHAR) - 1) // greatest(1, ceil((SELECT count(*) FROM {SEGS}) / 3)::BIGINT) AS pass, seg FROM {SEGS}")
def build_passes(s, d):
    return rows(s, ((i, lake.seg_of(p)) for i, r in enumerate(Index(lake.blooms(s, d), "text").reports()) for p in r["added"]), "pass long, seg long")


@query("index_behind", f"SELECT 'documents' AS name, true AS indexed, 0::BIGINT AS behind, true AS exact UNION ALL SELECT 'late', true, 1, true UNION ALL SELECT 'worn', true, 0, false")
def index_behind(s, d):
    states = {"documents": Index(lake.documents(s, d), "text"), "late": Index(lake.late(s, d), "text"), "worn": Index(lake.worn(s, d)[0], "p_brand")}
    told = {k: v.status() for k, v in states.items()}
    return rows(s, ((k, x["indexed"], x["behind_snapshots"], x["counts_exact"]) for k, x in told.items()), "name string, indexed boolean, behind long, exact boolean")


# -- rules and the watcher -------------------------------------------------------


@query("rule_min_count_index", f"SELECT s.seg, CASE WHEN n >= 2 THEN 'hit' ELSE 'miss' END AS status FROM {SEGS} s LEFT JOIN (SELECT seg, count(*) AS n FROM {DICT} WHERE term = 'license' GROUP BY seg) USING (seg)")
def rule_min_count_index(s, d):
    rule = rule_of({"id": "r", "table": "t", "column": "text", "match": "license", "min_count": 2})
    return hunted(s, watch.on_index(lake.documents(s, d), rule))


@query("rule_on_index_anyof", hunt_sql(f"({having_terms('token')}) UNION ({having_terms('apache')})"))
def rule_on_index_anyof(s, d):
    rule = rule_of({"id": "r", "table": "t", "where": [{"column": "text", "match": "token"}, {"column": "text", "match": "apache"}], "condition": "any-of"})
    return hunted(s, watch.on_index(lake.documents(s, d), rule))


MS = "(epoch_us(ts) // 1000)"


@query(
    "watch_row_alerts",
    f"""WITH b AS (SELECT min{MS} AS lo, max{MS} AS hi FROM events)
SELECT least((ms - lo) * {lake.WATCHED} // greatest(1, hi - lo), {lake.WATCHED - 1})::BIGINT AS seg, count(*) AS matched_rows FROM (SELECT *, {MS} AS ms FROM events), b WHERE event_type = 'error' AND user_id < 100 GROUP BY 1""",
)
def watch_row_alerts(s, d):
    found = [a for a in lake.watched(s, d) if a["rule"] == "row"]
    return rows(s, ((lake.seg_of(a["file"]), a["evidence"]["matched_rows"]) for a in found), "seg long, matched_rows long")


@query(
    "watch_window_alerts",
    f"""WITH RECURSIVE e AS (SELECT key, ms, row_number() OVER (PARTITION BY key ORDER BY ms) AS i FROM ({ERRORS})),
r(key, i, ring, trip) AS (SELECT key, 0, []::BIGINT[], NULL::BIGINT[] FROM (SELECT DISTINCT key FROM e) UNION ALL
SELECT key, i, CASE WHEN len(g) = 3 AND g[3] - g[1] <= {HOURS6} THEN []::BIGINT[] ELSE g END, CASE WHEN len(g) = 3 AND g[3] - g[1] <= {HOURS6} THEN g END
FROM (SELECT r.key, e.i, list_append(r.ring, e.ms)[-3:] AS g FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1))
SELECT DISTINCT key, trip[1] AS start_ts, trip[3] AS end_ts FROM r WHERE trip IS NOT NULL""",
)
def watch_window_alerts(s, d):
    """Trips whose events may have come in different polls."""
    found = [a["evidence"] for a in lake.watched(s, d) if a["rule"] == "window"]
    return rows(s, ((e["key"], e["start_ts"], e["end_ts"]) for e in found), "key string, start_ts long, end_ts long")


def sigma_query(name: str, detection: str, sql: str) -> None:
    @query(name, f"SELECT seg, count(*) AS matched_rows FROM (SELECT event_id // 500 AS seg, * FROM events) WHERE {sql} GROUP BY seg")
    def run(s, d):
        docs = sigma.convert(f"title: T\nname: n\nlogsource: {{category: web}}\ndetection: {detection}\n", sigma.Pipeline("events", "ts", category="web"))
        rules, skipped = load(sigma.to_yaml(docs))
        if skipped:
            raise ValueError(skipped)
        e = lake.read(s, d, "events").withColumn("seg", lake.seg("event_id", 500))
        return RC.evaluate(e, rules, "seg", "event_id").select("seg", "matched_rows")


sigma_query("sigma_string", "{s: {event_type: CLICK}, condition: s}", "lower(event_type) = 'click'")
sigma_query("sigma_modifiers", "{s: {event_type|contains: lic, user_id|lt: 50}, t: {props|endswith: '7}'}, condition: s and not t}", "contains(lower(event_type), 'lic') AND user_id < 50 AND NOT coalesce(ends_with(lower(props), '7}'), false)")
sigma_query("sigma_list_or", "{a: {event_type: [click, error]}, b: {user_id|gte: 400}, condition: a or b}", "lower(event_type) IN ('click', 'error') OR user_id >= 400")
sigma_query("sigma_regex", "{s: {props|re: '[0-9]{3}'}, condition: s}", "regexp_matches(props, '[0-9]{3}')")
