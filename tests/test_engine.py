import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipscan import queries
from skipscan.functions import kinds, text
from skipscan.operators import count as C
from skipscan.operators.build import BuildRefused, Index, Settings
from skipscan.plans import predicate as P
from skipscan.plans import scan as S
from skipscan.plans.verdicts import Partition
from skipscan.rules import compile as RC
from skipscan.rules import sigma
from skipscan.rules.model import RuleError, load, rule_of
from skipscan.sources import pushdown, store
from skipscan.sources.table import Table
from skipscan.streaming import watch as W
from skipscan.streaming.windows import push

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    t = Table.create(spark, str(tmp_path_factory.mktemp("t") / "logs"), T.StructType.fromDDL("id long, level string, msg string"))
    for i, w in enumerate(("connection timeout at 10.0.0.1", "disk full", "user login", "heartbeat ok")):
        t.append(spark.range(i * 100, i * 100 + 100).select("id", F.lit("INFO").alias("level"), F.concat(F.lit(w + " n"), F.col("id").cast("string")).alias("msg")), files=1)
    Index(t, "msg").build()
    return t


def test_plans_keep_the_right_files(logs):
    for p, files in ((None, 4), (P.gte("id", 300), 1), (P.contains("msg", "TIMEOUT"), 1), (P.contains("msg", "zzz-absent"), 0), (P.match("msg", "10.0.0.1"), 1), (P.match_prefix("msg", "heart"), 1), (P.contains("msg", "ti"), 4)):
        df, report = S.scan(logs, p)
        assert len(S.plan(logs, p)[0]) == files and report.total == 4
        full = logs.frame(logs.files())
        assert df.count() == (full.where(P.row_filter(p)) if p else full).count()


def test_hints_under_or_are_refused():
    with pytest.raises(P.BadPredicate):
        P.conjuncts(P.contains("a", "xyz") | P.eq("b", 1))
    assert P.token_regexp("c", "(^|[^a-z0-9])key([^a-z0-9]|$)") is None
    assert P.token_regexp("c", "(^|[^a-z0-9])abc([^a-z0-9]|$)").op == "match"


def test_counts_hunts_and_lifecycle(spark, logs, tmp_path):
    assert C.count(logs, "msg", "timeout") == {"count": 100, "files": 1}
    with pytest.raises(C.CountRefused, match="terms"):
        C.count(logs, "msg", "two words")
    t = Table.create(spark, str(tmp_path / "t"), T.StructType.fromDDL("msg string"))
    for w in ("alpha one", "beta two", "gamma three"):
        t.append(spark.createDataFrame([(w,)], "msg string"), files=1)
    index = Index(t, "msg")
    assert [r["kind"] for r in index.build(per_pass=2)] == ["full", "incremental"]
    t.append(spark.createDataFrame([("alpha four",), (None,)], "msg string"), files=1)
    assert [h["status"] for h in C.hunt(t, "msg", ["alpha"])].count("unresolved") == 1
    assert len(S.plan(t, P.match("msg", "alpha"))[0]) == 2  # the uncovered file stays
    with pytest.raises(C.CountRefused, match="stale"):
        C.count(t, "msg", "alpha")
    index.build()
    assert C.count(t, "msg", "alpha") == {"count": 2, "files": 2}
    t.remove([S.plan(t, P.match("msg", "beta"))[0][0]["path"]])
    assert [r["kind"] for r in index.build()] == ["restamp"]
    with pytest.raises(C.CountRefused, match="inexact"):
        C.count(t, "msg", "alpha")
    assert len(t.files(at=3)) == 3 and len(t.added_between(1, 3)) == 2


def test_value_index_and_ranges(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "v"), T.StructType.fromDDL("k string, tags array<string>"))
    for k in "abcd":
        t.append(spark.createDataFrame([(k, [k, "x " + k]), (None, None)], "k string, tags array<string>"), files=1)
    Index(t, "tags").build(Settings(analyzer="value"))
    assert C.count(t, "tags", "x a")["files"] == 1
    Index(t, "k").build(Settings(analyzer="value", grams=False, bloom=False))
    assert len(S.plan(t, P.in_("k", ["a", "d"]))[0]) == 2
    assert len(S.plan(t, P.gt("k", "a") & P.lte("k", "c"))[0]) == 2


def test_partitions():
    p = Partition.covered("abc", "ab", "a")
    assert (p.hits, p.absent, p.unknown) == (frozenset("a"), frozenset("b"), frozenset("c"))
    assert p.both(Partition.all_unknown("abc")).kept() == frozenset("ac")
    with pytest.raises(ValueError):
        Partition(frozenset("a"), frozenset("a"))


def test_text_on_driver_and_columns_agree(spark):
    said = ["User 10.0.0.1 fe80::1", "dead-beef_01 Straße ΟΔΟΣ", "", "a.b:c 🙂🙂🙂 x", "Key"]
    rows = spark.createDataFrame([(x,) for x in said], "v string").select("v", text.tokens(F.col("v")).alias("t"), text.grams(F.col("v")).alias("g")).collect()
    for r in rows:
        assert sorted(r.t) == sorted(text.tokens_of(r.v)) and sorted(r.g) == sorted(text.grams_of(r.v))
    assert text.query_terms("10.0.0.1 ok") == ["10.0.0.1", "ok"]
    assert kinds.canonical_literal(" 12 ", kinds.INTEGRAL) == "12" and kinds.canonical_literal("x", kinds.INTEGRAL) is None
    assert kinds.canonical_literal("12.50", kinds.DECIMAL) == "12.5" and kinds.canonical_literal("100", kinds.DECIMAL) == "100"


def test_rules(spark, logs):
    rules, skipped = load("rules:\n- {id: a, table: t, column: msg, match: timeout}\n- {id: b, table: t, where: {column: msg, equals: no}}\n- {id: c, table: t, where: [{column: level, equals: INFO}, {column: id, gte: 350}], condition: all-of}\n- {id: a, table: t, column: msg, match: x}\n")
    assert [r.id for r in rules] == ["a", "c"] and len(skipped) == 2
    sent = []
    w = W.Watcher(logs, rules, lambda x: sent.extend(x) or {})
    assert [a["rule"] for a in w.poll()] == ["c"] and w.poll() == [] and len(sent) == 1  # the current snapshot's own file first
    got = W.scan_files(logs, rules, logs.files())
    assert {(a["rule"], a["evidence"]["matched_rows"]) for a in got} == {("a", 100), ("c", 50)}
    sql = next(a for a in got if a["rule"] == "c")["confirmation_sql"]
    logs.frame(logs.files()).createOrReplaceTempView("logs_view")
    assert spark.sql(sql.split(" AND _metadata")[0].replace("{table}", "logs_view")).count() == 50
    assert [x["status"] for x in W.on_index(logs, rules[0])].count("hit") == 1
    with pytest.raises(RuleError):
        rule_of({"id": "x", "table": "t", "detection": {"a": {"column": "c", "equals": "v"}, "condition": "2 of them"}})
    assert RC.uncovered([rule_of({"id": "x", "table": "t", "column": "nope", "match": "v"})], logs.schema)


def test_windows():
    ring, out = [], []
    for t in (0, 5, 9, 9, 30, 8, 31, 32):
        ring, trip, late = push(ring, t, 3, 10)
        out += [trip] if trip else []
    assert out == [(0, 9), (30, 32)]
    assert push([5, 6, 7], 1, 3, 1)[2]


def test_sigma():
    p = sigma.Pipeline("logs", "ts", category="web")
    docs = sigma.convert("title: T\nname: n\nlogsource: {category: web}\ndetection: {s: {request|contains: abc, status: 5}, condition: s}\n---\ntitle: W\ncorrelation: {type: event_count, rules: n, timespan: 5m, group-by: [ip], condition: {gt: 2}}\n", p)
    assert docs[0]["window"]["count"] == 3 and load(sigma.to_yaml(docs))[1] == []
    for bad in ("c|cidr: 1.0.0.0/8", "c: null", "c: 'a*b'"):
        with pytest.raises(sigma.Refused):
            sigma.convert("title: T\nlogsource: {category: web}\ndetection: {s: {%s}, condition: s}\n" % bad, p)


def test_sql_pushdown(spark, logs):
    pushdown.register(spark)
    df = spark.read.format("skipscan").option("path", logs.path).load()
    assert df.where("msg LIKE '%timeout%'").count() == 100 and df.where("id >= 350").count() == 50


def test_some_queries_against_sql(spark, same):
    names = "tokens_count plan_contains plan_uncovered_kept rule_quantifiers window_trips scan_match_rows plan_conjunction plan_range_tightened plan_partition scan_sql_prefix scan_token_regexp pushdown_values time_travel_scan files_within_horizon leaf_term_counts count_prefix count_refusals hunt_lines compacted_postings build_reports watch_window_alerts sigma_list_or"
    for name in names.split():
        same(queries.QUERIES[name](spark, D), queries.SQL[name], {t: f"{D}/{t}.parquet" for t in ("documents", "events", "part", "customer")})


def numbers(spark, path, **more):
    return Table.create(spark, str(path), T.StructType.fromDDL("id long, k string, ts timestamp_ntz"), **more)


def some(spark, a, b, step="1 minute"):
    return spark.range(a, b).select("id", F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + id * INTERVAL {step}").alias("ts"))


def test_writers_at_once_keep_all_snapshots(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    t = numbers(spark, tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: Table(spark, t.path).append(some(spark, 10 * i, 10 * i + 10), files=1), range(6)))
    assert [s.id for s in t.snapshots()] == list(range(1, 7)) and t.frame(t.files()).count() == 60
    assert not store.put_next(spark, f"{t.path}/log", 5, {})  # its number is taken
    # what a writer left aside is no version
    (tmp_path / "t" / "log" / ".000000000007.json.x").write_text("{")
    assert Table(spark, t.path).current().id == 6


def test_checkpoints_give_the_same_files(spark, tmp_path, monkeypatch):
    from skipscan.sources import table as M

    monkeypatch.setattr(M, "CHECKPOINT", 3)
    t = numbers(spark, tmp_path / "t")
    for i in range(5):
        t.append(some(spark, i, i + 1), files=1)
    gone = t.files()[0]["path"]
    t.remove([gone])
    t.restore([gone])
    t.remove([gone])
    assert len(store.versions(spark, f"{t.path}/live")) == 2
    whole = {f["path"] for s in t.snapshots() for f in s.added}
    assert {f["path"] for f in Table(spark, t.path).files()} == whole - {gone} and len(t.files(at=7)) == 5


def test_a_build_that_was_overtaken_is_refused(spark, tmp_path):
    t = numbers(spark, tmp_path / "t")
    t.append(some(spark, 0, 9), files=1)
    index = Index(t, "k")
    index.build(Settings(analyzer="value"))
    t.append(some(spark, 9, 12), files=1)
    other, put = Index(t, "k"), store.put_next

    def overtaken(s, path, after, doc):
        if path.endswith("/meta") and not overtaken.done:
            overtaken.done = True
            store.delete(s, f"{index.root}/lease.json")
            other.build(Settings(analyzer="value"))
        return put(s, path, after, doc)

    overtaken.done = False
    try:
        store.put_next = overtaken
        with pytest.raises(BuildRefused, match="first"):
            index.build(Settings(analyzer="value"))
    finally:
        store.put_next = put
    assert C.count(t, "k", "k0") == {"count": 4, "files": 2}
    # a leaf that has gone means a new full build
    store.delete(spark, next(iter(index.meta()["leaves"]["ranges"].values())))
    assert [r["kind"] for r in index.build(Settings(analyzer="value"))] == ["full"] and C.count(t, "k", "k1")["count"] == 4


def test_files_of_one_name_in_several_folders(spark, tmp_path):
    t = numbers(spark, tmp_path / "t")
    t.append(some(spark, 0, 30).coalesce(1), each=F.col("id") % 5)
    names = [f["path"].rsplit("/", 1)[-1] for f in t.files()]
    assert len(names) == 5
    Index(t, "k").build(Settings(analyzer="value", pass_bytes=1))
    assert len(Index(t, "k").reports()) == 5 and C.count(t, "k", "k0") == {"count": 10, "files": 5}


def test_partitions_prune(spark, tmp_path):
    t = numbers(spark, tmp_path / "p", partitioned_by=("k",))
    t.append(some(spark, 0, 30))
    assert len(t.files()) == 3 and {f["partition"]["k"] for f in t.files()} == {"k0", "k1", "k2"}
    for p, n in ((P.eq("k", "k1"), 1), (P.ne("k", "k1"), 2), (P.in_("k", ["k0", "zz"]), 1), (P.eq("k", "x"), 0)):
        assert len(S.plan(t, p)[0]) == n and S.scan(t, p)[0].count() == t.frame(t.files()).where(P.row_filter(p)).count()


def test_tiers_of_other_makers(spark, tmp_path):
    from skipscan.operators.build import TIERS, register_tier

    def probe(leaf, p):
        return {r[0] for r in leaf.where(F.col("most") >= len(p.value)).collect()} if p.op == "contains" else None

    register_tier("longest", lambda rows, kind: rows.groupBy("ordinal").agg(F.max(F.length("v")).alias("most")), probe)
    try:
        t = Table.create(spark, str(tmp_path / "t"), T.StructType.fromDDL("v string"))
        for v in ("short", "a text of some length", None):
            t.append(spark.createDataFrame([(v,)], "v string"), files=1)
        Index(t, "v").build(Settings(bloom=False, grams=False, terms=False, more=("longest",)))
        kept, report = S.plan(t, P.contains("v", "some text"))
        assert len(kept) == 1 and report.kept["longest"] == 1
    finally:
        del TIERS["longest"]


def window_rule(n=3, frame="5m"):
    return rule_of({"id": "w", "table": "t", "where": {"column": "id", "gte": 0}, "window": {"ts_column": "ts", "timeframe": frame, "count": n, "group_by": "k"}})


def test_windows_count_over_polls(spark, tmp_path):
    t, sent = numbers(spark, tmp_path / "t"), []
    t.append(some(spark, 0, 1), files=1)
    folder = str(tmp_path / "w")
    watcher = lambda: W.Watcher(t, [window_rule(frame="10m")], lambda a: sent.extend(a) or {}, folder=folder)
    assert watcher().poll() == []
    t.append(some(spark, 3, 4), files=1)
    assert watcher().poll() == []  # another watcher each time: the rings are in the folder
    t.append(some(spark, 6, 7), files=1)
    w = watcher()
    assert [(a["evidence"]["key"], a["evidence"]["end_ts"] - a["evidence"]["start_ts"]) for a in w.poll()] == [("k0", 360_000)] and len(sent) == 1
    assert w.poll() == [] and w.counters["trips"] == 1
    # two late events: older than all of a full ring
    for a, b in ((102, 103), (105, 106)):
        t.append(some(spark, a, b, "1 hour"), files=1)
        w.poll()
    t.append(some(spark, 108, 109, "1 hour").unionByName(some(spark, 0, 1)), files=1)
    w.poll()
    assert w.counters["late"] == 0 and len(sent) == 1
    t.append(some(spark, 0, 1), files=1)
    w.poll()
    assert w.counters["late"] == 1


def test_keys_beyond_the_cap_go_and_are_counted(spark, tmp_path):
    t = numbers(spark, tmp_path / "t")
    t.append(some(spark, 0, 3), files=1)
    w = W.Watcher(t, [window_rule()], lambda a: {}, most_keys=2)
    w.poll()
    assert w.counters["evicted"] == 1 and w.windows._current()[1].count() == 2


def test_alerts_are_sent_again_after_an_error(spark, tmp_path):
    t, sent = numbers(spark, tmp_path / "t"), []
    t.append(some(spark, 0, 6), files=1)

    def failing(alerts):
        if not failing.done:
            failing.done = True
            raise OSError("sink is down")
        sent.extend(alerts)
        return {"dropped": 2}

    failing.done = False
    rules = [rule_of({"id": "r", "table": "t", "where": {"column": "k", "equals": "k1"}}), rule_of({"id": "x", "table": "t", "column": "nope", "match": "v"}), window_rule(2)]
    w = W.Watcher(t, rules, failing, skipped=4)
    with pytest.raises(OSError):
        w.poll()
    assert w.at is None and not w.claimed
    assert sorted(a["rule"] for a in w.poll()) == ["r", "w", "w", "w"] and len(sent) == 4 and w.poll() == []
    assert dict(w.counters) == {"rules": 3, "skipped": 4, "uncovered": 1, "trips": 3, "late": 0, "evicted": 0, "dropped": 2, "alerts": 4}


def test_a_stream_takes_window_rules(spark, tmp_path):
    t, sent = numbers(spark, tmp_path / "t"), []
    t.append(some(spark, 0, 7), files=1)
    stream = spark.readStream.schema(t.schema).option("recursiveFileLookup", "true").parquet(f"{t.path}/data")
    W.stream(stream, [window_rule(frame="10m"), rule_of({"id": "r", "table": "t", "where": {"column": "k", "equals": "k1"}})], t.path, lambda a: sent.extend(a), str(tmp_path / "cp"), exact=False).awaitTermination()
    assert {a["rule"] for a in sent} == {"w", "r"} and {a["confidence"] for a in sent} == {"advisory"}


def test_min_count_is_by_file(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), T.StructType.fromDDL("msg string"))
    for said in (["err"], ["err", "err again"], ["fine"]):
        t.append(spark.createDataFrame([(x,) for x in said], "msg string"), files=1)
    Index(t, "msg").build()
    rule = rule_of({"id": "r", "table": "t", "column": "msg", "match": "err", "min_count": 2})
    assert sorted(x["status"] for x in W.on_index(t, rule)) == ["hit", "miss", "miss"]


def test_conditions_in_sql_text(spark, logs):
    from skipscan.plans.sqltext import parse

    for where, files in (("skipscan.match(msg, 'timeout')", 1), ("skipscan.contains(msg, 'DISK') = true AND id >= 0", 1), ("msg LIKE '%heartbeat%n3%'", 1), ("id BETWEEN 50 AND 150 AND length(msg) > 3", 2), ("300 <= id", 1), ("msg LIKE 'user%'", 1), ("NOT (id < 300)", 4), ("id IN (5, 205)", 2)):
        df, report = S.scan_sql(logs, where)
        assert sum(v != "absent" for v in report.verdicts.values()) == files, where
        if "skipscan." not in where:
            assert df.count() == logs.frame(logs.files()).where(where).count() > 0
    for bad in ("skipscan.contains(msg)", "skipscan.match(msg, id)", "skipscan.other(msg, 'x')"):
        with pytest.raises(P.BadPredicate):
            parse(spark, bad)
    with pytest.raises(P.BadPredicate):
        S.plan(logs, parse(spark, "skipscan.match(msg, 'a') OR id = 1"))


def test_command_line(spark, logs, capsys):
    from skipscan.__main__ import main

    assert main(["status", logs.path, "msg"], spark) == 0 and '"indexed": true' in capsys.readouterr().out
    assert main(["count", logs.path, "msg", "--term", "timeout"], spark) == 0 and '"count": 100' in capsys.readouterr().out
    assert main(["hunt", logs.path, "msg", "timeout", "absent"], spark) == 0 and '"hit": 1' in capsys.readouterr().out
    assert main(["index", logs.path, "level", "--analyzer", "value"], spark) == 0 and main(["count", logs.path, "msg", "--term", "a b"], spark) == 2


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
