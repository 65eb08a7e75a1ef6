"""Rules over newly arrived files: alerts, sinks, the batch poll and the stream.

Delivery is at least once: alerts are sent before they are claimed and before the
place in the table moves on, so an error sends them again. The rings of window rules
are a table in the watcher's folder, one version a poll, so events of one key count
together over polls and restarts."""

from __future__ import annotations

import json
import logging
import time
import urllib.request
import uuid
from collections import Counter, OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipscan.operators.build import Index
from skipscan.plans import predicate as P
from skipscan.plans.scan import _Tiers
from skipscan.rules import compile as C
from skipscan.rules.model import Cond, Rule
from skipscan.sources import store
from skipscan.sources.table import Table
from skipscan.streaming import windows as W
from skipscan.streaming.windows import push

LOG = logging.getLogger("skipscan.alerts")
SINKS: dict[str, Callable[..., Callable[[list[dict]], dict]]] = {}
#: Keys of a window rule whose rings are kept, the latest first, and claims that are remembered.
MOST_KEYS, MOST_CLAIMS = 200_000, 200_000


def sink(name: str):
    def put(make):
        SINKS[name] = make
        return make

    return put


@sink("none")
def none_sink():
    return lambda alerts: {"sent": 0, "dropped": 0}


@sink("log")
def log_sink():
    def send(alerts: list[dict]) -> dict:
        for a in alerts:
            LOG.warning("%s", json.dumps(a, sort_keys=True))
        return {"sent": len(alerts), "dropped": 0}

    return send


@sink("webhook")
def webhook_sink(url: str, waits=(1.0, 5.0), most: int = 1024, post: Callable | None = None, sleep=time.sleep):
    """Three attempts for each alert; what is beyond the queue's length or fails is dropped and counted."""

    def own(body: bytes) -> None:
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=10).close()

    def send(alerts: list[dict]) -> dict:
        sent = 0
        for a in alerts[:most]:
            for wait in (*waits, None):
                try:
                    (post or own)(json.dumps(a, sort_keys=True).encode())
                    sent += 1
                    break
                except OSError as e:
                    if wait is None:
                        LOG.warning("alert dropped: %s", e)
                    else:
                        sleep(wait)
        return {"sent": sent, "dropped": len(alerts) - sent}

    return send


def alert(rule: Rule, table: str, file: str | None, evidence: dict, exact: bool, sql: str, **extra) -> dict:
    return {"rule": rule.id, "level": rule.level, "table": table, "file": file, "evidence": evidence, "confidence": "exact" if exact else "advisory", "extra": extra, "confirmation_sql": sql, "emitted_at_ms": int(time.time() * 1000)}


def claim(a: dict) -> str:
    """What makes an alert the same as another: rule and file, or rule, key and end of a window."""
    e = a["evidence"]
    return f"{a['rule']}|{e['key']}|{e['end_ts']}" if "key" in e else f"{a['rule']}|{a['file']}"


def scan_files(table: Table, rules: list[Rule], files: list[dict], replayed: bool = False) -> list[dict]:
    """Alerts of the row rules on files, in one pass; window rules are WindowState's."""
    schema = table.schema
    missing = {r for r, _ in C.uncovered(rules, schema)}
    own = [r for r in rules if not r.window and r.id not in missing]
    if not own or not files:
        return []
    exact = not table.current().delete_files
    columns = list(dict.fromkeys(c.split(".")[0] for r in own for c in r.columns()))
    df = table.frame(files).select(*columns, F.col("_metadata.file_path").alias("#file"), F.col("_metadata.row_index").alias("#row"))
    by_id = {r.id: r for r in own}
    out = []
    for x in C.evaluate(df, own, "#file", "#row").collect():  # one row for each alert: at most rules x files
        r = by_id[x["rule_id"]]
        sql = C.confirmation_sql(r, schema, "{table}", [x["#file"]])
        out.append(alert(r, table.path, x["#file"], {"matched_rows": x["matched_rows"], "first_positions": x["first_positions"], "field_rows": x["field_rows"]}, exact, sql, replayed=replayed))
    return out


RING = "rule string, key string, ring array<long>, last long"
STEP = "kind string, rule string, key string, ring array<long>, last long, start_ts long, end_ts long, late long"


class WindowState:
    """The rings of window rules by key, as a numbered table in a folder.

    advance() gives the trips of new events and a state to commit(); until then the
    old one holds. The keys of latest events stay, `most` for each rule; late events
    and keys that had to go are counted."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST_KEYS):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def _current(self) -> tuple[int, DataFrame]:
        n, doc = store.read_latest(self.spark, f"{self.path}/current")
        return n, self.spark.read.schema(RING).parquet(doc["rings"]) if doc else self.spark.createDataFrame([], RING)

    def advance(self, events: DataFrame, shape: dict[str, tuple[int, int]]) -> tuple[list, Counter, tuple]:
        """events (rule, key, ts); shape: rule to (count, milliseconds). (trips, counters, what commit() takes)."""

        def step(rows: pd.DataFrame, rings: pd.DataFrame) -> pd.DataFrame:
            known = rows if len(rows) else rings
            rule, key = known["rule"].iloc[0], known["key"].iloc[0]
            n, within = shape[rule]
            ring, last = (list(rings["ring"].iloc[0]), int(rings["last"].iloc[0])) if len(rings) else ([], None)
            late, out = 0, []
            for t in sorted(rows["ts"].tolist()):
                ring, trip, dropped = push(ring, t, n, within)
                late += dropped
                last = t if last is None else max(t, last)
                if trip:
                    out.append(("trip", rule, key, None, None, *trip, 0))
            out.append(("ring", rule, key, ring, last, None, None, late))
            return pd.DataFrame(out, columns=[c.split()[0] for c in STEP.split(", ")]).astype({"last": "Int64", "start_ts": "Int64", "end_ts": "Int64"})

        number, state = self._current()
        state = state.where(F.col("rule").isin(list(shape)))
        keys = ["rule", "key"]
        made = f"{self.path}/steps/{uuid.uuid4().hex}"
        events.where("ts IS NOT NULL").select(*keys, "ts").groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(step, STEP).write.parquet(made)
        rows = self.spark.read.schema(STEP).parquet(made)
        # Rings that are empty after a trip need no place.
        rings = rows.where("kind = 'ring' AND size(ring) > 0").select("rule", "key", "ring", "last")
        counted = {r["rule"]: r["count"] for r in rings.groupBy("rule").count().collect()}
        for rule, n in counted.items():
            if n > self.most:
                least = rings.where(F.col("rule") == rule).orderBy(F.desc("last"), "key").limit(self.most)
                rings = rings.where(F.col("rule") != rule).unionByName(least)
        kept = f"{self.path}/rings/{uuid.uuid4().hex}"
        rings.write.parquet(kept)
        trips = rows.where("kind = 'trip'").select("rule", "key", "start_ts", "end_ts").orderBy("end_ts", "rule", "key").collect()  # one row for each alert
        late = rows.agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]
        return trips, Counter(trips=len(trips), late=late, evicted=sum(max(0, n - self.most) for n in counted.values())), (number, kept)

    def commit(self, made: tuple) -> None:
        number, kept = made
        if not store.put_next(self.spark, f"{self.path}/current", number, {"rings": kept}):
            raise RuntimeError("another watcher has moved this state on")


def window_events(df: DataFrame, rules: list[Rule], schema) -> tuple[DataFrame | None, dict[str, tuple[int, int]]]:
    """(rule, key, ts) of the rows that each window rule counts, and the rules' shapes."""
    out, shape = None, {}
    for r in rules:
        if not r.window or C.uncovered([r], schema):
            continue
        w = r.window
        own = df.where(C.rule_column(r, schema)).select(F.lit(r.id).alias("rule"), W.key_of(list(w.group_by)).alias("key"), W.epoch_ms(w.ts_column, schema).alias("ts"))
        out = own if out is None else out.unionByName(own)
        shape[r.id] = (w.count, w.timeframe_ms)
    return out, shape


def window_alerts(trips: list, rules: list[Rule], schema, table: str, exact: bool, **extra) -> list[dict]:
    by_id, out = {r.id: r for r in rules}, []
    for x in trips:
        r = by_id[x["rule"]]
        key = dict(zip(r.window.group_by, x["key"].split(W.SEPARATOR), strict=True)) if r.window.group_by else {}
        sql = C.confirmation_sql(r, schema, "{table}", None, (x["start_ts"], x["end_ts"]), key)
        out.append(alert(r, table, None, {"key": x["key"], "start_ts": x["start_ts"], "end_ts": x["end_ts"]}, exact, sql, **extra))
    return out


class Watcher:
    """Polls a table: the first poll takes the current snapshot's own files, later ones what was added since.

    With a folder, the place in the table, the claims and the rings outlive the watcher."""

    def __init__(self, table: Table, rules: list[Rule], send: Callable[[list[dict]], dict], folder: str | None = None, most_keys: int = MOST_KEYS, skipped: int = 0):
        self.table, self.rules, self.send = table, rules, send
        self.folder = folder or f"{table.path}/watch/{uuid.uuid4().hex}"
        self.windows = WindowState(table.spark, f"{self.folder}/windows", most_keys)
        self.number, kept = store.read_latest(table.spark, f"{self.folder}/place")
        self.at: int | None = kept["at"] if kept else None
        self.claimed: OrderedDict[str, None] = OrderedDict.fromkeys(kept["claimed"] if kept else ())
        uncovered = C.uncovered(rules, table.schema)
        for rule, why in uncovered:
            LOG.warning("rule %s is not evaluated: %s", rule, why)
        self.counters = Counter(rules=len(rules), skipped=skipped, uncovered=len({r for r, _ in uncovered}))

    def replay(self, now_ms: int | None = None) -> list[dict]:
        """After a start without kept rings: files within the longest timeframe, for the window rules; marked as replayed."""
        horizon = max((r.window.timeframe_ms for r in self.rules if r.window), default=0)
        files = self.table.added_within(horizon, now_ms or int(time.time() * 1000)) if horizon else []
        return self._pass([], files, self.at, replayed=True)

    def poll(self) -> list[dict]:
        now = self.table.current()
        if now is None or now.id == self.at:
            return []
        files = self.table.added_since(self.at)
        return self._pass(files, files, now.id)

    def _pass(self, files: list[dict], timed: list[dict], at: int | None, replayed: bool = False) -> list[dict]:
        """Alerts on files; only once they are sent are they claimed, and do the rings and the place move on."""
        alerts, state, counts = scan_files(self.table, self.rules, files, replayed), None, Counter()
        schema = self.table.schema
        events, shape = window_events(self.table.frame(timed), self.rules, schema) if timed else (None, {})
        if events is not None:
            trips, counts, state = self.windows.advance(events, shape)
            alerts += window_alerts(trips, self.rules, schema, self.table.path, not self.table.current().delete_files, replayed=replayed)
        new = list({claim(a): a for a in alerts if claim(a) not in self.claimed}.values())
        if new:
            sent = self.send(new) or {}
            counts["dropped"] += sent.get("dropped", 0)
        if state:
            self.windows.commit(state)
        for a in new:
            self.claimed[claim(a)] = None
        while len(self.claimed) > MOST_CLAIMS:
            self.claimed.popitem(last=False)
        self.at = at
        if store.put_next(self.table.spark, f"{self.folder}/place", self.number, {"at": at, "claimed": list(self.claimed)}):
            self.number += 1
        self.counters.update(counts)
        self.counters["alerts"] += len(new)
        return new


def on_index(table: Table, rule: Rule) -> list[dict]:
    """Verdicts of a rule that the index alone decides, for each live file.

    With a min_count, a file is a hit where the rule's terms stand in it so often."""
    if why := rule.why_not_on_index():
        raise ValueError(f"{rule.id}: {why}")
    index = Index(table, rule.fields[0].column)
    meta, files = index.meta(), table.files()
    if not meta:
        return [{"path": f["path"], "status": "unresolved"} for f in files]
    tiers = _Tiers(index, meta, files)

    def of(c: Cond):
        if c.field:
            out = None
            for v in c.field.values:
                node = P.match(c.field.column, v) if c.field.op == "match" else P.contains(c.field.column, v)
                got = tiers.terms(node) if c.field.op == "match" else tiers.grams(node)
                out = got if out is None else out.either(got)
            return out
        parts = [of(p) for p in c.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.both(p) if c.op == "and" else out.either(p)
        return out

    got = of(rule.condition)
    out = [{"path": f["path"], "status": "hit" if f["path"] in got.hits else "miss" if f["path"] in got.absent else "unresolved"} for f in files]
    if rule.min_count > 1 and rule.fields[0].op == "match":
        terms = [tiers.asked(v) for v in rule.fields[0].values]
        if any(t is None or len(t) != 1 for t in terms):
            # Some value is no one term of this index, so its files cannot be counted here.
            return [x | {"status": "unresolved" if x["status"] == "hit" else x["status"]} for x in out]
        counts = tiers.counts([t[0] for t in terms])
        enough = {p for p, o in tiers.ordinal.items() if counts.get(o, 0) >= rule.min_count}
        out = [x | {"status": "miss" if x["status"] == "hit" and x["path"] not in enough else x["status"]} for x in out]
    return out


def stream(df: DataFrame, rules: list[Rule], table: str, send: Callable[[list[dict]], dict], checkpoint: str, exact: bool = True, most_keys: int = MOST_KEYS, **trigger):
    """Rules over a file stream: each batch is one pass, and its alerts go to the sink before the batch is done.

    exact: False where rows may have been deleted, so that evidence is advisory."""
    schema, windows = df.schema, WindowState(df.sparkSession, f"{checkpoint}/windows", most_keys)

    def each(batch: DataFrame, batch_id: int) -> None:
        where = batch.select("*", F.input_file_name().alias("#file"), F.monotonically_increasing_id().alias("#row"))
        by_id = {r.id: r for r in rules}
        own = [r for r in rules if not r.window]
        found = C.evaluate(where, own, "#file", "#row").collect() if own else []
        alerts = [alert(by_id[x["rule_id"]], table, x["#file"], {"matched_rows": x["matched_rows"]}, exact, C.confirmation_sql(by_id[x["rule_id"]], schema, "{table}", [x["#file"]]), batch=batch_id) for x in found]
        events, shape = window_events(batch, rules, schema)
        state = None
        if events is not None:
            trips, _, state = windows.advance(events, shape)
            alerts += window_alerts(trips, rules, schema, table, exact, batch=batch_id)
        if alerts:
            send(alerts)
        if state:
            windows.commit(state)

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def broken_chain(reports: DataFrame) -> DataFrame:
    """Build reports whose predecessor is not the one before them (build_id, previous_build_id, snapshot)."""
    from pyspark.sql import Window

    before = F.lag("build_id").over(Window.orderBy("snapshot", "build_id"))
    return reports.withColumn("expected", before).where("expected IS NOT NULL AND NOT previous_build_id <=> expected")
