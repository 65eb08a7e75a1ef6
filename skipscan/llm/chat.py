"""Chat formatting in budgeted windows.

A turn is written as <s>[role, escaped]:[chunk]/[place]:[seen]\n[text, escaped]</s>\n, where
seen is 1 in a turn that an earlier window has already trained on or that carries
no loss. Control strings inside roles and texts (<s>, </s>, [INST], [/INST] and the
escape sign itself) are escaped, and unescaping gives the text back exactly.

Prefix sums of the turns' tokens choose windows: a window takes turns as long as
the system turn, a limited history and the new turns stay within the budget; a
turn is never cut, so one that is larger than the budget has a window of its own.
Each window starts with the system turn in force (the last one before it), then
repeats up to `history` tokens of the turns before it (both masked), then has its
new turns, of which those of the assistant carry loss. So each target is trained on
once.

No conversation is one row. Turn numbers are cut into chunks of 2**CHUNK, in which
turns are ranked by a sort that spills; the ranks are cut into stretches of STRETCH
turns, and only a stretch is held in memory, with the few turns before it that may be
history. A stretch begins a window; a chunk begins without history, but with the
system turn in force. digests() has to hash a conversation as one string.

Tokens are counted as words and single marks, a measure that needs no vocabulary;
a caller's budget is in that measure.
Everything is DataFrame functions.

Edge cases: a null text is an empty one, a null role is the role ''; turns order a
conversation, then role and text where turns tie or are null (nulls first);
repeated rows are turns of their own; a null conv_id is a conversation; an empty
table gives no windows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skipscan.llm.common import table

BUDGET, HISTORY = 512, 128
#: Turn numbers of a chunk (a power of two), and turns of a stretch.
CHUNK, STRETCH = 12, 64
#: Tokens of a turn beside its text's: the marks and the role.
MARKS = 4
OPEN, CLOSE = "<s>", "</s>\n"
#: Inside a text, the escape sign and the first sign of each control string get the escape sign and a letter.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}  # and : in a role is \\c


def escaped(c: Column) -> Column:
    for sign, told in ESCAPES.items():
        c = F.replace(c, F.lit(sign), F.lit(told))
    return c


def unescaped(c: Column) -> Column:
    """An escaped text has no [ and no < of its own, so [ can stand for a pair of
    escape signs until the other escapes, whose letters are unlike each other, are gone."""
    for told, sign in (("\\\\", "["), ("\\l", "<"), ("\\c", ":"), ("[", "\\s"), ("\\b", "["), ("\\s", "\\")):
        c = F.replace(c, F.lit(told), F.lit(sign))
    return c


def tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\w+|[^\w\s]"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (chunk, place of its first new turn), text, spans (start and end of each loss stretch, in characters from 0)."""
    if budget < 1 or not 0 <= history < budget:
        raise ValueError("history must be below the budget")
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    tail = history // MARKS  # the most turns that history can hold
    stretch = max(STRETCH, tail)
    turn = F.col("turn").cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.shiftright(turn, CHUNK), F.lit(-(1 << 62))).alias("chunk"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    system = lambda told: F.when(F.col("role") == "system", told)
    # The system turn in force where a chunk begins; only conversations of several chunks have one.
    order = F.struct(F.coalesce("turn", F.lit(-(1 << 63))), "role", "text")
    of_chunk = rows.groupBy("conv_id", "chunk").agg(F.max_by(system(F.col("text")), system(order)).alias("own"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_chunk.select(F.col("conv_id").alias("of"), F.col("chunk").alias("at"), F.last("own", ignorenulls=True).over(earlier).alias("carried")).where("carried IS NOT NULL")
    # Ranks within a chunk, then stretches, each with copies of the turns that may be its history.
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    rows = rows.select("*", place.alias("i"), (tokens(F.col("text")) + MARKS).cast("long").alias("n"))
    own = F.floor(F.col("i") / stretch).cast("int")
    to = F.when(F.col("i") % stretch >= stretch - tail, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select("*", own.alias("own"), F.explode(to).alias("stretch"))
    new = F.col("own") == F.col("stretch")
    # A turn too long for history stays as its length alone.
    one = F.struct("i", "role", F.when(new | (F.col("n") <= history), F.col("text")).alias("text"), "n")
    held = rows.groupBy("conv_id", "chunk", "stretch").agg(F.sort_array(F.collect_list(one)).alias("t"), F.count_if(~new).cast("int").alias("k"), F.max_by(system(F.col("text")), F.when(new & (F.col("role") == "system"), F.col("i"))).alias("last")).where(F.size("t") > F.col("k"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("conv_id", "chunk").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("conv_id", "chunk", "t", "k", before.alias("before")).join(carried, F.expr("conv_id <=> of AND chunk = at"), "left").withColumn("before", F.coalesce("before", "carried"))
    # Prefix sums: ends[i] is the tokens of the turns before i.
    ends = F.aggregate("t", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["n"])))
    size = lambda c: F.coalesce(tokens(c) + MARKS, F.lit(0)).cast("long")
    held = held.select("conv_id", "chunk", "t", "k", "before", ends.alias("ends"))
    # Cuts: a turn opens a window when system, history and new turns would pass the budget.
    room = lambda n: F.greatest(F.lit(budget - history) - n, F.lit(1))
    met = F.when(F.get("t", F.col("k"))["role"] == "system", F.get("t", F.col("k"))["n"]).otherwise(size(F.col("before")))
    start = F.struct(F.array("k").alias("cuts"), F.get("ends", F.col("k")).alias("from"), room(size(F.col("before"))).alias("room"), met.alias("met"))

    def step(a: Column, i: Column) -> Column:
        x = F.get("t", i)
        now = F.when(x["role"] == "system", x["n"]).otherwise(a["met"])
        opened = F.struct(F.concat(a["cuts"], F.array(i)).alias("cuts"), F.get("ends", i).alias("from"), room(a["met"]).alias("room"), now.alias("met"))
        return F.when(F.get("ends", i + 1) - a["from"] > a["room"], opened).otherwise(F.struct(a["cuts"].alias("cuts"), a["from"].alias("from"), a["room"].alias("room"), now.alias("met")))

    rest = F.when(F.size("t") > F.col("k") + 1, F.sequence(F.col("k") + 1, F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
    held = held.withColumn("cuts", F.aggregate(rest, start, step)["cuts"])
    # Windows: from the first turn of history to the last new one, and the system turn if it stands before.
    def window(first: Column, w: Column) -> Column:
        last = F.coalesce(F.get("cuts", w + 1), F.size("t")) - 1
        begin = F.size(F.filter(F.slice("ends", 1, first), lambda e: F.get("ends", first) - e > history))
        told = F.filter(F.slice("t", 1, first), lambda x: x["role"] == "system")
        latest = F.element_at(F.when(F.size(told) > 0, told), -1)
        told_at = F.when(F.size(told) > 0, latest["i"] >= F.get("t", begin)["i"]).otherwise(False)
        return F.struct(F.get("t", first)["i"].alias("first"), F.slice("t", begin + 1, last - begin + 1).alias("turns"), told_at.alias("inside"), F.coalesce(latest["text"], F.col("before")).alias("text"))

    # No cuts are null or empty; from the inner form the planner infers filters that make them anew.
    made = held.select("conv_id", "chunk", F.explode_outer(F.transform("cuts", window)).alias("w"))
    turn_of = lambda i, r, t, fresh: F.struct(i.alias("i"), r.alias("role"), t.alias("text"), fresh.alias("new"))
    part = F.transform("w.turns", lambda x: turn_of(x["i"], x["role"], x["text"], x["i"] >= F.col("w.first")))
    # A repeated system turn has no place of its own in the window's order; it is marked as seen, so its place is not read.
    front = F.when(~F.col("w.inside") & F.col("w.text").isNotNull(), F.array(turn_of(F.lit(0), F.lit("system"), F.col("w.text"), F.lit(False)))).otherwise(F.array().cast("array<struct<i:int,role:string,text:string,new:boolean>>"))
    convs = made.select("conv_id", F.struct("chunk", F.col("w.first").alias("first")).alias("window"), F.concat(front, part).alias("p"))
    learns = lambda x: x["new"] & (x["role"] == "assistant")
    head = lambda x: F.concat(F.lit(OPEN), F.replace(escaped(x["role"]), F.lit(":"), F.lit("\\c")), F.lit(":"), F.col("window.chunk").cast("string"), F.lit("/"), x["i"].cast("string"), F.lit(":"), F.when(x["new"], "0").otherwise("1"), F.lit("\n"))
    made = F.transform("p", lambda x: F.struct(head(x).alias("head"), escaped(x["text"]).alias("body"), learns(x).alias("learn")))
    convs = convs.select("conv_id", "window", made.alias("m"))
    at = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    walk = F.aggregate(
        "m", at,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).alias("at"),
            F.when(x["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    whole = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return convs.select("conv_id", "window", whole.alias("text"), walk["spans"].alias("spans"))


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, turns (i: chunk and place, role, text, each once), loss (texts under the mask in order), chars of all windows."""
    body = F.substring("text", F.lit(len(OPEN) + 1), F.length("text") - len(OPEN) - len(CLOSE))
    blocks = F.split(body, CLOSE + OPEN, -1)  # inside a turn, < is escaped
    head = lambda b: F.regexp_extract(b, r"^([\s\S]*?):(-?[0-9]+/[0-9]+):([01])\n", 0)
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            F.struct(F.regexp_extract(b, r"^[\s\S]*?:(-?[0-9]+)/[0-9]+:[01]\n", 1).cast("long").alias("chunk"), F.regexp_extract(b, r"^[\s\S]*?:-?[0-9]+/([0-9]+):[01]\n", 1).cast("int").alias("at")).alias("i"),
            (F.regexp_extract(b, r"^[\s\S]*?:-?[0-9]+/[0-9]+:([01])\n", 1) == "0").alias("new"),
            unescaped(F.regexp_extract(b, r"^([\s\S]*?):-?[0-9]+/[0-9]+:[01]\n", 1)).alias("role"),
            unescaped(F.substring(b, F.length(head(b)) + 1, F.length(b))).alias("text"),
        ),
    )
    fresh = F.transform(F.filter(parsed, lambda x: x["new"]), lambda x: F.struct(x["i"].alias("i"), x["role"].alias("role"), x["text"].alias("text")))
    loss = F.transform("spans", lambda s: unescaped(F.substring("text", s["start"] + 1, s["end"] - s["start"])))
    per = made.select("conv_id", "window", fresh.alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    return per.groupBy("conv_id").agg(
        F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("window", "loss"))), lambda x: x["loss"])).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )


def digests(made: DataFrame) -> DataFrame:
    back = read_back(made)
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


PROBE = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op10(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(windows(turns.unionByName(spark.sql(PROBE))))


#: Windows by recursion over the turns of a stretch; the digests and lengths follow from the turns and windows.
OP10_SQL = f"""
WITH RECURSIVE a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS p),
b AS (SELECT conv_id, coalesce(turn >> {CHUNK}, {-(1 << 62)}) AS chunk, turn, role, text, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_ \\t\\n\\x0B\\f\\r]')) + {MARKS} AS n FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM b),
q AS (SELECT *, i // {STRETCH} AS s, row_number() OVER o AS nr, sum(n) OVER o - n AS upto, lag(CASE WHEN role = 'system' THEN n END IGNORE NULLS) OVER o AS sn, lag(CASE WHEN role = 'system' THEN i END IGNORE NULLS) OVER (PARTITION BY conv_id, chunk ORDER BY i) AS si FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY chunk, i)),
f AS (SELECT *, length('<s>') + length(replace(replace(replace(replace(role, '\\', '\\\\'), '<', '\\l'), '[', '\\b'), ':', '\\c')) + 1 + length(chunk::VARCHAR || '/' || i::VARCHAR) + 3 + length(replace(replace(replace(text, '\\', '\\\\'), '<', '\\l'), '[', '\\b')) + 5 AS size,
  lag(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY nr) AS st FROM q),
g AS (SELECT conv_id, chunk, s, i, i AS first, n AS used, greatest({BUDGET - HISTORY} - coalesce(sn, 0), 1) AS room FROM f WHERE i % {STRETCH} = 0
  UNION ALL SELECT f.conv_id, f.chunk, f.s, f.i, CASE WHEN used + n > room THEN f.i ELSE first END, CASE WHEN used + n > room THEN n ELSE used + n END, CASE WHEN used + n > room THEN greatest({BUDGET - HISTORY} - coalesce(sn, 0), 1) ELSE room END FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.chunk = g.chunk AND f.s = g.s AND f.i = g.i + 1),
w AS (SELECT g.conv_id, g.chunk, first, max(g.i) AS last FROM g GROUP BY ALL),
h AS (SELECT w.*, f.si, f.st, (SELECT min(x.i) FROM f x WHERE x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.chunk = w.chunk AND x.i <= w.first AND f.upto - x.upto <= {HISTORY}) AS begin FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.chunk = w.chunk AND f.i = w.first),
c AS (SELECT conv_id, sum(chars) AS formatted_chars FROM (SELECT h.conv_id, h.chunk, h.first, sum(f.size) + max(CASE WHEN h.st IS NOT NULL AND (h.si IS NULL OR h.si < h.begin) THEN length('<s>system:' || h.chunk::VARCHAR || '/0:1') + 1 + length(replace(replace(replace(h.st, '\\', '\\\\'), '<', '\\l'), '[', '\\b')) + 5 ELSE 0 END) AS chars
  FROM h JOIN f ON f.conv_id IS NOT DISTINCT FROM h.conv_id AND f.chunk = h.chunk AND f.i BETWEEN h.begin AND h.last GROUP BY ALL) GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nr), '') AS learned FROM f GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""
