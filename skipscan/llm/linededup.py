"""Line dedup by a log-template tree of fixed depth.

A line's words, with those that hold a digit as the variable field <*>, lead
through the tree: its number of words, then its DEPTH leading words, then a leaf
of templates. A leaf generalises further: a line of PARTED words and more is cut
by position into PARTS parts, and each choice of all parts but one is a template
whose left-out part is variable. So lines of a leaf that differ within one part
share a template, and three quarters of their words agree place by place. Shorter
lines are templates by themselves. At least half of a line's words must be
constants of a template. A template that stands in at least `least_docs` documents
recurs, and its lines are dropped but for the first (by doc_id, then place): a line
goes if it recurs by some template and is the first of none, so that each passage
stays once. Everything is DataFrame functions.

Edge cases: a null text stays null, an empty one stays empty; lines of fewer than
LEAST_WORDS words are never dropped, nor are lines mostly of variable fields;
repeated rows (same doc_id and text) are one document and are treated alike; a
null doc_id sorts first; an empty table gives no rows; very long lines are lines
like others; a column of docs with the name of the count is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skipscan.llm.common import discard, materialize, table

DEPTH = 2
LEAST_DOCS = 2
LEAST_WORDS = 4
#: Words from which on a line is cut into parts, and how many.
PARTED, PARTS = 12, 4


def templates(text: Column) -> Column:
    """An empty string, then each line of the text, with single spaces and its variable fields masked.

    Done on the whole text at once; a field is looked for behind a separator alone, so
    that a long word is read once, and the line break in front gives each word one."""
    spaced = F.regexp_replace(text, r"[ \t\x0B\f\r](?:[ \t\x0B\f\r]++|(?<! ))", " ")
    return F.split(F.regexp_replace(F.concat(F.lit("\n"), spaced), r"([ \n])[^ \n0-9]*+[0-9][^ \n]*+", "$1<*>"), "\n")


def lines(docs: DataFrame) -> DataFrame:
    """d, th, pos and keys (h, g) of the templates of each line; th tells texts of one doc_id apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("th"), templates(F.col("text")).alias("lines"))
    # The outer form: from the inner one the planner infers filters that make the templates anew, twice. A null text has no words, so it goes below.
    rows = texts.select("d", "th", F.posexplode_outer("lines").alias("pos", "line")).select("d", "th", (F.col("pos") - 1).alias("pos"), F.trim("line").alias("t"))
    # Sizes in bytes, which need no walk over the text.
    spaces = F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" ")))
    rows = rows.select("*", F.when(F.col("t") == "", 0).otherwise(spaces + 1).alias("n")).where(F.col("n") >= LEAST_WORDS)
    long, masked = F.col("n") >= PARTED, F.contains("t", F.lit("<*>"))
    cut = lambda c, count: F.call_function("substring_index", F.col(c), F.lit(" "), count)
    edge = lambda i: F.floor(F.col("n") * i / PARTS).cast("int")
    # s1 to s3: the words up to each edge; p0 to p3: the parts.
    rows = rows.select("*", masked.alias("masked"), cut("t", F.lit(DEPTH)).alias("path"), F.when(long, cut("t", edge(PARTS - 1))).alias(f"s{PARTS - 1}"))
    for i in range(PARTS - 2, 0, -1):
        rows = rows.select("*", cut(f"s{i + 1}", edge(i)).alias(f"s{i}"))
    whole = lambda i: "t" if i == PARTS else f"s{i}"
    part = lambda i: F.col("s1") if i == 0 else F.when(long, cut(whole(i + 1), edge(i) - edge(i + 1)))
    rows = rows.select("d", "th", "pos", "n", "path", "t", "masked", *(part(i).alias(f"p{i}") for i in range(PARTS)))
    fields = lambda c: F.when(F.col("masked"), F.floor((F.octet_length(c) - F.octet_length(F.replace(F.col(c), F.lit("<*>")))) / 3)).otherwise(0)
    hashes = lambda c, seed: F.xxhash64(c, *([F.lit(1)] if seed else []))
    parts = [f"p{i}" for i in range(PARTS)]
    rows = rows.select("d", "th", "pos", "n", "path", *(F.when(~long, hashes("t", k)).alias(c) for k, c in enumerate("xy")), F.when(~long, fields("t")).alias("f"), *(hashes(c, k).alias(f"{x}{c[1:]}") for c in parts for k, x in enumerate("xy")), *(fields(c).alias(f"f{c[1:]}") for c in parts))

    def key(left_out: int) -> Column:
        others = [i for i in range(PARTS) if i != left_out]
        constants = sum((edge(i + 1) - edge(i) - F.col(f"f{i}") for i in others), F.lit(0))
        told = F.struct(F.xxhash64(F.lit(left_out), "n", "path", *(f"x{i}" for i in others)).alias("h"), F.xxhash64(*(f"y{i}" for i in others), F.lit(left_out), "path", "n").alias("g"))
        return F.when(2 * constants >= F.col("n"), told)

    whole = F.when(2 * (F.col("n") - F.col("f")) >= F.col("n"), F.struct(F.xxhash64(F.lit(-1), "n", "path", "x").alias("h"), F.xxhash64("y", F.lit(-1), "path", "n").alias("g")))
    keys = F.when(long, F.array(*(key(i) for i in range(PARTS)))).otherwise(F.array(whole))
    # No filter here: the planner would push it down and make all of the above twice.
    return rows.select("d", "th", "pos", F.array_compact(keys).alias("keys"))


def recurring(keyed: DataFrame, least_docs: int) -> DataFrame:
    """h, g of each template in at least least_docs documents, and its first place."""
    first = F.min(F.struct("d", "th", "pos")).alias("first")
    if least_docs == 2:  # two documents: the first is not the last
        per = keyed.groupBy("h", "g").agg(first, F.max(F.struct("d", "th")).alias("last"))
        return per.where(~F.struct("first.d", "first.th").eqNullSafe(F.col("last"))).select("h", "g", "first")
    per = keyed.groupBy("h", "g", "d", "th").agg(F.min("pos").alias("pos"))
    return per.groupBy("h", "g").agg(F.count("*").alias("docs"), first).where(F.col("docs") >= least_docs).select("h", "g", "first")


def dropped(docs: DataFrame, least_docs: int) -> DataFrame:
    """d, th, gone: the places of the lines to drop, for each document that has some, as a table."""
    made = materialize(lines(docs), "lines")
    keyed = made.select("d", "th", "pos", F.explode("keys").alias("k")).select("d", "th", "pos", "k.h", "k.g")
    known = materialize(recurring(keyed, least_docs), "templates")
    met = keyed.join(known.hint("merge"), ["h", "g"])
    # A line that is the first of one of its templates stays.
    per = met.groupBy("d", "th", "pos").agg(F.min((~F.struct("d", "th", "pos").eqNullSafe(F.col("first"))).cast("int")).alias("later"))
    gone = materialize(per.where("later = 1").groupBy("d", "th").agg(F.collect_list("pos").alias("gone")), "gone")
    discard(made, known)
    return gone


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, count: str | None = "n_dropped") -> DataFrame:
    """docs with all their columns; text without its dropped lines, and their number in the column count."""
    if least_docs < 2:
        raise ValueError("a template recurs in two documents at least")
    gone = dropped(docs, least_docs)
    out = docs.alias("x").join(gone.hint("merge").alias("y"), F.expr("cast(x.doc_id AS long) <=> y.d AND xxhash64(x.text) = y.th"), "left")
    every = F.split(F.col("x.text"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("y.gone"))
    text = F.when(F.col("y.gone").isNull(), F.col("x.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(every, i)), "\n"))
    columns = [text.alias(c) if c.lower() == "text" else F.col(f"x.`{c}`") for c in docs.columns if not count or c.lower() != count.lower()]
    n = F.when(F.col("y.gone").isNull(), 0).otherwise(F.size("y.gone")).cast("long")
    return out.select(*columns, *([n.alias(count)] if count else []))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_dropped")


def sql(documents: str = "documents", least_docs: int = LEAST_DOCS) -> str:
    """DuckDB's way to the rows of op4."""
    part = lambda i: f"array_to_string(w[len(w) * {i} // {PARTS} + 1:len(w) * {i + 1} // {PARTS}], ' ')"
    fields = lambda c: f"(length({c}) - length(replace({c}, '<*>', ''))) // 3"

    def key(left_out: int) -> str:
        others = [i for i in range(PARTS) if i != left_out]
        constants = " + ".join(f"(len(w) * {i + 1} // {PARTS} - len(w) * {i} // {PARTS} - {fields(part(i))})" for i in others)
        words = " || chr(10) || ".join(map(part, others))
        return f"CASE WHEN 2 * ({constants}) >= len(w) THEN struct_pack(a := {left_out}, n := len(w), p := array_to_string(w[1:{DEPTH}], ' '), x := {words}) END"

    whole = f"CASE WHEN 2 * (len(w) - {fields("array_to_string(w, ' ')")}) >= len(w) THEN struct_pack(a := -1, n := len(w), p := array_to_string(w[1:{DEPTH}], ' '), x := array_to_string(w, ' ')) END"
    return rf"""
WITH l AS (SELECT doc_id AS d, text AS th, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {documents} WHERE text IS NOT NULL),
t AS (SELECT d, th, pos, CASE WHEN m = '' THEN [] ELSE string_split(m, ' ') END AS w FROM (SELECT *, regexp_replace(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'), ' '), '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS m FROM l)),
k AS (SELECT * FROM (SELECT d, th, pos, unnest(CASE WHEN len(w) < {LEAST_WORDS} THEN [] WHEN len(w) < {PARTED} THEN [{whole}] ELSE [{", ".join(key(i) for i in range(PARTS))}] END) AS key FROM t) WHERE key IS NOT NULL),
r AS (SELECT key, min((d, hx, pos)) AS first FROM (SELECT *, th AS hx FROM k) GROUP BY key HAVING count(DISTINCT (d, th)) >= {least_docs}),
g AS (SELECT d, th, pos FROM (SELECT d, th, pos, bool_and((d, th, pos) <> first) AS later FROM k JOIN r USING (key) GROUP BY 1, 2, 3) WHERE later),
a AS (SELECT d, th, string_agg(line, chr(10) ORDER BY pos) AS kept FROM (SELECT l.* FROM l ANTI JOIN g ON l.d = g.d AND l.th = g.th AND l.pos = g.pos) GROUP BY 1, 2),
c AS (SELECT d, th, count(*) AS n FROM g GROUP BY 1, 2)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, CASE WHEN text IS NULL THEN 0 ELSE length(coalesce(kept, '')) END::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS n_dropped
FROM {documents} x LEFT JOIN a ON a.d = x.doc_id AND a.th = x.text LEFT JOIN c ON c.d = x.doc_id AND c.th = x.text
"""


OP4_SQL = sql()
