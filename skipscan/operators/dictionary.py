"""Index tiers as aggregations: postings of terms and of grams, bloom words, saturation.

`where` names the column that tells files apart (an ordinal, or a logical segment)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipscan.functions import kinds, text

RANGES = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Columns of stored leaves; with them a read needs no look at a file first.
TERM_LEAF = "term string, file_count long, total_count long, ordinals array<int>, counts array<long>"
GRAM_LEAF = "gram string, ordinals array<int>"


def terms_per_row(c: Column, t: T.DataType, analyzer: str, cap: int = text.CAP) -> Column:
    """The terms of a row: tokens or pieces with repeats, or each distinct value once."""
    own = F.filter(kinds.members(c, t), lambda x: x.isNotNull())
    if analyzer == "value":
        return F.array_distinct(F.filter(own, lambda x: (x != "") & (F.length(x) <= cap)))
    if analyzer == "tokens":
        return F.flatten(F.transform(own, lambda x: text.tokens(x, cap)))
    if analyzer == "pieces":
        return F.flatten(F.transform(own, lambda x: F.filter(text.pieces(x), lambda t: F.length(t) <= cap)))
    if analyzer == "short-pieces":
        return F.flatten(F.transform(own, lambda x: text.short_pieces(x, cap)))
    raise ValueError(f"unknown analyzer {analyzer}")


def term_counts(df: DataFrame, where: str, terms: Column) -> DataFrame:
    """where, term, occurrences."""
    return df.select(where, F.explode(terms).alias("term")).groupBy(where, "term").agg(F.count("*").alias("occurrences"))


def counted_terms(rows: DataFrame, t: T.DataType, analyzer: str, cap: int = text.CAP) -> DataFrame:
    """term_counts() of rows (ordinal, v), by way of text_dictionary() where these are texts."""
    if not _told_apart(t, analyzer):
        return term_counts(rows, "ordinal", terms_per_row(F.col("v"), t, analyzer, cap))
    each = text_dictionary(rows, analyzer, cap).select("term", F.explode(F.arrays_zip("ordinals", "counts")).alias("x"))
    return each.select(F.col("x.ordinals").alias("ordinal"), "term", F.col("x.counts").alias("occurrences"))


def dictionary_of(rows: DataFrame, t: T.DataType, analyzer: str, cap: int = text.CAP) -> DataFrame:
    """term_dictionary() of rows (ordinal, v)."""
    return text_dictionary(rows, analyzer, cap) if _told_apart(t, analyzer) else term_dictionary(counted_terms(rows, t, analyzer, cap), "ordinal")


def _told_apart(t: T.DataType, analyzer: str) -> bool:
    return isinstance(t, T.StringType) and analyzer != "value"


def text_dictionary(rows: DataFrame, analyzer: str, cap: int = text.CAP) -> DataFrame:
    """term_dictionary() of texts. Each task counts many files and deals their postings by term, so that a
    common term goes over once a task and not once a file; the postings of a term are then put together."""
    plain = rows.where(F.col("v").isNotNull()).select(F.col("ordinal").cast("int"), F.col("v").cast("binary"))
    told = _batched(plain).mapInArrow(_term_counter(analyzer, cap), "term string, ordinals array<int>, counts array<long>")
    return told.repartition("term").sortWithinPartitions("term").mapInArrow(_term_merger(), TERM_LEAF)


def _batched(df: DataFrame) -> DataFrame:
    """Rows go to Python in Arrow batches of bounded size; the session keeps these settings, which are the training data operators' too."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


#: Pairs of files and terms, or signs of one file, that a task holds before they are passed on.
HELD_TERMS, HELD_SIGNS = 1_000_000, 4_000_000
#: Keys of a batch that a task passes on, and grams of a row of gram_sets() and of a batch of these.
STEP, SET = 50_000, 200_000
#: Texts of fewer signs are remembered within a file, up to KNOWN of them, so that those that recur are looked at once.
SHORT, KNOWN = 100, 10_000


def _inverted(keys, *values, names):
    """Batches (key, values of its pairs, in their order) with each key once, from pairs."""
    import numpy as np
    import pyarrow as pa

    told = keys.dictionary_encode()
    at = told.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(told.dictionary)))))
    for lo in range(0, len(told.dictionary), STEP):
        own = cuts[lo : lo + STEP + 1]
        pick, offsets = order[own[0] : own[-1]], pa.array((own - own[0]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([told.dictionary[lo : lo + STEP].cast(pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(v[pick])) for v in values)], names)


def _term_counter(analyzer: str, cap: int):
    piece, shape, long_number, most = text.PIECE, f"{text.IPV4}|{text.HEX}", text.LONG_NUMBER, HELD_TERMS
    # Signs of runs, folded; all others, and so all bytes of signs beyond ASCII, end a run.
    runs = bytes(ord(c) if (c := chr(i).lower()) in f"{text.LOWER}0123456789.:_-" and i < 128 else 32 for i in range(256))

    def run(batches):
        import re
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = re.compile(piece.encode()).findall
        shaped, number = re.compile(shape.encode()).fullmatch, re.compile(long_number.encode()).fullmatch
        hexes, five = re.compile(b"[0-9a-f:]+").fullmatch, re.compile(b"[0-9a-f]{5}").search

        def compound(r: bytes) -> bool:  # as text.is_compound_text()
            if shaped(r):
                return True
            return bool(2 <= r.count(b":") <= 7 and hexes(r) and b":::" not in r and r.count(b"::") <= 1 and re.search(b"[0-9]", r) and not five(r))

        def terms(have):
            """Counts of runs as counts of terms."""
            whole = Counter()
            for r in [r for r in have if not r.isalnum()]:
                n = have.pop(r)
                for p in pieces(r):
                    have[p] += n
                if analyzer == "tokens" and compound(bare := r.strip(b".:_-")):
                    whole[bare] += n
            if analyzer == "short-pieces":
                for r in [r for r in have if number(r)]:
                    del have[r]
            have.update(whole)
            keys, n = pa.array(have.keys(), pa.binary()), np.fromiter(have.values(), np.int64, len(have))
            fits = pc.less_equal(pc.binary_length(keys), cap).to_numpy(zero_copy_only=False)
            return (keys, n) if fits.all() else (keys.filter(pa.array(fits)), n[fits])

        held, size = [], 0  # terms, counts and ordinal of the files so far

        def out():
            owners = np.concatenate([np.full(len(n), o, np.int32) for _, n, o in held])
            yield from _inverted(pa.concat_arrays([k for k, _, _ in held]), owners, np.concatenate([n for _, n, _ in held]), names=["term", "ordinals", "counts"])

        of, have = None, Counter()
        for b in batches:
            ordinals = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ordinals)) + 1).tolist(), len(ordinals)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if have and (ordinals[lo] != of or len(have) > most):
                    held.append((*terms(have), of))
                    size += len(held[-1][1])
                    have = Counter()
                    if size > most:
                        yield from out()
                        held, size = [], 0
                of = ordinals[lo]
                # No term goes over a line's end, so texts can be read as one.
                have.update(b"\n".join(b.column(1)[lo:hi].to_pylist()).translate(runs).split())
        if have:
            held.append((*terms(have), of))
        if held:
            yield from out()

    return run


def _term_merger():
    """Rows of TERM_LEAF from sorted rows (term, ordinals, counts); a file that was counted in stretches has several places."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(terms, group, o, n):
            order = np.lexsort((o, group))
            group, o, n = group[order], o[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (o[1:] != o[:-1]))))
            group, o, n = group[first], o[first], np.add.reduceat(n, first)
            sizes = np.bincount(group, minlength=len(terms))
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            offsets = pa.array(cuts.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (o, n)]
            return pa.RecordBatch.from_arrays([terms, pa.array(sizes), pa.array(np.add.reduceat(n, cuts[:-1])), *lists], ["term", "file_count", "total_count", "ordinals", "counts"])

        def last():
            o, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return out(pa.array([term], pa.string()), np.zeros(len(o), np.int64), o, n)

        term, held = None, []  # the last term's places, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            terms, o, n = b.column(0), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(pc.list_value_length(b.column(1)).to_numpy())))
            changed = pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(changed) + 1))  # the first row of each term
            edge = at[starts[1]] if len(starts) > 1 else len(o)
            if held and terms[0].as_py() != term:
                yield last()
                held = []
            term = terms[0].as_py()
            held.append((o[:edge], n[:edge]))
            if len(starts) > 1:
                yield last()
                tail = at[starts[-1]]
                if len(starts) > 2:
                    sizes = np.diff(at[starts[1:]])
                    yield out(terms.take(pa.array(starts[1:-1])), np.repeat(np.arange(len(sizes)), sizes), o[edge:tail], n[edge:tail])
                term, held = terms[int(starts[-1])].as_py(), [(o[tail:], n[tail:])]
        if held:
            yield last()

    return run


def term_dictionary(counts: DataFrame, where: str) -> DataFrame:
    """term, file_count, total_count, ordinals, counts (occurrences in each of them), from term_counts()."""
    per = counts.groupBy("term").agg(F.sort_array(F.collect_list(F.struct(F.col(where).alias("o"), F.col("occurrences").alias("n")))).alias("p"), F.sum("occurrences").alias("total"))
    return _posting(per, F.col("total"))


def _posting(per: DataFrame, total: Column | None = None) -> DataFrame:
    """term, file_count, total_count, ordinals and counts (of the same places) from sorted pairs p (o, n)."""
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]) if total is None else total
    return per.select("term", F.size("p").cast("long").alias("file_count"), total.alias("total_count"), F.col("p.o").alias("ordinals"), F.col("p.n").alias("counts"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two dictionaries over different files as one."""
    pairs = lambda d: d.select("term", F.zip_with("ordinals", "counts", lambda o, n: F.struct(o.alias("o"), n.alias("n"))).alias("p"))
    return _posting(pairs(old).unionByName(pairs(new)).groupBy("term").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p")))


def renumbered(postings: DataFrame, key: str, remap: DataFrame) -> DataFrame:
    """Postings (key, ordinals and, of terms, counts) under new ordinals; remap (old, new) holds the files that stay."""
    counted = "counts" in postings.columns
    each = F.zip_with("ordinals", "counts", lambda o, n: F.struct(o.alias("o"), n.alias("n"))) if counted else F.transform("ordinals", lambda o: F.struct(o.alias("o")))
    rows = postings.select(key, F.explode(each).alias("x")).select(key, "x.*").join(F.broadcast(remap), F.col("o") == F.col("old")).drop("o", "old").withColumnRenamed("new", "o")
    if counted:
        return _posting(rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "n"))).alias("p")))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("o")).alias("ordinals"))


def range_of(term: Column) -> Column:
    """The leaf of a term by its first sign: below 0 the first, above z the last, between two the lower."""
    first = F.substring(term, 1, 1)
    at = F.lit(0)
    for i, c in enumerate(RANGES):
        at = F.when(first >= c, i).otherwise(at)
    return at


def file_grams(df: DataFrame, where: str, c: Column, t: T.DataType, n: int = text.NGRAM) -> DataFrame:
    """where, gram: the distinct grams of each file."""
    own = F.filter(kinds.members(c, t), lambda x: x.isNotNull())
    return df.select(where, F.explode(F.array_distinct(F.flatten(F.transform(own, lambda x: text.grams(x, n))))).alias("gram")).distinct()


def distinct_grams(rows: DataFrame, t: T.DataType, n: int = text.NGRAM) -> DataFrame:
    """file_grams() of rows (ordinal, v)."""
    return gram_sets(rows, t, n).select("ordinal", F.explode("grams").alias("gram"))


GRAM_SET = "ordinal int, n long, signs long, grams array<string>"


def gram_sets(rows: DataFrame, t: T.DataType, n: int = text.NGRAM) -> DataFrame:
    """ordinal, n (distinct grams of the file), signs (distinct signs in them) and grams of rows (ordinal, v). Where
    grams are many, a file has several rows with some of its grams each. Texts' grams are gathered file by file as they come."""
    if not isinstance(t, T.StringType) or n != 3:  # three code points fit a 64-bit number
        sets = file_grams(rows, "ordinal", F.col("v"), t, n).groupBy(F.col("ordinal").cast("int").alias("ordinal")).agg(F.collect_list("gram").alias("grams"))
        signs = F.flatten(F.transform("grams", lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(g))), lambda i: F.substring(g, i, 1))))
        return sets.select("ordinal", F.size("grams").cast("long").alias("n"), F.size(F.array_distinct(signs)).cast("long").alias("signs"), "grams")
    low = rows.where(F.col("v").isNotNull()).select(F.col("ordinal").cast("int"), F.lower("v").alias("v"))
    told = _batched(low).mapInArrow(_gram_gatherer(), "ordinal int, codes binary, short array<string>")
    return told.repartition("ordinal").sortWithinPartitions("ordinal").mapInArrow(_gram_merger(), GRAM_SET)


def _unique(codes: list):
    import numpy as np

    a = np.sort(np.concatenate(codes)) if codes else np.empty(0, np.int64)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def _gram_gatherer():
    """Rows (ordinal, codes, short): codes of the distinct grams of a stretch of a file's rows, and the values of fewer signs."""
    most = HELD_SIGNS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ascii_ones = np.zeros(1 << 21, bool)  # which grams of three ASCII signs there are

        def out(of, codes, short):
            f = np.flatnonzero(ascii_ones)
            ascii_ones[f] = False
            a = np.concatenate((f >> 14 << 42 | (f >> 7 & 127) << 21 | f & 127, _unique(codes)))
            ready.append((of, a.tobytes(), sorted(short)))
            return len(a)

        def rows():
            cols = zip(*ready, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.list_(pa.string())), strict=True)], ["ordinal", "codes", "short"])

        ready, size = [], 0
        of, codes, short, held, seen = None, [], set(), 0, set()
        for b in batches:
            for o, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if o != of and of is not None:
                    size += out(of, codes, short)
                    codes, short, held, seen = [], set(), 0, set()
                    if size > SET:
                        yield rows()
                        ready, size = [], 0
                of = o
                if len(v) < 3:
                    short.add(v)
                    continue
                if len(v) < SHORT:
                    if v in seen:
                        continue
                    if len(seen) < KNOWN:
                        seen.add(v)
                if v.isascii():
                    a = np.frombuffer(v.encode(), np.uint8).astype(np.int32)
                    ascii_ones[a[:-2] << 14 | a[1:-1] << 7 | a[2:]] = True
                    continue
                a = np.frombuffer(v.encode("utf-32-le"), "<u4").astype(np.int64)
                plain = a[:-2] | a[1:-1] | a[2:]
                plain = plain < 128
                ascii_ones[(a[:-2] << 14 | a[1:-1] << 7 | a[2:])[plain]] = True
                codes.append((a[:-2] << 42 | a[1:-1] << 21 | a[2:])[~plain])
                held += len(codes[-1])
                if held > most:
                    codes = [_unique(codes)]
                    held = len(codes[0])
                    if held > most // 2:
                        size += out(of, codes, short)
                        codes, short, held = [], set(), 0
        if of is not None:
            out(of, codes, short)
            yield rows()

    return run


def _gram_merger():
    """Rows of GRAM_SET from rows of _gram_gatherer() that are sorted by file."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(of, codes, short):
            nonlocal size
            a, short = _unique(codes), sorted(short)
            places = np.stack((a >> 42, a >> 21 & 0x1FFFFF, a & 0x1FFFFF), axis=1).astype("<u4")
            few = {c for v in short for c in v or [v]}
            signs = len(few | {chr(c) for c in np.unique(places).tolist()})
            for lo in range(0, len(a), SET) or [0]:
                told = places[lo : lo + SET].tobytes().decode("utf-32-le")
                grams = [told[i : i + 3] for i in range(0, len(told), 3)] + (short if not lo else [])
                if grams:
                    ready.append((of, len(a) + len(short), signs, grams))
                    size += len(grams)
                    if size > SET:
                        yield from rows()

        def rows():
            nonlocal size
            if ready:
                cols = zip(*ready, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["ordinal", "n", "signs", "grams"])
            ready.clear()
            size = 0

        ready, size = [], 0
        of, codes, short = None, [], set()
        for b in batches:
            for o, c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if o != of and of is not None:
                    yield from out(of, codes, short)
                    codes, short = [], set()
                of = o
                codes.append(np.frombuffer(c, np.int64))
                short.update(v)
        if of is not None:
            yield from out(of, codes, short)
        yield from rows()

    return run


def saturated(n: Column, signs: Column, size: int = text.NGRAM) -> Column:
    """Whether a file has about all grams its alphabet allows."""
    return (n >= 256) & (2 * n >= F.pow(signs, F.lit(size)))


def gram_places(sets: DataFrame) -> DataFrame:
    """gram, ordinals of gram_sets(): several rows a gram, each with the places that a task has seen."""
    return _batched(sets.select("ordinal", "grams")).mapInArrow(_gram_dealer(), GRAM_LEAF)


def _gram_dealer():
    most = HELD_TERMS

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, size = [], 0

        def out():
            yield from _inverted(pa.concat_arrays([g for g, _ in held]), np.concatenate([o for _, o in held]), names=["gram", "ordinals"])

        for b in batches:
            grams = b.column(1).flatten()
            held.append((grams, np.repeat(b.column(0).to_numpy(), pc.list_value_length(b.column(1)).to_numpy())))
            size += len(grams)
            if size > most:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return run


def bloom_of(sets: DataFrame, fpp: float = 0.01) -> DataFrame:
    """bloom_words() of gram_sets()."""
    h = F.transform("grams", lambda g: F.xxhash64(g))
    step = F.transform("grams", lambda g: F.xxhash64(g, F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF)))
    told = _batched(sets.select("ordinal", "n", h.alias("h"), step.alias("g"))).mapInArrow(_bloom_filler(fpp), "ordinal int, m long, k int, word long, bits long")
    return told.groupBy("ordinal", "m", "k", "word").agg(F.bit_or("bits").alias("bits"))


def _bloom_filler(fpp: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = {"ordinal": np.int32, "m": np.int64, "k": np.int32, "word": np.int64, "bits": np.int64}

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready, strict=True)], list(kinds))
            ready.clear()

        ready = []
        for b in batches:
            hs, gs = b.column(2), b.column(3)
            for i, (o, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                m = math.ceil(-n * math.log(fpp) / math.log(2) ** 2 / 64) * 64
                k = min(8, max(1, math.floor(m / n * math.log(2) + 0.5)))
                h, g = hs[i].values.to_numpy(), gs[i].values.to_numpy()
                has = np.zeros(m, bool)
                for j in range(1, k + 1):
                    has[(h + j * g) % m] = True  # numbers wrap and the rest is not negative, as pmod
                words = np.packbits(has, bitorder="little").view("<i8")
                at = np.flatnonzero(words)
                ready.append([x if isinstance(x, np.ndarray) else np.full(len(at), x, t) for x, t in zip((o, m, k, at, words[at]), kinds.values(), strict=True)])
                if len(ready) >= 1000 or len(at) > SET:
                    yield from rows()
        if ready:
            yield from rows()

    return run


def gram_dictionary(pairs: DataFrame, where: str) -> DataFrame:
    return pairs.groupBy("gram").agg(F.sort_array(F.collect_set(where)).alias("ordinals"))


def gram_saturation(pairs: DataFrame, where: str, n: int = text.NGRAM) -> DataFrame:
    """where, grams, signs, saturated: whether a file has about all grams its alphabet allows."""
    # Signs are told apart as rows: sets of arrays would hold a file's grams as a whole.
    places = [F.substring("gram", 1, 1), *(F.when(F.length("gram") >= i, F.substring("gram", i, 1)) for i in range(2, n + 1))]
    signs = pairs.select(where, F.explode(F.array(*places)).alias("sign")).where(F.col("sign").isNotNull()).distinct().groupBy(where).agg(F.count("*").alias("signs"))
    per = pairs.groupBy(where).agg(F.count("*").alias("grams")).join(signs, where)
    return per.withColumn("saturated", saturated(F.col("grams"), F.col("signs"), n))


def bloom_bytes(pairs: int, fpp: float = 0.01) -> int:
    """What the filters of so many (file, gram) pairs take, all files together."""
    return math.ceil(-pairs * math.log(fpp) / math.log(2) ** 2 / 8)


def bloom_words(pairs: DataFrame, where: str, fpp: float = 0.01) -> DataFrame:
    """where, m, k, word, bits: each file's bloom filter of its grams, as 64-bit words."""
    n = pairs.groupBy(where).agg(F.count("*").alias("n"))
    bits = F.ceil(-F.col("n") * math.log(fpp) / math.log(2) ** 2 / 64) * 64
    sized = n.select(where, bits.cast("long").alias("m"), F.col("n")).withColumn("k", F.least(F.lit(8), F.greatest(F.lit(1), F.round(F.col("m") / F.col("n") * math.log(2)).cast("int"))))
    hashed = pairs.select(where, F.xxhash64("gram").alias("h"), F.xxhash64(F.col("gram"), F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF)).alias("g"))
    at = hashed.join(sized, where).select(where, "m", "k", F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.pmod(F.col("h") + i * F.col("g"), F.col("m")))).alias("at"))
    return at.groupBy(where, "m", "k", (F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))


def bloom_bit(gram: Column, i: Column, m: Column) -> Column:
    return F.pmod(F.xxhash64(gram) + i * F.xxhash64(gram, F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF)), m)


def bloom_might(words: DataFrame, where: str, grams: list[str]) -> DataFrame:
    """where, might: whether a file's filter has every gram."""
    shapes = words.select(where, "m", "k").distinct().withColumn("gram", F.explode(F.array(*map(F.lit, grams))))
    bits = shapes.select(where, F.explode(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: bloom_bit(F.col("gram"), i, F.col("m")))).alias("at"))
    bits = bits.select(where, (F.col("at") / 64).cast("long").alias("word"), (F.col("at") % 64).cast("int").alias("bit"))
    found = bits.join(words.select(where, "word", "bits"), [where, "word"], "left")
    has = F.coalesce(F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return found.groupBy(where).agg(F.bool_and(has).alias("might"))
