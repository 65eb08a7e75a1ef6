"""Text analysis as Column expressions, and the same rules for literals on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CAP = 256
#: Contracts of terms: tokens are pieces and compounds, pieces leave compounds out, short-pieces long numbers too.
ANALYZERS = ("tokens", "pieces", "short-pieces", "value")
SHORT_NUMBER = 4
LONG_NUMBER = f"[0-9]{{{SHORT_NUMBER + 1},}}"
NGRAM = 3

PIECE, RUN, EDGE = "[a-z0-9]+", "[a-z0-9.:_-]+", "[.:_-]"
IPV4 = r"[0-9]{1,3}(\.[0-9]{1,3}){3}"
HEX = r"[0-9a-f]+([-_][0-9a-f]+)+"  # UUIDs are of this shape
#: A run without its edges, where it has signs between pieces; what is no such run is no compound.
JOINED = "(?<![a-z0-9])[a-z0-9]++(?:[.:_-]++[a-z0-9]++)++"
COMPOUND = rf"^({IPV4}|{HEX})$"


def ascii_lower(c: Column) -> Column:
    """Folds A-Z alone: lower() would also map signs such as the Kelvin sign to ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def utf16_length(c: Column) -> Column:
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def _is_ipv6(x: Column) -> Column:
    colons = F.length(x) - F.length(F.replace(x, F.lit(":")))
    pairs = F.length(x) - F.length(F.replace(x, F.lit("::")))
    return x.rlike("^[0-9a-f:]+$") & colons.between(2, 7) & ~x.contains(":::") & (pairs <= 2) & x.rlike("[0-9]") & ~x.rlike("[0-9a-f]{5}")


def is_compound(x: Column) -> Column:
    return x.rlike(COMPOUND) | _is_ipv6(x)


def pieces(c: Column) -> Column:
    """ASCII-folded runs of letters and digits, repeated ones too."""
    return F.regexp_extract_all(ascii_lower(c), F.lit(PIECE), F.lit(0))


def compounds(c: Column) -> Column:
    """Addresses and ids of several pieces, whole."""
    return F.filter(F.regexp_extract_all(ascii_lower(c), F.lit(JOINED), F.lit(0)), is_compound)


def tokens(c: Column, cap: int = CAP) -> Column:
    """Pieces, then compounds; those of more than cap signs are left out."""
    return F.filter(F.concat(pieces(c), compounds(c)), lambda t: F.length(t) <= cap)


def short_pieces(c: Column, cap: int = CAP) -> Column:
    """Pieces without numbers of more than SHORT_NUMBER digits."""
    return F.filter(pieces(c), lambda t: (F.length(t) <= cap) & ~t.rlike(f"^{LONG_NUMBER}$"))


def value_terms(c: Column, cap: int = CAP) -> Column:
    """The whole canonical value as the one term; an empty or too long one gives none."""
    return F.filter(F.array(c), lambda t: t.isNotNull() & (t != "") & (F.length(t) <= cap))


def grams(c: Column, n: int = NGRAM) -> Column:
    """Distinct windows of n code points of the lowered value; a shorter value is its own gram."""
    low = F.lower(c)
    # One linear pass for each of the n places at which a cut into n can start.
    cuts = [F.regexp_extract_all(F.substring(low, k, F.length(low)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for k in map(F.lit, range(1, n + 1))]
    return F.array_distinct(F.when(F.length(low) < n, F.array(low)).otherwise(F.concat(*cuts)))


def tokens_of(text: str) -> list[str]:
    """tokens() of a literal."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    whole = [r for r in (x.strip(".:_-") for x in re.findall(RUN, low)) if is_compound_text(r)]
    return re.findall(PIECE, low) + whole


def is_compound_text(r: str) -> bool:
    if re.fullmatch(f"{IPV4}|{HEX}", r):
        return True
    return bool(re.fullmatch("[0-9a-f:]+", r)) and 2 <= r.count(":") <= 7 and ":::" not in r and r.count("::") <= 1 and any(c.isdigit() for c in r) and not re.search("[0-9a-f]{5}", r)


def query_terms(text: str, analyzer: str = "tokens") -> list[str]:
    """Terms that a value must hold to match: compounds, and pieces outside them; without compounds, all pieces."""
    low, out = text.translate(str.maketrans(UPPER, LOWER)), []
    if analyzer == "value":
        return [text]
    if analyzer != "tokens":
        return list(dict.fromkeys(re.findall(PIECE, low)))
    for r in re.findall(RUN, low):
        bare = r.strip(".:_-")
        out += [bare] if is_compound_text(bare) else re.findall(PIECE, r)
    return list(dict.fromkeys(out))


def indexable(term: str, cap: int = CAP, analyzer: str = "tokens") -> bool:
    if analyzer == "short-pieces" and re.fullmatch(LONG_NUMBER, term):
        return False
    return 0 < len(term.encode("utf-16-le")) // 2 <= cap


def prefixable(term: str, analyzer: str) -> bool:
    """Whether the dictionary has all terms that start so; where long numbers are left out, no digits alone do."""
    if analyzer == "value":
        return bool(term)
    if analyzer == "short-pieces" and term.isdigit():
        return False
    return bool(re.fullmatch("[a-z0-9.:_-]+" if analyzer == "tokens" else PIECE, term))


def grams_of(text: str, n: int = NGRAM) -> list[str]:
    low = text.lower()
    return [low] if len(low) < n else list(dict.fromkeys(low[i : i + n] for i in range(len(low) - n + 1)))


def lowered_variants(text: str) -> list[str]:
    """What the literal can look like inside a lowered value: a final sigma depends on its neighbours."""
    low = text.lower()
    around = {low, ("α" + text).lower()[1:], (text + "α").lower()[:-1], ("α" + text + "α").lower()[1:-1]}
    return sorted(around)


def match_pattern(term: str) -> str:
    """A pattern that finds the term as a token in ASCII-folded text."""
    return f"(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)"


# Row semantics of the hints. What can be said of pieces is asked of the text itself: (?i) folds A-Z alone, as
# ascii_lower() does, and a pattern that begins with plain signs is tried where these stand.
def _has_piece(c: Column, start: str, rest: str = "") -> Column:
    """Whether a text has a piece that is `start` and, after it, what the pattern `rest` takes."""
    return c.rlike(f"(?i){start}(?<![a-z0-9]{start}){rest}(?![a-z0-9])")


def match(c: Column, text: str) -> Column:
    have = tokens(c)
    terms = query_terms(text)
    if not terms:
        raise ValueError("nothing to match")
    out = F.lit(True)
    for t in terms:
        if re.fullmatch(PIECE, t) and len(t) <= CAP:
            out = out & _has_piece(c, t)
        else:
            out = out & c.rlike(f"(?i){re.escape(t)}") & F.array_contains(have, t)
    return F.coalesce(out, F.lit(False))


def contains_ci(c: Column, text: str) -> Column:
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def match_prefix(c: Column, prefix: str) -> Column:
    low = prefix.translate(str.maketrans(UPPER, LOWER))
    if re.fullmatch(PIECE, low) and len(low) <= CAP:
        # A compound that starts so has a piece that does.
        return F.coalesce(_has_piece(c, low, f"[a-z0-9]{{0,{CAP - len(low)}}}+"), F.lit(False))
    return F.coalesce(F.exists(tokens(c), lambda t: t.startswith(low)), F.lit(False))
