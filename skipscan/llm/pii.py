"""Pseudonyms that keep their format, by a keyed Feistel permutation.

Found and validated: cards (Luhn), IBANs (mod 97), social security numbers,
telephone numbers, IPv4 addresses, calendar dates from 1900 to 2099, e-mail
addresses and secrets. Each value is a number below the count of its format's
values; a balanced Feistel network over the next even power of two, walked until
it falls below that count again, permutes it. The key and the kind alone choose
the permutation and not the separators, so equal values get equal pseudonyms in
all documents, different ones different pseudonyms, and a holder of the key can
undo them. A value may be followed by other digits or capitals: where the longest
match fails validation, shorter ends at spaces are tried, then the other kinds, then
later starts. What fails validation throughout is left as it is.

Edge cases: a null text stays null, an empty one empty; repeated rows get the
same result each; a value inside a longer word or number is not one; the longest
kind at a place wins, in the order of KINDS; other columns are not looked at. A date's
field of one digit stays one digit, so a date written with zeros has another
pseudonym than without. A card in unusual groups, with a usual form at its start, may
get a pseudonym whose start is valid by itself; undoing the text then misses it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.llm.common import batch_of, small_batches, table

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days

#: How a value of each kind looks, the first kinds first; the value is the group of that name.
FORMS = {
    "email": r"(?P<email>(?<!%)[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![\w-])",
    "iban": r"(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30})(?!\w)",
    "date": r"(?P<date>\d{4}(?P<by>[-/.])\d{1,2}(?P=by)\d{1,2}|\d{1,2}(?P<of>[-/.])\d{1,2}(?P=of)\d{4})(?:(?=T\d)|(?!\w))",
    "ssn": r"(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])",
    "ip": r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)",
    "card": r"(?P<card>\d(?:[ -]?\d){12,18})(?![\w]|-\d)",
    "phone": r"(?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|-\d)",
    "secret": r"(?P<secret>(?:AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[abp])[-_][A-Za-z0-9_-]{16,}))(?![\w])",
    "assigned": r"(?i:(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd)[\"']?\s*+[=:]\s*+[\"']?)(?P<assigned>[A-Za-z0-9+/_-]{8,}={0,2})",
}
PATTERN = re.compile(rf"(?<![\w.+-])(?:{'|'.join(FORMS.values())})")
KINDS = tuple(FORMS)
OWN = {kind: re.compile(form) for kind, form in FORMS.items()}

#: Groups of digits in which cards are written, besides one group.
CARD_GROUPS = ((4, 6, 4), (4, 6, 5), (4, 4, 4, 4), (4, 4, 4, 4, 3))
#: Signs of an IBAN, by country.
IBAN_SIGNS = {country: int(n) for n, own in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,TL,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
    "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
).split()) for country in own.split(",")}


class Permuter:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def number(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """The place of x under the permutation of 0..size-1 that key and tweak choose."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, told = (1 << half) - 1, f"{tweak}:{size}".encode()
        wide = (half + 7) // 8
        while True:
            left, right = x >> half, x & mask
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                own = left if back else right
                f = int.from_bytes(hashlib.blake2b(r.to_bytes(1, "big") + own.to_bytes(wide, "big") + told, key=self.key, digest_size=min(64, wide + 8)).digest(), "big") & mask
                left, right = (right ^ f, left) if back else (right, left ^ f)
            x = left << half | right
            if x < size:
                return x

    def text(self, s: str, tweak: str, back: bool = False, hexes: bool = False) -> str:
        """s with its ASCII letters and digits permuted, each within its class; all others stay.

        With hexes, a long run of hexadecimal digits that has letters is of one class,
        and stays so: the permutation is walked until its value is of that kind again."""
        classes = _classes(s, hexes)
        at, size, x, shape = [], 1, 0, ""
        for i, c in enumerate(s):
            for k, signs in enumerate(classes):
                if c in signs:
                    at.append((i, signs))
                    x, size, shape = x * len(signs) + signs.index(c), size * len(signs), shape + str(k)
                    break
        if size == 1:
            return s
        while True:
            x, out = self.number(x, size, f"{tweak}/{len(classes)}/{shape}", back), list(s)
            rest = x
            for i, signs in reversed(at):
                rest, d = divmod(rest, len(signs))
                out[i] = signs[d]
            if _classes(made := "".join(out), hexes) == classes:
                return made


def _classes(s: str, hexes: bool) -> tuple[str, ...]:
    """The classes of signs in which s is permuted."""
    if hexes and len(own := {c for c in s if c.isascii() and c.isalnum()}) and sum(c in own for c in s) >= 16:
        for letters in ("abcdef", "ABCDEF"):
            if own <= set(DIGITS + letters) and own & set(letters):
                return (DIGITS + letters,)
    return DIGITS, LOWER, UPPER


def luhn(digits: str) -> int:
    """What the check digit after these digits must be."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _refill(shape: str, signs: str) -> str:
    """shape with its letters and digits replaced in turn."""
    it = iter(signs)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _only(s: str) -> str:
    return "".join(c for c in s if c.isalnum())


def _card(p: Permuter, s: str, back: bool) -> str | None:
    d = _only(s)
    if str(luhn(d[:-1])) != d[-1] or len(set(d)) == 1:
        return None
    while len(set(d := (body := p.text(d[:-1], "card", back)) + str(luhn(body)))) == 1:
        pass
    return _refill(s, d)


def _iban(p: Permuter, s: str, back: bool) -> str | None:
    d = _only(s)
    country, check, rest = d[:2], d[2:4], d[4:]
    if iban_check(country, rest) != check:
        return None
    rest = p.text(rest, f"iban{country}", back)
    return _refill(s, country + iban_check(country, rest) + rest)


def _ssn(p: Permuter, s: str, back: bool) -> str | None:
    good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = _only(s)
    if not good(d):
        return None
    while not good(d := p.text(d, "ssn", back)):
        pass
    return _refill(s, d)


def _phone(p: Permuter, s: str, back: bool) -> str | None:
    d = _only(s)
    keep = 1 if s[0] == "+" else 0
    if not 9 <= len(d) <= 15:
        return None
    return _refill(s, d[:keep] + p.text(d[keep:], "phone", back))


def _ip(p: Permuter, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in parts):
        return None
    x = p.number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(p: Permuter, s: str, back: bool) -> str | None:
    sep = next(c for c in s if not c.isdigit())
    a, b, c = s.split(sep)
    # year first; else day first, unless only month first is a date
    orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy") if sep != "/" else ("mdy", "dmy")
    for order in orders:
        own = dict(zip(order, map(int, (a, b, c)), strict=True))
        try:
            day = (datetime.date(own["y"], own["m"], own["d"]) - FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None
        wide = dict(zip(order, map(len, (a, b, c)), strict=True))
        while True:
            day = p.number(day, DAYS, "date", back)
            to = FIRST_DAY + datetime.timedelta(day)
            made = sep.join(f"{ {'y': to.year, 'm': to.month, 'd': to.day}[o]:0{wide[o]}d}" for o in order)
            # A field of one digit stays one.
            if len(made) == len(s) and (order == "ymd" or _order_of(made, sep, orders) == order):
                return made
    return None


def _order_of(s: str, sep: str, orders: tuple[str, ...]) -> str | None:
    """The order in which s would be read."""
    for order in orders:
        own = dict(zip(order, map(int, s.split(sep)), strict=True))
        try:
            datetime.date(own["y"], own["m"], own["d"])
            return order
        except ValueError:
            continue
    return None


def _email(p: Permuter, s: str, back: bool) -> str | None:
    local, _, domain = s.partition("@")
    host, _, rest = domain.partition(".")
    # The registrable end of the domain stays.
    if "." in rest:
        both = p.text(f"{local}@{host}", "email", back)
        return f"{both}.{rest}"
    return f"{p.text(local, 'email', back)}@{domain}"


REPLACERS: dict[str, Callable[[Permuter, str, bool], str | None]] = {
    "email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone,
    "secret": lambda p, s, back: s[:4] + p.text(s[4:], "secret", back, True), "assigned": lambda p, s, back: p.text(s, "assigned", back, True),
}

HINT = re.compile(r"[\d@]|(?i:token|secret|passw|pwd|key)")


def replaced(text: str, permuter: Permuter, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms (or with back, the values again), and how many of each kind."""
    counts: dict[str, int] = {}
    if not HINT.search(text):
        return text, counts

    out, at, start = [], 0, 0
    while m := PATTERN.search(text, start):
        if (value := _value(text, m, permuter, back)) is None:
            start = m.start() + 1
            continue
        kind, begin, end, made = value
        counts[kind] = counts.get(kind, 0) + 1
        out += text[at:begin], made
        at = start = end
    return "".join(out) + text[at:], counts


def _value(text: str, m: re.Match, permuter: Permuter, back: bool) -> tuple[str, int, int, str] | None:
    """(kind, start, end, pseudonym) of the valid value that begins where m does, if there is one."""
    for kind in KINDS[next(i for i, k in enumerate(KINDS) if m[k] is not None) :]:
        if own := OWN[kind].match(text, m.start()):
            begin = own.start(kind)
            for end in _ends(kind, text, begin, own.end(kind)):
                if (made := REPLACERS[kind](permuter, text[begin:end], back)) is not None:
                    return kind, begin, end, made
    return None


def _ends(kind: str, text: str, begin: int, longest: int) -> list[int]:
    """Where the value may end, in the order to be tried: what has the usual form first, as
    more may follow after a space, then the longest first."""
    if kind not in ("iban", "card", "phone"):
        return [longest]
    ends = [longest] + [e for e in range(longest - 1, begin, -1) if text[e] == " " and OWN[kind].fullmatch(text, begin, e)]
    if kind == "iban":
        ends.sort(key=lambda e: len(_only(text[begin:e])) != IBAN_SIGNS.get(text[begin : begin + 2]))
    elif kind == "card":
        groups = {e: tuple(map(len, re.split("[ -]", text[begin:e]))) for e in ends}
        usual = [e for e in ends if len(groups[e]) == 1 or groups[e] in CARD_GROUPS]
        ends = usual[::-1] + [e for e in ends if e not in usual]
    return ends


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_replaced and kinds (map) for each row of docs."""
    if not key:
        raise ValueError("a key is needed")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuter = Permuter(key)
        for b in batches:
            out = [(None, {}) if not t.is_valid else replaced(t.as_py(), permuter) for t in b.column("text")]
            texts, counts = pa.array([t for t, _ in out], pa.string()), [list(c.items()) for _, c in out]
            n = pa.array([sum(c.values()) for _, c in out], pa.int64())
            yield batch_of(doc_id=b.column("doc_id"), text=texts, n_replaced=n, kinds=pa.array(counts, pa.map_(pa.string(), pa.int64())))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, n_replaced long, kinds map<string,long>")


def op1(spark, sf_dir: str) -> DataFrame:
    """The key here is an example; a caller of pseudonyms() brings a secret one."""
    return pseudonyms(table(spark, sf_dir, "documents"), b"example key of the registered query").select("doc_id", "text", "n_replaced")
