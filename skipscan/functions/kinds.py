"""Canonical string forms of values, for columns and for literals."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INTEGRAL, DECIMAL, BINARY, FLOATING, BOOLEAN, DATE, TIMESTAMP, TIMESTAMPTZ, OTHER = "string integral decimal binary floating boolean date timestamp timestamptz other".split()
INDEXABLE = {STRING, INTEGRAL, DECIMAL, BINARY}


class NotIndexable(ValueError):
    pass


def kind_of(t: T.DataType) -> tuple[str, str]:
    """(scalar, list or map; kind of the value or of its members)."""
    if isinstance(t, T.ArrayType):
        return "list", _scalar(t.elementType)
    if isinstance(t, T.MapType):
        return "map", _scalar(t.valueType)
    return "scalar", _scalar(t)


def _scalar(t: T.DataType) -> str:
    for cls, kind in (
        ((T.StringType,), STRING), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), INTEGRAL), ((T.DecimalType,), DECIMAL), ((T.BinaryType,), BINARY),
        ((T.FloatType, T.DoubleType), FLOATING), ((T.BooleanType,), BOOLEAN), ((T.DateType,), DATE), ((T.TimestampNTZType,), TIMESTAMP), ((T.TimestampType,), TIMESTAMPTZ),
    ):
        if isinstance(t, cls):
            return kind
    return OTHER


def field_type(schema: T.StructType, path: str) -> T.DataType:
    """The type at a dotted path; every ancestor must be a struct."""
    t: T.DataType = schema
    for part in path.split("."):
        if not isinstance(t, T.StructType) or part not in t.names:
            raise NotIndexable(f"{path}: no such column, or a path through a container")
        t = t[part].dataType
    return t


def canonical(c: Column, kind: str) -> Column:
    if kind == DECIMAL:
        text = c.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if kind == BINARY:
        return F.lower(F.hex(c))
    if kind == TIMESTAMP:
        return F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
    return c.cast("string")


def canonical_literal(value, kind: str) -> str | None:
    """None: no form, so the predicate is not for the index and every file stays."""
    if value is None:
        return None
    if kind == STRING:
        return str(value)
    try:
        if kind == INTEGRAL:
            n = int(str(value).strip())
            return str(n) if -(2**63) <= n < 2**63 else None
        if kind == DECIMAL:
            d = format(Decimal(str(value).strip()).normalize(), "f")
            return "0" if d in ("-0", "0") else d
    except (ValueError, InvalidOperation):
        return None
    if kind == BINARY:
        return value.hex() if isinstance(value, (bytes, bytearray)) else None
    return None


def members(c: Column, t: T.DataType) -> Column:
    """The canonical forms of a value's members: of itself, of a list, of a map's values."""
    shape, kind = kind_of(t)
    if kind not in INDEXABLE:
        raise NotIndexable(f"{t.simpleString()} has no canonical form")
    if shape == "scalar":
        return F.array(canonical(c, kind))
    return F.transform(c if shape == "list" else F.map_values(c), lambda x: canonical(x, kind))
