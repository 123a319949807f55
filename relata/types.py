"""Types: headings over Spark types, defaults in place of nulls, text forms.

All numeric Spark types are one type, number. There is no null: each type has a default, which takes
a null's place on ingest.
"""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attributes keep at most this scale; 37 digits leave room for a carry.
SCALE, DIGITS = 10, 37
ZERO_TIME = datetime.datetime(1, 1, 1)


class RelationError(Exception):
    """A program that breaks the algebra's rules: unknown or duplicate attributes, types that differ."""


def kind(t: T.DataType) -> str:
    """The logical type's name: number, text, bool, time, date, binary, tuple, relation."""
    if isinstance(t, T.NumericType):
        return "number"
    names = {T.StringType: "text", T.BooleanType: "bool", T.TimestampNTZType: "time", T.TimestampType: "time", T.DateType: "date", T.BinaryType: "binary", T.StructType: "tuple", T.ArrayType: "relation"}
    for spark_type, name in names.items():
        if isinstance(t, spark_type):
            return name
    raise RelationError(f"no attribute can have the type {t.simpleString()}")


def signature(t: T.DataType) -> object:
    """What two attributes of one name must share: kinds, with headings compared as sets."""
    if isinstance(t, T.StructType):
        return ("tuple", frozenset((f.name, signature(f.dataType)) for f in t))
    if isinstance(t, T.ArrayType):
        return ("relation", signature(t.elementType))
    return kind(t)


def default_value(t: T.DataType) -> object:
    """A type's default as a Python value."""
    return {"number": Decimal(0), "text": "", "bool": False, "time": ZERO_TIME, "date": ZERO_TIME.date(), "binary": b"", "relation": [], "tuple": {}}[kind(t)]


def default(t: T.DataType) -> Column:
    """A type's default as a Column of just that type."""
    k = kind(t)
    if k == "tuple":
        return F.struct(*(default(f.dataType).alias(f.name) for f in t.fields)).cast(t)
    if k == "relation":
        return F.array().cast(t)
    if k in ("time", "date"):
        return F.lit("0001-01-01").cast(t)
    return F.lit({"number": 0, "text": "", "bool": False, "binary": b""}[k]).cast(t)


def filled(c: Column, t: T.DataType) -> Column:
    """c with defaults for nulls, relation values in canonical form (distinct, sorted)."""
    if isinstance(t, T.ArrayType):
        c = F.array_sort(F.array_distinct(c))
    return F.coalesce(c, default(t))


def stored(t: T.DataType) -> T.DataType:
    """The type an attribute takes: decimals at 37 digits and at most scale 10, text times without zone."""
    if isinstance(t, T.DecimalType):
        return T.DecimalType(DIGITS, min(t.scale, SCALE))
    if isinstance(t, T.TimestampType):
        return T.TimestampNTZType()
    return t


def text_form(c: Column, t: T.DataType) -> Column:
    k = kind(t)
    if k == "text":
        return c
    if k == "number":
        s = c.cast(T.DecimalType(38, 15)).cast("string") if isinstance(t, T.DoubleType | T.FloatType) else c.cast("string")
        return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if k == "bool":
        return F.when(c, "true").otherwise("false")
    if k == "binary":
        return F.left(F.lower(F.hex(c)), F.lit(50))
    if k == "date":
        return F.date_format(c, "dd/MM/yyyy")
    if k == "time":
        midnight = F.date_trunc("day", c) == c
        return F.when(midnight, F.date_format(c, "dd/MM/yyyy")).otherwise(F.date_format(c, "dd/MM/yyyy h:mm a"))
    return F.to_json(c)
