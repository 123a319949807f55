"""Scalar functions as Columns. Names follow the language; all are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds from the year 1 to 1970.
EPOCH = 62135596800


def _c(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- numbers ---


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def div(a: Column, b: object) -> Column:
    """Both truncated, divided, truncated: -7 div 2 = -3."""
    return F.call_function("div", truncated(_c(a)), truncated(_c(b)))


def mod(a: Column, b: object) -> Column:
    """Remainder of the truncated numbers with the dividend's sign."""
    return truncated(_c(a)) % truncated(_c(b))


def power(a: Column, b: object) -> Column:
    return F.pow(_c(a).cast("double"), _c(b).cast("double"))


def bit_and(a: Column, b: object) -> Column:
    return _c(a).cast("long").bitwiseAND(_c(b).cast("long"))


def bit_or(a: Column, b: object) -> Column:
    return _c(a).cast("long").bitwiseOR(_c(b).cast("long"))


def bit_xor(a: Column, b: object) -> Column:
    return _c(a).cast("long").bitwiseXOR(_c(b).cast("long"))


def bit_not(a: Column) -> Column:
    return F.bitwise_not(_c(a).cast("long"))


def larger(a: Column, b: object) -> Column:
    return F.greatest(_c(a), _c(b))


def smaller(a: Column, b: object) -> Column:
    return F.least(_c(a), _c(b))


# --- text ---


def trim(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def left(s: Column, n: object) -> Column:
    """n characters from the left, filled up with blanks on the right."""
    n = _c(n).cast("int")
    return F.when(n < 0, "").otherwise(F.rpad(_c(s), n, F.lit(" ")))


def right(s: Column, n: object) -> Column:
    """n characters from the right, filled up with blanks on the left."""
    s, n = _c(s), _c(n).cast("int")
    return F.when(n <= 0, "").when(n >= F.char_length(s), F.lpad(s, n, F.lit(" "))).otherwise(F.right(s, n))


def fill(s: Column, n: object) -> Column:
    """s again and again, cut to n characters."""
    s, n = _c(s), _c(n).cast("int")
    return F.when((n <= 0) | (F.char_length(s) == 0), "").otherwise(F.left(F.repeat(s, F.ceil(n / F.char_length(s)).cast("int")), n))


def before(s: Column, x: object) -> Column:
    """The part before the first x, or all of it."""
    s, x = _c(s), _c(x)
    at = F.call_function("locate", x, s)
    return F.when(at == 0, s).otherwise(F.left(s, at - 1))


def after(s: Column, x: object) -> Column:
    """The part after the first x, or nothing."""
    s, x = _c(s), _c(x)
    at = F.call_function("locate", x, s)
    return F.when(at == 0, "").otherwise(F.substring(s, at + F.char_length(x), F.char_length(s)))


def matches(s: Column, pattern: object) -> Column:
    return F.call_function("rlike", _c(s), _c(pattern))


def length(s: Column) -> Column:
    return F.char_length(_c(s))


# --- binary ---


def zero_bytes(n: object) -> Column:
    return F.unhex(F.repeat(F.lit("00"), _c(n).cast("int")))


def blength(b: Column) -> Column:
    return F.octet_length(_c(b))


def bget(b: Column, i: object) -> Column:
    """The byte at place i, from 0."""
    return F.conv(F.hex(F.call_function("substring", _c(b), _c(i).cast("int") + 1, F.lit(1))), 16, 10).cast("long")


def bset(b: Column, i: object, value: object) -> Column:
    """b with the byte at place i replaced."""
    one = F.unhex(F.lpad(F.hex(_c(value).cast("long")), 2, "0"))
    return F.overlay(_c(b), one, _c(i).cast("int") + 1, F.lit(1))


# --- dates and times ---


def number_of_time(t: Column) -> Column:
    """Seconds since the year 1."""
    return F.unix_micros(F.to_timestamp(_c(t))).cast(T.DecimalType(37, 0)) / 1_000_000 + EPOCH


def dow(d: Column) -> Column:
    """Day of the week, Sunday 0."""
    return F.dayofweek(_c(d)) - 1


def daysdiff(a: Column, b: Column) -> Column:
    return F.date_diff(_c(a), _c(b))


def dateymd(y: object, m: object, d: object) -> Column:
    return F.make_date(_c(y).cast("int"), _c(m).cast("int"), _c(d).cast("int"))


# --- conversion and control ---


def bool_of_text(s: Column) -> Column:
    low = F.lower(trim(s))
    return F.when(low == "true", True).when(low == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a bool: "), _c(s))).cast("boolean"))


def number_of_text(s: Column, scale: int = 10) -> Column:
    return trim(_c(s)).cast(T.DecimalType(37, scale))


def choose(condition: Column, a: object, b: object) -> Column:
    return F.when(condition, _c(a)).otherwise(_c(b))
