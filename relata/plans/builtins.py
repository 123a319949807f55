"""The language's functions on scalars: a Python form for values, a Column form for attributes.

An entry is (argument types, result type, Python form, Column form). None as an argument type takes
anything; "same" asks for the type of the first argument, "ordered" for a type with an order.
"""

from __future__ import annotations

import datetime
import re
from decimal import Decimal

from pyspark.sql import functions as F

from relata.functions import scalar as fn
from relata.plans.values import CONTEXT, Tup, digits, quoted_form, same, text
from relata.types import RelationError

N, TX, B, TM, D, BI = "number", "text", "bool", "time", "date", "binary"
EPOCH = datetime.datetime(1, 1, 1)


def _int(x: Decimal) -> int:
    return int(Decimal(x))


def _text_column(tag: object):
    if tag == N:
        return lambda c: F.regexp_replace(F.regexp_replace(c.cast("decimal(37,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if tag == B:
        return lambda c: F.when(c, "true").otherwise("false")
    if tag == BI:
        return lambda c: F.left(F.lower(F.hex(c)), F.lit(50))
    if tag == D:
        return lambda c: F.date_format(c, "dd/MM/yyyy")
    if tag == TM:
        return lambda c: F.when(F.date_trunc("day", c) == c, F.date_format(c, "dd/MM/yyyy")).otherwise(F.date_format(c, "dd/MM/yyyy h:mm a"))
    return (lambda c: c) if tag == TX else F.to_json


def text_column(c, tag):
    return _text_column(tag)(c)


def _less(a: object, b: object) -> bool:
    if isinstance(a, Tup):
        return list(a.fields.values()) < list(b.fields.values())
    return a < b


def _left(s, n):
    n = _int(n)
    return s[:n].ljust(n) if n >= 0 else ""


def _right(s, n):
    n = _int(n)
    return "" if n <= 0 else s[-n:].rjust(n)


def _fill(s, n):
    n = _int(n)
    return (s * (n // len(s) + 1))[:n] if s and n > 0 else ""


def _bool(s):
    if s.strip().lower() not in ("true", "false"):
        raise RelationError(f"not a bool: {s}")
    return s.strip().lower() == "true"


def _number(s):
    try:
        return digits(Decimal(s.strip()))
    except ArithmeticError:
        raise RelationError(f"not a number: {s}") from None


def time_of(s: str) -> datetime.datetime:
    """ISO dates, or day/month/year; with a time, or a time alone."""
    s = s.strip()
    for form in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%H:%M:%S", "%H:%M"):
        try:
            out = datetime.datetime.strptime(s[:26] if "." in s else s, form)
            return out.replace(year=1, month=1, day=1) if form.startswith("%H") else out
        except ValueError:
            continue
    raise RelationError(f"not a time: {s}")


def _bset(b, i, v):
    i = _int(i)
    return b[:i] + bytes([_int(v)]) + b[i + 1 :]


def _weekday(d):
    return Decimal((d.weekday() + 1) % 7)


def _part(name):
    return lambda d: Decimal(getattr(d, name))


FUNCTIONS: dict[str, list[tuple]] = {
    "neg": [((N,), N, lambda a: digits(-a), lambda a: -a)],
    "+": [((N, N), N, CONTEXT.add, lambda a, b: a + b)],
    "-": [((N, N), N, CONTEXT.subtract, lambda a, b: a - b), ((N,), N, lambda a: -a, lambda a: -a)],
    "*": [((N, N), N, CONTEXT.multiply, lambda a, b: a * b)],
    "/": [((N, N), N, CONTEXT.divide, lambda a, b: a / b)],
    "div": [((N, N), N, lambda a, b: Decimal(int(Decimal(_int(a)) / Decimal(_int(b)))), fn.div)],
    "mod": [((N, N), N, lambda a, b: Decimal(_int(a)) % Decimal(_int(b)), fn.mod)],
    "**": [((N, N), N, lambda a, b: digits(Decimal(repr(float(a) ** float(b)))), fn.power)],
    "max": [(("ordered", "same"), "first", lambda a, b: b if _less(a, b) else a, F.greatest)],
    "min": [(("ordered", "same"), "first", lambda a, b: a if _less(a, b) else b, F.least)],
    "not": [((B,), B, lambda a: not a, lambda a: ~a)],
    "and": [((B, B), B, lambda a, b: a and b, lambda a, b: a & b), ((N, N), N, lambda a, b: Decimal(_int(a) & _int(b)), fn.bit_and)],
    "or": [((B, B), B, lambda a, b: a or b, lambda a, b: a | b), ((N, N), N, lambda a, b: Decimal(_int(a) | _int(b)), fn.bit_or)],
    "xor": [((B, B), B, lambda a, b: a != b, lambda a, b: a != b), ((N, N), N, lambda a, b: Decimal(_int(a) ^ _int(b)), fn.bit_xor)],
    "bitnot": [((N,), N, lambda a: Decimal(~_int(a)), fn.bit_not)],
    "=": [((None, "same"), B, same, lambda a, b: a == b)],
    "<>": [((None, "same"), B, lambda a, b: not same(a, b), lambda a, b: a != b)],
    "<": [(("ordered", "same"), B, _less, lambda a, b: a < b)],
    ">": [(("ordered", "same"), B, lambda a, b: _less(b, a), lambda a, b: a > b)],
    "<=": [(("ordered", "same"), B, lambda a, b: not _less(b, a), lambda a, b: a <= b)],
    ">=": [(("ordered", "same"), B, lambda a, b: not _less(a, b), lambda a, b: a >= b)],
    "=~": [((TX, TX), B, lambda a, b: re.search(b, a) is not None, fn.matches)],
    "length": [((TX,), N, lambda s: Decimal(len(s)), fn.length)],
    "trim": [((TX,), TX, str.strip, fn.trim)],
    "left": [((TX, N), TX, _left, fn.left)],
    "right": [((TX, N), TX, _right, fn.right)],
    "fill": [((TX, N), TX, _fill, fn.fill)],
    "before": [((TX, TX), TX, lambda s, x: s.split(x, 1)[0] if x else s, fn.before)],
    "after": [((TX, TX), TX, lambda s, x: s.split(x, 1)[1] if x and x in s else "", fn.after)],
    "toupper": [((TX,), TX, str.upper, F.upper)],
    "tolower": [((TX,), TX, str.lower, F.lower)],
    "number": [((TX,), N, _number, fn.number_of_text), ((TM,), N, lambda t: digits(Decimal((t - EPOCH) // datetime.timedelta(microseconds=1)) / 1_000_000), fn.number_of_time), ((N,), N, lambda n: n, lambda c: c)],
    "bool": [((TX,), B, _bool, fn.bool_of_text)],
    "time": [((TX,), TM, time_of, lambda c: F.to_timestamp_ntz(c)), ((D,), TM, lambda d: datetime.datetime(d.year, d.month, d.day), lambda c: c.cast("timestamp_ntz"))],
    "date": [((TM,), D, lambda t: t.date(), lambda c: F.to_date(c))],
    "dateymd": [((N, N, N), D, lambda y, m, d: datetime.date(_int(y), _int(m), _int(d)), fn.dateymd)],
    "year": [((t,), N, _part("year"), F.year) for t in (D, TM)],
    "month": [((t,), N, _part("month"), F.month) for t in (D, TM)],
    "day": [((t,), N, _part("day"), F.day) for t in (D, TM)],
    "dow": [((t,), N, _weekday, fn.dow) for t in (D, TM)],
    "daysdiff": [((t, t), N, lambda a, b: Decimal((a - b).days), fn.daysdiff) for t in (D, TM)],
    "binary": [((N,), BI, lambda n: bytes(_int(n)), fn.zero_bytes), ((TX,), BI, lambda s: s.encode(), lambda c: c.cast("binary"))],
    "blength": [((BI,), N, lambda b: Decimal(len(b)), fn.blength)],
    "bget": [((BI, N), N, lambda b, i: Decimal(b[_int(i)]), fn.bget)],
    "bset": [((BI, N, N), BI, _bset, fn.bset)],
    "format": [((None,), TX, quoted_form, None)],
}
ORDERED = (N, TX, TM, D)
__all__ = ["FUNCTIONS", "ORDERED", "text", "text_column", "time_of"]
