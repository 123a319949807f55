"""Folds as Spark aggregates.

Most operators have a native aggregate that combines map-side. A product of decimals, an ordered
concatenation and folds of user functions need their values in one place: they gather a group's
values in an array and fold that with aggregate(), inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.types import RelationError

#: Folds whose result depends on the order of rows.
ORDERED = ("&",)


def is_ordered(op: object) -> bool:
    return op in ORDERED if isinstance(op, str) else True


def _values(c: Column, keys: list[Column] | None) -> Column:
    """A group's values, in the order of keys if given."""
    if not keys:
        return F.array_sort(F.collect_list(c))
    pairs = F.array_sort(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), c.alias("x"))))
    return F.transform(pairs, lambda p: p.x)


def _step(seed: Column, t: T.DataType, f):
    return lambda values: F.aggregate(values, seed.cast(t), lambda a, x: f(a, x).cast(t))


def aggregate(op: object, c: Column, t: T.DataType, keys: list[Column] | None = None) -> Column:
    """The aggregate of a fold over c of type t; keys (all ascending) give ordered folds their order."""
    decimal = isinstance(t, T.DecimalType)
    if not isinstance(op, str):
        seed, function = op
        return F.aggregate(_values(c, keys), seed, function)
    if op == "+":
        return F.sum(c).cast(T.DecimalType(38, t.scale)) if decimal else F.sum(c)
    if op == "-":
        return -F.sum(c)
    if op == "*":
        wide = T.DecimalType(38, t.scale) if decimal else T.LongType() if isinstance(t, T.IntegralType) else t
        return _step(F.lit(1), wide, lambda a, x: a * x)(F.collect_list(c))
    if op == "/":
        wide = T.DecimalType(38, 18) if decimal or isinstance(t, T.IntegralType) else t
        return _step(F.lit(1), wide, lambda a, x: a / x)(_values(c, keys))
    if op == "&":
        return F.array_join(_values(c, keys), "")
    simple = {"max": F.max, "min": F.min, "and": F.bool_and, "or": F.bool_or, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor}
    if op in simple:
        return simple[op](c)
    if op == "xor":
        return F.sum(c.cast("int")) % 2 == 1
    if op == "union":
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    if op == "symdiff":  # tuples that an odd number of relations hold: equal ones lie side by side once sorted
        every = F.array_sort(F.flatten(F.collect_list(c)))
        ends = F.filter(F.sequence(F.lit(0), F.size(every)), lambda i: (i == 0) | (i == F.size(every)) | ~F.get(every, i).eqNullSafe(F.get(every, i - 1)))
        odd = F.filter(F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda a, k: F.struct(a.alias("at"), (F.get(ends, k + 1) - a).alias("n"))), lambda x: x.n % 2 == 1)
        return F.transform(odd, lambda x: F.get(every, x["at"]))
    if op in ("intersect", "join", "compose"):
        # all relations of an attribute have one heading: a natural join of them is what they share, and composing removes what is shared
        lists = F.collect_list(c)
        if op == "compose":
            raise RelationError("compose leaves no attributes of relations with one heading")
        counted = F.array_sort(F.flatten(lists))  # tuples are distinct within a relation, so one in all of them is there as often as there are relations
        n = F.size(lists)
        return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.size(counted) - n), lambda i: F.get(counted, i).isNotNull() & F.get(counted, i).eqNullSafe(F.get(counted, i + n - 1))), lambda i: F.get(counted, i)))
    if op == "minus":
        return F.slice(F.first(c), 1, 0)
    raise RelationError(f"{op} does not fold")
