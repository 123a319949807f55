"""Expressions over attributes, lowered to Columns where they are used.

An expression may hold folds and window functions at any depth. What these become depends on the
place: a fold is an aggregate in a grouped select and a running aggregate in an ordered one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from relata.types import RelationError


class Place:
    """Where an expression is lowered. This one is a row: folds and windows have no meaning there."""

    def fold(self, fold: Fold) -> Column:
        raise RelationError("a fold needs a select")

    def window(self, call: Window) -> Column:
        raise RelationError("a window function needs an ordered select")


def column(x: object, place: Place) -> Column:
    if isinstance(x, Expr):
        return x.lower(place)
    return x if isinstance(x, Column) else F.lit(x)


class Expr:
    """Base of expressions; operators build new ones."""

    parts: tuple = ()

    def lower(self, place: Place) -> Column:
        raise NotImplementedError

    def any(self, kind: type) -> bool:
        return isinstance(self, kind) or any(isinstance(p, Expr) and p.any(kind) for p in self.parts)

    def _with(self, other: object, f: Callable[[Column, Column], Column]) -> Expr:
        return Call(f, self, other)

    def __add__(self, o): return self._with(o, lambda a, b: a + b)
    def __radd__(self, o): return self._with(o, lambda a, b: b + a)
    def __sub__(self, o): return self._with(o, lambda a, b: a - b)
    def __rsub__(self, o): return self._with(o, lambda a, b: b - a)
    def __mul__(self, o): return self._with(o, lambda a, b: a * b)
    def __rmul__(self, o): return self._with(o, lambda a, b: b * a)
    def __truediv__(self, o): return self._with(o, lambda a, b: a / b)
    def __rtruediv__(self, o): return self._with(o, lambda a, b: b / a)
    def __neg__(self): return Call(lambda a: -a, self)
    def __eq__(self, o): return self._with(o, lambda a, b: a == b)
    def __ne__(self, o): return self._with(o, lambda a, b: a != b)
    def __lt__(self, o): return self._with(o, lambda a, b: a < b)
    def __le__(self, o): return self._with(o, lambda a, b: a <= b)
    def __gt__(self, o): return self._with(o, lambda a, b: a > b)
    def __ge__(self, o): return self._with(o, lambda a, b: a >= b)
    def __and__(self, o): return self._with(o, lambda a, b: a & b)
    def __or__(self, o): return self._with(o, lambda a, b: a | b)
    def __invert__(self): return Call(lambda a: ~a, self)
    __hash__ = object.__hash__


class Attr(Expr):
    def __init__(self, name: str):
        self.name = name

    def lower(self, place: Place) -> Column:
        return F.col(quoted(self.name))


class Call(Expr):
    """A function of Columns over expressions, Columns and constants."""

    def __init__(self, function: Callable[..., Column], *parts: object):
        self.function, self.parts = function, parts

    def lower(self, place: Place) -> Column:
        return self.function(*(column(p, place) for p in self.parts))


@dataclass(eq=False)
class Fold(Expr):
    """op: + * - / & max min and or xor union symdiff intersect bit_and bit_or bit_xor, or (seed, function)."""

    op: object
    arg: object

    @property
    def parts(self) -> tuple:
        return (self.arg,)

    def lower(self, place: Place) -> Column:
        return place.fold(self)


@dataclass(eq=False)
class Window(Expr):
    """name: lag lead nth ord ordg rank dense_rank row_number."""

    name: str
    arg: object = None
    n: int = 1

    @property
    def parts(self) -> tuple:
        return (self.arg,)

    def lower(self, place: Place) -> Column:
        return place.window(self)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def attr(name: str) -> Attr:
    return Attr(name)


def fold(op: object, arg: object) -> Fold:
    return Fold(op, arg)


def count() -> Fold:
    return Fold("+", 1)


def lag(arg: object, n: int = 1) -> Window:
    return Window("lag", arg, n)


def lead(arg: object, n: int = 1) -> Window:
    return Window("lead", arg, n)


def nth(arg: object, n: int) -> Window:
    return Window("nth", arg, n)


def ord_() -> Window:
    return Window("ord")


def ordg() -> Window:
    return Window("ordg")


def rank() -> Window:
    return Window("rank")
