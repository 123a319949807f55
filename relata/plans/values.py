"""Values of the language outside of relations, and its types.

numbers are Decimals of 28 digits; texts, bools, bytes, datetimes and dates are Python's own. A Tup is
a tuple or a user value; Open is an expression over the tuples of a relation; Code is a function.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.expr import Expr, quoted
from relata.relation import Relation
from relata.types import ZERO_TIME, RelationError, kind

CONTEXT = decimal.Context(prec=28)
USER = "::"
#: A function in an attribute is its source text, in a structure that tells it from text.
CODE = "code"


@dataclass
class Tup:
    fields: dict[str, object]
    user: str | None = None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Tup) and self.user == other.user and self.fields.keys() == other.fields.keys() and all(same(v, other.fields[k]) for k, v in self.fields.items())

    __hash__ = None


@dataclass(eq=False)
class Code:
    """A function: parameters with types, a body, and the scope where it was made."""

    name: str
    params: list[tuple[str, object]]
    result: object
    body: tuple
    scope: object
    source: str = ""


@dataclass(eq=False)
class Open:
    """An expression over a relation's tuples, with its type."""

    expr: Expr | Column
    type: object


@dataclass(eq=False)
class OpenRelation:
    """A relation for each tuple of an outer one: the outer attributes are there under other names.

    deps: those of the outer attributes that determine it, None for all. image: for {{*}}, the outer names of its own attributes.
    """

    relation: Relation
    outer: list[str] = field(default_factory=list)
    deps: frozenset[str] | None = None
    image: dict[str, str] | None = None

    @property
    def own(self) -> list[str]:
        return [c for c in self.relation.columns if c not in self.outer]


@dataclass
class Part:
    """A relation-valued attribute as tuples of its own: by are attributes that determine it, under the names of key()."""

    df: DataFrame
    by: list[str]

    @staticmethod
    def key(name: str) -> str:
        return f"_k_{name}"

    @property
    def own(self) -> list[str]:
        return [c for c in self.df.columns if c not in set(map(self.key, self.by))]

    def renamed(self, new: dict[str, str]) -> Part:
        keys = [F.col(quoted(self.key(n))).alias(self.key(new[n])) for n in self.by]
        return Part(self.df.select(*keys, *(F.col(quoted(c)) for c in self.own)), [new[n] for n in self.by])


class Nesting(Relation):
    """A relation with relation-valued attributes that are not gathered: a group of any size stays many rows.

    base: its other attributes, a set, and maybe a number of the tuple; parts: the relation-valued ones; names: all of them in order.
    Arrays are made only for an operator that asks for df.
    """

    def __init__(self, base: Relation, parts: dict[str, Part], names: list[str]):
        self.base, self.parts, self.names, self._whole = base, parts, names, None
        super().__init__(None, [k for k in base.keys if k <= set(names)])

    @property
    def columns(self) -> list[str]:
        return self.names

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.whole.select(*(F.col(quoted(n)) for n in self.names))
        return self._df

    @property
    def whole(self) -> DataFrame:
        """All of base, beside the relation-valued attributes as arrays."""
        if self._whole is None:
            df = self.base.df
            for name, part in self.parts.items():
                groups = part.df.groupBy(*(F.col(quoted(part.key(n))) for n in part.by)).agg(F.array_sort(F.collect_set(F.struct(*(F.col(quoted(c)) for c in part.own)))).alias(name))
                empty = F.array().cast(groups.schema[name].dataType)
                on = [F.col(quoted(n)).eqNullSafe(F.col(quoted(part.key(n)))) for n in part.by]
                df = df.join(groups, on, "left").select(*(F.col(quoted(c)) for c in df.columns), F.coalesce(F.col(quoted(name)), empty).alias(name))
            self._whole = df.select(*(F.col(quoted(n)) for n in [*self.names, *(n for n in df.columns if n not in self.names)]))
        return self._whole

    def where(self, condition: object) -> Relation:
        return gathered(self).where(condition)


def gathered(v: object) -> object:
    """A Nesting as a plain relation, anything else as it is."""
    return Relation(v.df, v.keys) if isinstance(v, Nesting) else v


class Held(Open):
    """A relation-valued attribute of a Nesting: for each tuple, without an array until its expression is asked for."""

    def __init__(self, relation: OpenRelation, tag: object, gather: Callable[[OpenRelation], Expr]):
        self.relation, self.type, self.gather, self._expr = relation, tag, gather, None

    @property
    def expr(self) -> Expr:
        if self._expr is None:
            self._expr = self.gather(self.relation)
        return self._expr


def type_of(v: object) -> object:
    """number, text, bool, time, date, binary, void, code, ("user", name), ("tup", heading), ("rel", heading)."""
    if isinstance(v, Open):
        return v.type
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, Decimal | int | float):
        return "number"
    for python, name in ((str, "text"), (bytes | bytearray, "binary"), (datetime.datetime, "time"), (datetime.date, "date"), (Code, "code")):
        if isinstance(v, python):
            return name
    if isinstance(v, Tup):
        heading = {k: type_of(x) for k, x in v.fields.items()}
        return ("user", v.user) if v.user else ("tup", heading)
    if isinstance(v, Relation):
        return ("rel", {f.name: spark_tag(f.dataType) for f in v.df.schema})
    if isinstance(v, OpenRelation):
        return ("rel", {f.name: spark_tag(f.dataType) for f in v.relation.df.schema if f.name not in v.outer})
    return "void"


def spark_tag(t: T.DataType) -> object:
    k = kind(t)
    if k == "tuple":
        names = t.names
        if names and USER in names[0]:
            user = names[0].split(USER)[0]
            return "code" if user == CODE else ("user", user)
        return ("tup", {f.name: spark_tag(f.dataType) for f in t})
    if k == "relation":
        return ("rel", {f.name: spark_tag(f.dataType) for f in t.elementType})
    return k


def same(a: object, b: object) -> bool:
    if isinstance(a, Relation) and isinstance(b, Relation):
        return a.equals(b)
    return type_of(a) == type_of(b) and a == b


def digits(v: Decimal) -> Decimal:
    return CONTEXT.plus(v)


def value_of(x: object, t: T.DataType, spark=None) -> object:
    """A collected Spark value as a value of the language."""
    k = kind(t)
    if k == "number":
        return Decimal(str(x))
    if k == "tuple":
        if t.names and USER in t.names[0]:
            return Tup({n.split(USER)[1]: value_of(x[n], t[n].dataType, spark) for n in t.names}, t.names[0].split(USER)[0])
        return Tup({n: value_of(x[n], t[n].dataType, spark) for n in t.names})
    if k == "relation":
        return Relation(spark.createDataFrame([tuple(r) for r in x], t.elementType)) if t.elementType.names else Relation(spark.range(min(1, len(x))).select())
    if k == "binary":
        return bytes(x)
    return x


def spark_type(tag: object, types: dict) -> T.DataType:
    """The Spark type of an attribute; types holds the components of user types."""
    simple = {"number": T.DecimalType(37, 10), "text": T.StringType(), "bool": T.BooleanType(), "time": T.TimestampNTZType(), "date": T.DateType(), "binary": T.BinaryType(), "code": T.StructType([T.StructField(f"{CODE}{USER}source", T.StringType(), False)])}
    if tag in simple if isinstance(tag, str) else False:
        return simple[tag]
    if tag[0] == "user":
        return T.StructType([T.StructField(f"{tag[1]}{USER}{n}", spark_type(t, types), False) for n, t in types[tag[1]]])
    fields = T.StructType([T.StructField(n, spark_type(t, types), False) for n, t in tag[1].items()])
    return fields if tag[0] == "tup" else T.ArrayType(fields, False)


def literal(v: object) -> Column:
    """A value as a constant Column; relations become one-row subqueries."""
    if isinstance(v, Relation):
        names = [F.col("`" + c.replace("`", "``") + "`") for c in v.columns]
        return v.df.groupBy(F.lit(1).alias("_one")).agg(F.array_sort(F.collect_set(F.struct(*names))).alias("_all")).select("_all").scalar()
    if isinstance(v, Tup):
        prefix = f"{v.user}{USER}" if v.user else ""
        return F.struct(*(literal(x).alias(prefix + k) for k, x in v.fields.items()))
    if isinstance(v, Decimal):
        sign, d, exponent = v.as_tuple()
        scale = max(0, -exponent)
        return F.lit(f"{v:f}").cast(T.DecimalType(37, min(scale, 37)))
    if isinstance(v, datetime.datetime):
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(v, bytes):
        return F.lit(bytearray(v))
    return F.lit(v)


def default_of(tag: object, types: dict, spark) -> object:
    simple = {"number": Decimal(0), "text": "", "bool": False, "binary": b"", "time": ZERO_TIME, "date": ZERO_TIME.date()}
    if isinstance(tag, str):
        return simple.get(tag)
    if tag[0] == "user":
        return Tup({n: default_of(t, types, spark) for n, t in types[tag[1]]}, tag[1])
    if tag[0] == "tup":
        return Tup({n: default_of(t, types, spark) for n, t in tag[1].items()})
    return Relation(spark.createDataFrame([], spark_type(("tup", tag[1]), types)))


# --- text forms ---


def text(v: object) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Decimal | int):
        v = Decimal(v)
        s = f"{v:f}"
        return (s.rstrip("0").rstrip(".") if "." in s else s) or "0"
    if isinstance(v, float):
        return text(Decimal(repr(v)))
    if isinstance(v, bytes):
        return v.hex()[:50]
    if isinstance(v, datetime.datetime):
        day = v.strftime("%d/%m/%Y")
        return day if v.time() == datetime.time() else f"{day} {v.hour % 12 or 12}:{v:%M} {'AM' if v.hour < 12 else 'PM'}"
    if isinstance(v, datetime.date):
        return v.strftime("%d/%m/%Y")
    if isinstance(v, Tup):
        inner = ", ".join(f"{k}: {text(x)}" for k, x in v.fields.items())
        return f"{v.user}({', '.join(text(x) for x in v.fields.values())})" if v.user else f"{{ {inner} }}"
    if isinstance(v, Code):
        return v.source or v.name
    if isinstance(v, Relation):
        return pretty(v)
    return "" if v is None else str(v)


def quoted_form(v: object) -> str:
    if isinstance(v, str):
        return "'" + v + "'"
    if isinstance(v, bytes):
        return "b'" + v.hex() + "'"
    if isinstance(v, datetime.date):
        return "t'" + text(v) + "'"
    return text(v)


def _plain(x: object, t: T.DataType) -> object:
    """A collected value for printing: relations as lists of rows."""
    return x if kind(t) == "relation" else value_of(x, t)


def _table(schema: T.StructType, rows: list, clip: int) -> list[str]:
    """Lines of a table: header, rule, rows; nested relations are tables within their cells."""
    kinds = [kind(f.dataType) for f in schema]
    cells = []
    for r in rows:
        own = []
        for x, f, k in zip(r, schema, kinds, strict=True):
            if k == "relation":
                inner = f.dataType.elementType
                own.append(_table(inner, x, clip) if inner.names else ["{{}}" if x else "{{:}}"])
            else:
                own.append([text(_plain(x, f.dataType)).replace("\n", " ")[:clip]])
        cells.append(own)
    names = schema.names
    widths = [max([len(n), *(len(line) for r in cells for line in r[i])]) for i, n in enumerate(names)]
    pad = [str.rjust if k in ("number", "time", "date") else str.ljust for k in kinds]
    line = lambda parts: " | ".join(f(c, w) for f, c, w in zip(pad, parts, widths, strict=True)).rstrip()
    out = [line(names), "-+-".join("-" * w for w in widths)]
    for r in cells:
        out += [line([c[i] if i < len(c) else "" for c in r]) for i in range(max(map(len, r)))]
    return out


def pretty(v: object, clip: int = 60) -> str:
    """A relation as a table of text, all rows in its order; one line for degree 0.

    The text is on the driver, so what is printed is what the caller asked for: take() bounds it.
    """
    if not isinstance(v, Relation):
        return text(v)
    if not v.columns:
        return "{{}}" if v.count() else "{{:}}"
    return "\n".join(_table(v.df.schema, list(v.ordered().toLocalIterator()), clip))


__all__ = ["Code", "Held", "Nesting", "Open", "OpenRelation", "Part", "RelationError", "Tup", "default_of", "gathered", "literal", "pretty", "same", "spark_tag", "spark_type", "text", "type_of", "value_of"]
