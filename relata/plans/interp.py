"""Runs programs: values on the driver, relational expressions as Relations, open ones as Columns.

Inside a where, a select or a while, names of attributes are open: they stand for every tuple at
once, and functions of them build expressions. A relational expression that uses open attributes is
held as one relation for all outer tuples (OpenRelation): it carries the outer attributes under other
names, so joins, folds and counts work on the whole set, and no subquery runs once for each tuple.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.expr import Attr, Call, Expr, Fold, Place, Window, column, quoted
from relata.plans.builtins import FUNCTIONS, ORDERED, text_column, time_of
from relata.plans.parser import Parser
from relata.plans.values import CODE, USER, Code, Held, Nesting, Open, OpenRelation, Part, Tup, default_of, gathered, literal, pretty, spark_tag, spark_type, text, type_of, value_of
from relata.relation import Relation, configure
from relata.types import RelationError

JOINS = {"join", "compose", "divide", "rdivide", "semijoin", "rsemijoin", "ajoin", "rajoin", "ajoinl", "rajoinr"}
SETS = {"union", "intersect", "minus", "rminus", "symdiff"}
COMPARES = {"sub": "subset", "sup": "superset", "sep": "separate"}
ALIASES = {"matching": "semijoin", "notmatching": "ajoin", "joinlr": "compose", "joinlc": "semijoin", "joinl": "divide", "joincr": "rsemijoin", "joinr": "rdivide"}
WINDOWS = {"lag", "lead", "nth", "rank", "ord", "ordg"}
SIMPLE_TYPES = {"bool", "number", "text", "time", "date", "binary"}
FOLDS = {"+", "-", "*", "/", "&", "max", "min", "and", "or", "xor", "union", "intersect", "minus", "symdiff", "join", "compose"}


@dataclass
class Binding:
    kind: str  # value, defer, fun
    value: object
    variable: bool = False
    source: str = ""


@dataclass
class Scope:
    parent: Scope | None = None
    names: dict[str, Binding] = field(default_factory=dict)

    def find(self, name: str) -> tuple[Scope, Binding] | None:
        scope = self
        while scope is not None:
            if name in scope.names:
                return scope, scope.names[name]
            scope = scope.parent
        return None


@dataclass
class RowScope(Scope):
    """Attributes of a frame, open. alias: outer attributes that the frame carries under other names."""

    frame: Relation | None = None
    tags: dict[str, object] = field(default_factory=dict)
    alias: dict[str, tuple[str, object]] = field(default_factory=dict)
    depth: int = 0
    added: list[tuple] = field(default_factory=list)

    def outer_name(self, name: str) -> str:
        return f"_o{self.depth}_{name}"

    @property
    def plain(self) -> Relation:
        """The frame, less what it does not gather: the rest identifies its tuples."""
        return self.frame.base if isinstance(self.frame, Nesting) else self.frame

    @property
    def whole(self) -> DataFrame:
        return self.frame.whole if isinstance(self.frame, Nesting) else self.frame.df

    @property
    def outers(self) -> list[str]:
        return [self.outer_name(n) for n in self.plain.columns]

    def under(self) -> list[Column]:
        """The frame's attributes under their outer names (those it carries for outer scopes too)."""
        return [_c(n).alias(self.outer_name(n)) for n in self.plain.columns]

    def outer(self) -> Relation:
        return Relation(self.plain.df.select(*self.under()))

    def attach(self, df, value: str, default: Column) -> Expr:
        """A column for each tuple, from a frame with the outer names; default where it has no row."""
        name = f"_a{self.depth}_{len(self.added)}"
        self.added.append((df, value, default, name))
        return Attr(name)

    def extended(self, whole: bool = False) -> Relation:
        """The frame with what was attached; whole: with arrays of what it does not gather."""
        frame, df = self.plain, self.whole if whole else self.plain.df
        for other, value, default, name in self.added:
            keys = [n for n in frame.columns if self.outer_name(n) in other.columns]
            side = other.select(*(_c(self.outer_name(n)) for n in keys), _c(value).alias(name), F.lit(True).alias("_met"))
            on = [_c(n).eqNullSafe(_c(self.outer_name(n))) for n in keys]
            df = df.join(side, on, "left").select(*(_c(c) for c in df.columns), F.when(F.col("_met"), _c(name)).otherwise(default).alias(name))
        return Relation(df, frame.keys, frame.sorting)


def _c(name: str) -> Column:
    return F.col(quoted(name))


def names_in(node: object) -> set[str]:
    """All names that occur in a node."""
    if isinstance(node, tuple):
        own = {node[1]} if len(node) > 1 and node[0] in ("name", "call") and isinstance(node[1], str) else set()
        return own.union(*(names_in(x) for x in node[1:])) if len(node) > 1 else own
    if isinstance(node, list):
        return set().union(*map(names_in, node)) if node else set()
    return set()


def names_within(node: object) -> set[str]:
    """Names that occur where another relation's tuples, or a condition between relations, are at hand."""
    if isinstance(node, list):
        return set().union(*map(names_within, node)) if node else set()
    if not isinstance(node, tuple) or not node:
        return set()
    bodies = {"select": node[3:], "where": node[2:], "while": node[2:], "if": node[1:2]}.get(node[0], ()) if isinstance(node[0], str) else ()
    return names_in(list(bodies)) | names_within(list(node))


class Interp:
    def __init__(self, spark=None, source_path: str = ".", write: Callable[[str], None] = print, read: Callable[[], str] = input):
        self.spark = configure(spark) if spark is not None else None
        self.source_path, self.write, self.read_line = source_path, write, read
        self.globals = Scope()
        self.types: dict[str, list[tuple[str, object]]] = {}
        self.options: set[str] = set()
        self.stopped = False
        self.depth = self.noisy = 0
        #: Called by #catalog with all options so far; a session loads its store there.
        self.opened: Callable[[set[str]], None] | None = None

    # --- programs ---

    def run(self, program: str, filename: str = "", interactive: bool = True) -> object:
        """Run a program; bare expressions are printed. Returns the last value."""
        last = None
        for node, line, source in Parser(program, filename).program():
            try:
                last = self.statement(node, self.globals, source)
            except RelationError as e:
                raise e if str(e).startswith("line") else RelationError(f"line {line}: {e}") from e
            if interactive and last is not None and node[0] not in ("assign", "defer", "deffun", "var", "type", "update_set", "update_where", "directive"):
                self.write(pretty(last))
            if self.stopped:
                break
        return last

    def statement(self, node: tuple, scope: Scope, source: str = "") -> object:
        kind = node[0]
        if kind == "assign":
            return self.assign(node[1], self.value(node[2], scope), scope, node[3], source)
        if kind == "defer":
            scope.names[node[1]] = Binding("defer", node[2], source=source)
        elif kind == "deffun":
            self.define(node, scope, source)
        elif kind == "var":
            for name, type_node, origin in node[1]:
                self.declare(name, type_node, origin, scope)
        elif kind == "type":
            for name, fields in node[1]:
                self.types[name] = [(n, self.type(t, scope)) for n, t in fields]
        elif kind == "update_set":
            self.update_set(node, scope)
        elif kind == "update_where":
            self.update_where(node, scope)
        elif kind == "directive":
            self.directive(node[1], node[2])
        else:
            return self.value(node, scope)
        return None

    def directive(self, name: str, rest: str) -> None:
        if name == "include":
            path = Path(self.source_path, rest.strip("'\""))
            self.run(path.read_text(encoding="utf-8-sig"), str(path))
        elif name == "source":
            self.source_path = rest.strip("'\"")
        elif name == "stop":
            self.stopped = True
        elif name == "panic":
            raise RelationError("panic")
        elif name == "catalog":
            self.options |= set(rest.split())
            if self.opened is not None:
                self.opened(self.options)
        elif name == "noisy":
            self.noisy = int(rest or 1)

    def assign(self, name: str, value: object, scope: Scope, variable: bool, source: str = "") -> None:
        if isinstance(value, OpenRelation):
            raise RelationError(f"{name}: an open relation can't be kept")
        found = scope.find(name)
        if found and not variable and found[1].variable:
            if type_of(found[1].value) != type_of(value) and found[1].value is not None:
                raise RelationError(f"{name}: the type must stay {type_of(found[1].value)}")
            found[1].value = value
            return
        if found and found[0] is scope and not variable and found[1].kind == "value" and scope is self.globals:
            raise RelationError(f"{name} is already defined and not a variable")
        scope.names[name] = Binding("value", value, variable, source)

    def declare(self, name: str, type_node: tuple | None, origin: str | None, scope: Scope) -> None:
        from relata.sources import readers

        tag = self.type(type_node, scope) if type_node else None
        if origin is None:
            scope.names[name] = Binding("value", default_of(tag, self.types, self.spark), True)
            return
        heading = None
        if tag is not None:
            fields = type_node[1][1] if type_node[0] in ("rel", "tup") and type_node[1] else None
            order = [n for n, _ in fields] if fields else list(tag[1])
            heading = T.StructType([T.StructField(n, spark_type(tag[1][n], self.types)) for n in order])
        scope.names[name] = Binding("value", readers.read(self.spark, origin, name, self.source_path, heading, self.read_line), True)

    def define(self, node: tuple, scope: Scope, source: str) -> None:
        _, name, result, params, body = node
        code = Code(name, [(n, self.type(t, scope)) for n, t in params], self.type(result, scope) if result else None, body, scope, source)
        have = scope.names.get(name)
        codes = [c for c in have.value if [t for _, t in c.params] != [t for _, t in code.params]] if have and have.kind == "fun" else []
        scope.names[name] = Binding("fun", [*codes, code], source=source)

    # --- types ---

    def type(self, node: tuple, scope: Scope) -> object:
        kind = node[0]
        if kind == "named":
            name = node[1]
            if name in SIMPLE_TYPES:
                return name
            if name in self.types:
                return ("user", name)
            found = scope.find(name)
            if found:
                return type_of(self.name(name, scope))
            raise RelationError(f"no type {name}")
        if kind == "like":
            return type_of(self.value(node[1], scope))
        if node[1] is None:
            return (kind, None)
        if node[1][0] == "heading":
            return (kind, {n: self.type(t, scope) for n, t in node[1][1]})
        inner = self.type(node[1], scope)
        return (kind, dict(self.types[inner[1]]) if inner[0] == "user" else inner[1])

    def fits(self, want: object, got: object) -> bool:
        return want == got or (isinstance(want, tuple) and want[1] is None and isinstance(got, tuple) and got[0] == want[0])

    # --- values ---

    def value(self, node: tuple, scope: Scope) -> object:
        return getattr(self, "on_" + node[0])(node, scope)

    def on_num(self, node, scope):
        return node[1]

    on_text = on_bool = on_num

    def on_time(self, node, scope):
        return time_of(node[1])

    def on_binary(self, node, scope):
        return bytes.fromhex(node[1])

    def on_paren(self, node, scope):
        return self.value(node[1], scope)

    def on_name(self, node, scope):
        return self.name(node[1], scope)

    def name(self, name: str, scope: Scope) -> object:
        at = scope
        while at is not None:
            if isinstance(at, RowScope):
                if name in at.tags:
                    return self.attribute(name, at)
                if name in at.alias:
                    return Open(Attr(at.alias[name][0]), at.alias[name][1])
            if name in at.names:
                b = at.names[name]
                if b.kind == "defer":
                    return self.statement(b.value, Scope(at))
                return b.value[-1] if b.kind == "fun" else b.value
            at = at.parent
        if name in FUNCTIONS or name in WINDOWS or name in ("now", "read"):
            return self.call(name, [], scope)
        raise RelationError(f"{name} is not defined")

    def attribute(self, name: str, row: RowScope) -> Open:
        """An attribute of the tuples at hand; one that their relation does not gather stays rows."""
        if not isinstance(row.frame, Nesting) or name not in row.frame.parts:
            return Open(Attr(name), row.tags[name])
        part = row.frame.parts[name]
        if set(part.by) == set(row.plain.columns):
            df = part.df.select(*(_c(part.key(n)).alias(row.outer_name(n)) for n in part.by), *map(_c, part.own))
        else:
            on = [_c(row.outer_name(n)).eqNullSafe(_c(part.key(n))) for n in part.by]
            df = row.outer().df.join(part.df, on).select(*map(_c, row.outers), *map(_c, part.own))
        own = OpenRelation(Relation(df), row.outers, frozenset(map(row.outer_name, part.by)))
        return Held(own, row.tags[name], lambda v: self.expr(v, row))

    def on_do(self, node, scope):
        own, last = Scope(scope), None
        for s in node[1]:
            last = self.statement(s, own)
        return last

    def on_if(self, node, scope):
        condition = self.value(node[1], scope)
        if not isinstance(condition, Open):
            return self.value(node[2] if condition else node[3], scope)
        a, b = self.value(node[2], scope), self.value(node[3], scope)
        if isinstance(a, Relation | OpenRelation) or isinstance(b, Relation | OpenRelation):
            row = self.row_scope(scope)
            one, other = self.beside(a, scope), self.beside(b, scope)
            outer = RowScope(row.parent, frame=one.relation, alias={n: (row.outer_name(n), t) for n, t in row.tags.items()}, depth=row.depth + 1)
            test = self.value(node[1], outer).expr
            return OpenRelation(one.relation.where(test).union(other.relation.where(Call(lambda c: ~c, test))), one.outer)
        return Open(Call(lambda c, x, y: F.when(c, x).otherwise(y), condition.expr, self.expr(a, scope), self.expr(b, scope)), type_of(a))

    def on_fold(self, node, scope):
        op, arg = node[1], self.value(node[2], scope)
        tag, e = type_of(arg), self.expr(arg, scope)
        if op in FOLDS and not self.user(op, scope):
            return Open(Fold(op, e), tag)
        codes = self.user(op, scope)
        code = next((c for c in codes or [] if [t for _, t in c.params] == [tag, tag]), None)
        if code is None:
            raise RelationError(f"{op} does not fold over {tag}")
        seed = literal(default_of(tag, self.types, self.spark))
        target = spark_type(tag, self.types)
        step = lambda a, x: column(self.expr(self.apply(code, [Open(a, tag), Open(x, tag)], scope), scope), Place()).cast(target)
        return Open(Fold((seed.cast(target), step), Call(lambda c: c.cast(target), e)), tag)

    def on_def(self, node, scope):
        return Code("", [(n, self.type(t, scope)) for n, t in node[1]], self.type(node[2], scope) if node[2] else None, node[3], scope, node[4])

    # --- tuples and relations ---

    def on_row(self, node, scope):
        _, star, elements = node
        if star and not elements:
            row = self.row_scope(scope)
            if row is None:
                raise RelationError("{*} needs a tuple")
            return Open(Call(lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, row.tags, strict=True))), *(self.attribute(n, row).expr for n in row.tags)), ("tup", dict(row.tags)))
        made = {n if n is not None else e[1]: self.value(e, scope) for n, e in elements}
        if any(isinstance(v, Open) for v in made.values()):
            parts = [self.expr(v, scope) for v in made.values()]
            return Open(Call(lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, made, strict=True))), *parts), ("tup", {n: type_of(v) for n, v in made.items()}))
        return Tup(made)

    def relation(self, rows: list[dict[str, object]], tags: dict[str, object]) -> Relation:
        if not tags:
            return Relation(self.spark.range(min(1, len(rows))).select())
        if not rows:
            return Relation(self.spark.createDataFrame([], spark_type(("tup", tags), self.types)))
        frames = [self.spark.range(1).select(*(literal(self.kept(r[n])).alias(n) for n in tags)) for r in rows]
        if len(rows) > 20 or any(not isinstance(v, Decimal | str | bool) for r in rows for v in r.values()):
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f)
            return Relation(df.distinct())
        scale = {n: max(-min(0, Decimal(r[n]).as_tuple().exponent) for r in rows) for n, t in tags.items() if t == "number"}
        schema = T.StructType([T.StructField(n, T.DecimalType(37, scale[n]) if t == "number" else spark_type(t, self.types), False) for n, t in tags.items()])
        return Relation(self.spark.createDataFrame([tuple(r[n] for n in tags) for r in rows], schema).distinct())

    def kept(self, v: object) -> object:
        """A value as an attribute takes it: functions by their source text."""
        if isinstance(v, Code):
            self.codes[v.source] = v
            return Tup({"source": v.source}, CODE)
        return v

    @property
    def codes(self) -> dict[str, Code]:
        return self.__dict__.setdefault("_codes", {})

    def on_rows(self, node, scope):
        rows = node[1]
        if len(rows) == 1 and rows[0][0] == "row" and rows[0][1] and not rows[0][2]:
            row = self.row_scope(scope)
            if row is None:
                raise RelationError("{{*}} needs a tuple")
            own = row.whole.select(*row.under(), *(_c(n) for n in row.tags))
            return OpenRelation(Relation(own), row.outers, image={n: row.outer_name(n) for n in row.tags})
        values = [self.value(r, scope) for r in rows]
        if any(isinstance(v, Open) for v in values) and (row := self.row_scope(scope)) is not None:
            parts = []
            for r in rows:
                made = {n if n is not None else e[1]: self.expr(self.value(e, scope), scope) for n, e in r[2]}
                df = row.extended().df.select(*row.under(), *(column(e, Place()).alias(n) for n, e in made.items()))
                parts.append(Relation.of(df))
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            return OpenRelation(out, row.outers)
        tags = type_of(values[0])[1] if values else {}
        return self.relation([v.fields for v in values], tags)

    def on_table(self, node, scope):
        _, fields, rows = node
        return self.headed({n: self.type(t, scope) for n, t in fields}, rows, scope)

    def on_typed(self, node, scope):
        tag = self.type(node[1], scope)
        if tag[0] == "user":
            return self.headed(dict(self.types[tag[1]]), node[2], scope)
        if isinstance(tag, tuple) and tag[0] in ("rel", "tup"):
            return self.headed(tag[1], node[2], scope)
        raise RelationError("a relation, tuple or user type is needed")

    def headed(self, tags: dict[str, object], rows: list, scope: Scope) -> Relation:
        made = []
        for r in rows:
            values = [self.value(e, scope) for e in r]
            if len(values) != len(tags) or any(not self.fits(t, type_of(v)) for t, v in zip(tags.values(), values, strict=True)):
                raise RelationError("a row does not fit its heading")
            made.append(dict(zip(tags, values, strict=True)))
        return self.relation(made, tags)

    # --- open expressions ---

    def row_scope(self, scope: Scope) -> RowScope | None:
        while scope is not None and not isinstance(scope, RowScope):
            scope = scope.parent
        return scope

    def expr(self, v: object, scope: Scope) -> Expr | Column:
        """A value as an expression over the tuples at hand."""
        if isinstance(v, Open):
            return v.expr
        if isinstance(v, OpenRelation):
            own = v.own
            df = v.relation.df.groupBy(*map(_c, v.outer)).agg(F.array_sort(F.collect_set(F.struct(*map(_c, own)))).alias("_all"))
            t = df.schema["_all"].dataType
            return self.row_scope(scope).attach(df, "_all", F.array().cast(t))
        return literal(self.kept(v))

    def beside(self, v: Relation | OpenRelation, scope: Scope) -> OpenRelation:
        """A closed relation beside every outer tuple."""
        if isinstance(v, OpenRelation):
            return v
        outer = self.row_scope(scope).outer()
        return OpenRelation(outer.join(v), outer.columns, frozenset())

    def reach(self, v: OpenRelation, nodes: object, row: RowScope, scope: Scope) -> frozenset[str] | None:
        """The outer attributes that determine v once these nodes, over its tuples, have worked on it; None for all."""
        if v.deps is None or row.added:
            return None
        at = scope
        while at is not None:
            if not isinstance(at, RowScope) and at is not self.globals and at.names:
                return None  # a local name may stand for any attribute
            at = at.parent
        return v.deps | {row.alias[n][0] for n in names_in(nodes) & row.alias.keys()}

    def inside(self, v: Relation | OpenRelation, scope: Scope) -> RowScope:
        """The scope of a relation's attributes, and of the outer ones that it carries."""
        row = self.row_scope(scope)
        depth = row.depth + 1 if row else 0
        rel = v.relation if isinstance(v, OpenRelation) else v
        outer = v.outer if isinstance(v, OpenRelation) else []
        alias = {}
        if row and outer:
            alias = {n: (row.outer_name(n), t) for n, t in row.tags.items()} | {n: (row.outer_name(a), t) for n, (a, t) in row.alias.items() if n not in row.tags}
        tags = {f.name: spark_tag(f.dataType) for f in rel.df.schema if f.name not in outer}
        return RowScope(scope, frame=rel, tags=tags, alias=alias, depth=depth)

    def correlated(self, v: object, nodes: object, scope: Scope) -> object:
        """Opens a closed relation if an expression over it uses attributes of an outer tuple."""
        row = self.row_scope(scope)
        if row is None or not isinstance(v, Relation):
            return v
        free = names_in(nodes) - set(v.columns)
        at, seen = scope, set()
        while at is not row:
            seen |= at.names.keys()
            for b in at.names.values():
                if isinstance(b.value, Open) and free & at.names.keys():
                    free |= set(row.tags)
            at = at.parent
        return self.beside(v, scope) if (free - seen) & (row.tags.keys() | row.alias.keys()) else v

    # --- postfix operators ---

    def on_where(self, node, scope):
        v = self.correlated(self.value(node[1], scope), node[2], scope)
        v = self.spread(self.relational(v, scope), [node[2]], scope)
        row = self.inside(v, scope)
        test = self.value(node[2], row)
        if not isinstance(test, Open):
            test = Open(F.lit(bool(test)), "bool")
        if test.type != "bool":
            raise RelationError("a where needs a bool")
        rel, condition = row.plain, test.expr
        out = row.extended().where(condition) if row.added else rel.where(condition)
        if row.added:
            out = Relation(out.df.select(*map(_c, rel.columns)), rel.keys, rel.sorting)
        if isinstance(v, Nesting):
            return Nesting(out, v.parts, v.names)
        return OpenRelation(out, v.outer, self.reach(v, node[2], row, scope)) if isinstance(v, OpenRelation) else out

    def relational(self, v: object, scope: Scope) -> Relation | OpenRelation:
        if isinstance(v, Relation | OpenRelation):
            return v
        if isinstance(v, Held):
            return self.rows_of(v, scope)
        if isinstance(v, Open) and isinstance(v.type, tuple) and v.type[0] == "rel":
            row, whole = self.row_scope(scope), column(v.expr, Place())
            df = row.extended().df.select(*row.under(), F.inline(whole))
            return OpenRelation(Relation.of(df), row.outers)
        if isinstance(v, Tup):
            return self.relation([v.fields], {n: type_of(x) for n, x in v.fields.items()})
        raise RelationError("a relation is needed")

    def entered(self, node: object, scope: Scope) -> set[str]:
        """Names whose tuples, if they hold relations, these nodes work on."""
        if isinstance(node, list):
            return set().union(*(self.entered(x, scope) for x in node)) if node else set()
        if not isinstance(node, tuple) or not node:
            return set()
        targets = [node[1]] if node[0] in ("select", "where", "order", "while") and len(node) > 2 else []
        called = {"call": 1, "dot": 2}.get(node[0]) if isinstance(node[0], str) and len(node) > 3 else None
        if called and isinstance(name := node[called], str) and (name in JOINS | SETS | ALIASES.keys() | {"take", "skip"} or self.user(name, scope)):
            targets = [*(node[2] or [])] if called == 1 else [node[1], *(node[3] or [])]
        while any(t[0] == "paren" for t in targets):
            targets = [t[1] if t[0] == "paren" else t for t in targets]
        return {t[1] for t in targets if t[0] == "name"} | self.entered(list(node), scope)

    def spread(self, v: object, nodes: list, scope: Scope) -> object:
        """A relation for expressions over its tuples. Arrays that they open become rows, or each of these would carry its array."""
        if not isinstance(v, Relation):
            return v
        arrays = list(v.parts) if isinstance(v, Nesting) else [f.name for f in v.df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and f.dataType.elementType.names]
        if names_within(nodes) & set(arrays):
            return gathered(v)
        if isinstance(v, Nesting) or v.sorting or not self.entered(nodes, scope) & set(arrays):
            return v
        from relata.sources.store import settle

        plain, df = [n for n in v.columns if n not in arrays], v.df
        keys = [k for k in v.keys if k and k <= set(plain)]
        if not keys:  # the arrays tell tuples apart: number them, once
            number = "_row"
            while number in v.columns:
                number += "_"
            df, keys = settle(df.withColumn(number, F.monotonically_increasing_id())), [frozenset([number])]
            plain = [*plain, number]
        by = sorted(min(keys, key=len))
        parts = {n: Part(Relation.of(df.select(*(_c(k).alias(Part.key(k)) for k in by), F.inline(_c(n)))).df, by) for n in arrays}
        return Nesting(Relation(df.select(*map(_c, plain)), keys), parts, v.columns)

    def rows_of(self, v: Held, scope: Scope) -> OpenRelation:
        if not set(v.relation.outer) <= set(self.row_scope(scope).outers):
            raise RelationError("a relation-valued attribute is used among other tuples than its own")
        return v.relation

    def on_order(self, node, scope):
        v = self.relational(self.value(node[1], scope), scope)
        rel = v.relation if isinstance(v, OpenRelation) else v
        for n, _, _ in node[2]:
            if n not in rel.columns:
                raise RelationError(f"unknown attribute {n}")
        front = [(n, False, True) for n in v.outer] if isinstance(v, OpenRelation) else []
        out = Relation(rel.df, rel.keys, [*front, *node[2]])
        out.incoming = rel.sorting
        return OpenRelation(out, v.outer, v.deps) if isinstance(v, OpenRelation) else out

    def on_while(self, node, scope):
        v = gathered(self.relational(self.value(node[1], scope), scope))
        if isinstance(v, OpenRelation):
            raise RelationError("a while can't start from an open relation")

        def step(delta: Relation) -> Relation:
            row = self.inside(delta, scope)
            out = self.relational(self.value(node[2], row), row)
            out = out.relation.project(*out.own) if isinstance(out, OpenRelation) else out
            types = {f.name: f.dataType for f in v.df.schema}
            return Relation(out.df.select(*(_c(c).cast(types[c]).alias(c) if c in types else _c(c) for c in out.columns)), out.keys)

        return Relation(self.widened(v, node[2], scope)).while_(step)

    def widened(self, v: Relation, body: tuple, scope: Scope):
        """v with numbers at the scale that a step gives them, so that rounds don't round."""
        row = self.inside(v, scope)
        out = self.relational(self.value(body, row), row)
        made = {f.name: f.dataType for f in (out.relation if isinstance(out, OpenRelation) else out).df.schema}
        cast = lambda f: T.DecimalType(37, min(10, max(getattr(f.dataType, "scale", 0), getattr(made.get(f.name), "scale", 0)))) if isinstance(f.dataType, T.DecimalType) else f.dataType
        return v.df.select(*(_c(f.name).cast(cast(f)).alias(f.name) for f in v.df.schema))

    def on_select(self, node, scope):
        _, target, star, elements = node
        v = self.value(target, scope)
        if isinstance(v, Tup):
            return self.select_tuple(v, star, elements, scope)
        if isinstance(v, Open) and isinstance(v.type, tuple) and v.type[0] == "tup":
            return self.select_open_tuple(v, star, elements, scope)
        v = self.correlated(self.relational(v, scope), [e for _, e in elements], scope)
        lifts = isinstance(v, Relation) and any(n is None and not (e[0] == "name" and e[1] in v.columns) for n, e in elements)
        v = gathered(v) if lifts else self.spread(v, [e for _, e in elements], scope)
        outer = v.outer if isinstance(v, OpenRelation) else []
        rel = v.relation if isinstance(v, OpenRelation) else v
        own = [c for c in rel.columns if c not in outer]
        row = self.inside(v, scope)
        keep, new, lifted, open_ = [], {}, None, {}
        for n, e in elements:
            if n is None and e[0] == "name" and e[1] in own:
                keep.append(e[1])
            elif n is None:
                lifted = e[1] if e[0] == "paren" else e
            elif e[0] == "name" and e[1] in own:
                new[n] = e[1]
            elif isinstance(value := self.value(e, row), OpenRelation):
                new[n] = open_[n] = value
            else:
                new[n] = self.expr(value, row)
        if lifted is not None:
            if star or keep or new or len(elements) > 1:
                raise RelationError("a lifted value must stand alone")
            return self.lift(v, rel, outer, self.value(lifted, row), row, scope)
        if (open_ or isinstance(rel, Nesting)) and not outer and (out := self.nesting(rel, row, star, keep, new, open_)):
            return out
        new |= {n: self.expr(value, row) for n, value in open_.items()}
        source = row.extended(whole=True) if row.added else rel
        if row.added and star:
            keep = [*keep, *(n for n in row.plain.columns if n not in rel.columns), *(a[3] for a in row.added)]
        if star:
            out = source.transform([k for k in keep if k not in outer], True, new)
        else:
            out = source.transform([*outer, *keep], False, new)
        return OpenRelation(out, outer, self.reach(v, [e for _, e in elements], row, scope)) if outer else out

    def nesting(self, rel: Relation, row: RowScope, star: bool, keep: list[str], new: dict, made: dict[str, OpenRelation]) -> Relation | None:
        """A select whose relation-valued attributes, made or kept, need no arrays: attributes that it keeps determine them.

        None where they don't, and for folds and windows, which group by all attributes or sort by them.
        """
        parts = rel.parts if isinstance(rel, Nesting) else {}
        renames = {n: v for n, v in new.items() if isinstance(v, str)}
        kept = {n: n for n in rel.columns if (n not in keep and n not in renames.values() and n not in new) == star and (star or n in keep)} | renames
        held = {n: old for n, old in kept.items() if old in parts}
        back = {old: n for n, old in kept.items() if old not in parts}
        outer = {row.outer_name(old): n for old, n in back.items()}
        rest = {n: v for n, v in new.items() if n not in held and n not in made}
        if rel.sorting or (held or made) and any(isinstance(v, Expr) and (v.any(Fold) or v.any(Window)) for v in rest.values()):
            return None
        if any(not set(parts[old].by) <= back.keys() for old in held.values()) or any(not v.deps or not v.deps <= outer.keys() or not v.own for v in made.values()):
            return None
        names = [n for n in keep if n not in parts]
        if star:  # those named go
            names += [n for n in row.plain.columns if n in made or n not in rel.columns] + [a[3] for a in row.added]
        base = (row.extended() if row.added else row.plain).transform(names, star, rest)
        if not held and not made:
            return base
        nested = {n: parts[old].renamed(back) for n, old in held.items()}
        for n, v in made.items():
            by, df = sorted(v.deps), v.relation.project(*sorted(v.deps), *v.own).df
            nested[n] = Part(df.select(*(_c(o).alias(Part.key(outer[o])) for o in by), *map(_c, v.own)), [outer[o] for o in by])
        return Nesting(base, nested, [*kept, *(n for n in new if n not in renames)])

    def lift(self, v, rel, outer, value, row, scope):
        if not isinstance(value, Open):
            value = Open(literal(value), type_of(value))
        source = row.extended() if row.added else rel
        if not outer:
            plain = not (isinstance(value.expr, Expr) and (value.expr.any(Fold) or value.expr.any(Window)))
            one = (source.take(1) if plain else source).transform([], False, {"_lifted": value.expr})
            got = one.df.limit(1).collect()
            if not got:
                return default_of(value.type, self.types, self.spark)
            out = value_of(got[0][0], one.df.schema[0].dataType, self.spark)
            return self.codes[out.fields["source"]] if value.type == "code" else out
        one = source.transform(outer, False, {"_lifted": value.expr})
        df = one.df.groupBy(*map(_c, outer)).agg(F.first("_lifted").alias("_lifted"))
        t = one.df.schema["_lifted"].dataType
        from relata.types import default

        return Open(self.row_scope(scope).attach(df, "_lifted", default(t)), value.type)

    def select_tuple(self, v: Tup, star: bool, elements: list, scope: Scope) -> object:
        own = Scope(scope, {n: Binding("value", x) for n, x in v.fields.items()})
        keep = [e[1] for n, e in elements if n is None and e[0] == "name" and e[1] in v.fields]
        new = {n: e for n, e in elements if n is not None}
        if not star and len(elements) == 1 and not keep and not new:
            return self.value(elements[0][1], own)
        renamed = {e[1] for e in new.values() if e[0] == "name" and e[1] in v.fields}
        base = {n: x for n, x in v.fields.items() if n not in keep and n not in renamed} if star else {n: v.fields[n] for n in keep}
        return Tup(base | {n: self.value(e, own) for n, e in new.items()})

    def select_open_tuple(self, v: Open, star: bool, elements: list, scope: Scope) -> Open:
        parts = {n: Open(Call(lambda c, n=n: c.getField(n), v.expr), t) for n, t in v.type[1].items()}
        own = Scope(scope, {n: Binding("value", x) for n, x in parts.items()})
        keep = [e[1] for n, e in elements if n is None and e[0] == "name" and e[1] in parts]
        new = {n: self.value(e, own) for n, e in elements if n is not None}
        made = ({n: x for n, x in parts.items() if n not in keep} if star else {n: parts[n] for n in keep}) | new
        return Open(Call(lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, made, strict=True))), *(self.expr(x, scope) for x in made.values())), ("tup", {n: type_of(x) for n, x in made.items()}))

    def on_dot(self, node, scope):
        _, target, name, arguments, _ = node
        v = self.value(target, scope)
        if isinstance(v, Tup) and name in v.fields:
            out = v.fields[name]
            return self.apply(out, [self.value(a, scope) for a in arguments], scope) if arguments is not None else out
        if isinstance(v, Open) and isinstance(v.type, tuple):
            if v.type[0] == "user" and name in dict(self.types[v.type[1]]):
                return Open(Call(lambda c: c.getField(f"{v.type[1]}{USER}{name}"), v.expr), dict(self.types[v.type[1]])[name])
            if v.type[0] == "tup" and name in v.type[1]:
                return Open(Call(lambda c: c.getField(name), v.expr), v.type[1][name])
        return self.call(name, [v, *(self.value(a, scope) for a in arguments or [])], scope)

    # --- calls ---

    def user(self, name: str, scope: Scope) -> list[Code] | None:
        found = scope.find(name)
        if found and found[1].kind == "fun":
            return found[1].value
        return None

    def on_apply(self, node, scope):
        return self.apply(self.value(node[1], scope), [self.value(a, scope) for a in node[2]], scope)

    def on_call(self, node, scope):
        name = node[1]
        return self.call(name, [self.value(a, scope) for a in node[2]], scope)

    def call(self, name: str, args: list, scope: Scope) -> object:
        at = scope
        while at is not None:  # an attribute or variable that holds a function
            if isinstance(at, RowScope) and at.tags.get(name) == "code":
                return self.dispatch(Open(Attr(name), "code"), args, scope)
            if name in at.names and at.names[name].kind == "value" and isinstance(at.names[name].value, Code):
                return self.apply(at.names[name].value, args, scope)
            at = at.parent
        got = [type_of(a) for a in args]
        if codes := self.user(name, scope):
            for code in codes:
                if len(code.params) == len(args) and all(self.fits(t, g) for (_, t), g in zip(code.params, got, strict=True)):
                    return self.apply(code, args, scope)
        if name in self.types:
            return self.select_user(name, args, scope)
        name = ALIASES.get(name, name)
        if (made := self.relational_call(name, args, scope)) is not NotImplemented:
            return made
        if name == "&" and len(args) == 2:
            if not any(isinstance(a, Open) for a in args):
                return text(args[0]) + text(args[1])
            parts = [Call(lambda c, t=type_of(a): text_column(c, t), self.expr(a, scope)) for a in args]
            return Open(Call(F.concat, *parts), "text")
        if name == "text" and len(args) == 1:
            return Open(Call(lambda c: text_column(c, args[0].type), args[0].expr), "text") if isinstance(args[0], Open) else text(args[0])
        if name == "format" and len(args) == 1 and isinstance(args[0], Open):
            marks = {"text": ("'", "'"), "binary": ("b'", "'"), "time": ("t'", "'"), "date": ("t'", "'")}.get(args[0].type, ("", ""))
            return Open(Call(lambda c: F.concat(F.lit(marks[0]), text_column(c, args[0].type), F.lit(marks[1])), args[0].expr), "text")
        for wants, result, python, columns in FUNCTIONS.get(name, ()):
            if len(wants) == len(args) and all(self.takes(w, g, got[0]) for w, g in zip(wants, got, strict=True)):
                tag = got[0] if result == "first" else result
                if any(isinstance(a, Open) for a in args):
                    return Open(Call(columns, *(self.expr(a, scope) for a in args)), tag)
                return python(*args)
        if codes:
            raise RelationError(f"no {name} takes {', '.join(map(str, got))}")
        raise RelationError(f"{name} can't be called with {', '.join(map(str, got)) or 'nothing'}")

    def takes(self, want: object, got: object, first: object) -> bool:
        if want is None:
            return True
        if want == "same":
            return got == first
        if want == "ordered":
            return got in ORDERED or (isinstance(got, tuple) and got[0] == "user")
        return want == got

    def select_user(self, name: str, args: list, scope: Scope) -> object:
        fields = self.types[name]
        if len(args) != len(fields) or any(not self.fits(t, type_of(a)) for (_, t), a in zip(fields, args, strict=True)):
            raise RelationError(f"{name} takes {', '.join(str(t) for _, t in fields)}")
        if any(isinstance(a, Open) for a in args):
            parts = [self.expr(a, scope) for a in args]
            return Open(Call(lambda *c: F.struct(*(x.alias(f"{name}{USER}{n}") for x, (n, _) in zip(c, fields, strict=True))), *parts), ("user", name))
        return Tup({n: a for (n, _), a in zip(fields, args, strict=True)}, name)

    def apply(self, code: object, args: list, scope: Scope) -> object:
        if isinstance(code, Open) and code.type == "code":
            return self.dispatch(code, args, scope)
        if not isinstance(code, Code):
            raise RelationError("a function is needed")
        if len(args) != len(code.params) or any(not self.fits(t, type_of(a)) for (_, t), a in zip(code.params, args, strict=True)):
            raise RelationError(f"{code.name or 'a function'} takes {', '.join(str(t) for _, t in code.params)}")
        if code.result and any(isinstance(a, Open) for a in args) and self.recursive(code):
            return self.by_rows(code, args, scope)
        home = code.scope
        row = self.row_scope(scope)
        own = Scope(home, {n: Binding("value", a) for (n, _), a in zip(code.params, args, strict=True)})
        if row is not None and self.row_scope(home) is None:
            # open arguments belong to the caller's tuples: keep those in reach, hidden behind the names of the function
            hidden = RowScope(home, frame=row.frame, tags={}, alias={}, depth=row.depth, added=row.added)
            own.parent = hidden
        self.depth += 1
        try:
            if self.depth > 900:
                raise RelationError(f"{code.name} recurses too deeply")
            return self.statement(code.body, own)
        finally:
            self.depth -= 1

    def dispatch(self, code: Open, args: list, scope: Scope) -> Open:
        """A function held by an attribute: one branch for each function there is."""
        branches = []
        for source, c in self.codes.items():
            if len(c.params) == len(args) and all(self.fits(t, type_of(a)) for (_, t), a in zip(c.params, args, strict=True)):
                branches.append((source, self.apply(c, args, scope)))
        if not branches:
            raise RelationError("no function takes these arguments")

        def choose(c, *values):
            c = c.getField(f"{CODE}{USER}source")
            out = F.when(c == branches[0][0], values[0])
            for (source, _), v in zip(branches[1:], values[1:], strict=True):
                out = out.when(c == source, v)
            return out

        return Open(Call(choose, code.expr, *(self.expr(v, scope) for _, v in branches)), type_of(branches[0][1]))

    def recursive(self, code: Code) -> bool:
        seen, todo = set(), [code]
        while todo:
            for n in names_in(todo.pop().body):
                if n == code.name:
                    return True
                if n not in seen:
                    seen.add(n)
                    todo += self.user(n, code.scope) or []
        return False

    def by_rows(self, code: Code, args: list, scope: Scope) -> Open:
        """A recursive function over attributes: no Column can hold it, so a UDF interprets it for each row."""
        names, todo = {}, [code.name]
        while todo:
            n = todo.pop()
            found = code.scope.find(n)
            if found and n not in names and (found[1].kind != "value" or not isinstance(found[1].value, Relation)):
                b = found[1]
                names[n] = (b.kind, [(c.name, c.params, c.result, c.body) for c in b.value] if b.kind == "fun" else b.value)
                todo += [m for c in b.value for m in names_in(c.body)] if b.kind == "fun" else names_in(b.value) if b.kind == "defer" else []
        types, result = dict(self.types), spark_type(code.result, self.types)
        spec = (code.name, len(code.params), [t for _, t in code.params])

        def run(*values):
            from relata.plans.interp import detached

            return detached(names, types).outcome(spec, values)

        return Open(Call(F.udf(run, result, useArrow=False), *(self.expr(a, scope) for a in args)), code.result)

    def outcome(self, spec: tuple, values: tuple) -> object:
        name, n, tags = spec
        code = next(c for c in self.globals.names[name].value if [t for _, t in c.params] == tags)
        return self.apply(code, [Decimal(str(v)) if t == "number" else v for v, t in zip(values, tags, strict=True)], self.globals)

    # --- relational functions ---

    def relational_call(self, name: str, args: list, scope: Scope) -> object:
        first = args[0] if args else None
        table = isinstance(first, Relation | OpenRelation) or (isinstance(first, Open) and isinstance(first.type, tuple) and first.type[0] == "rel")
        if name in JOINS or name in SETS:
            if isinstance(first, Tup) and isinstance(args[1], Tup) and name in SETS:
                return self.tuple_set(name, first, args[1])
            return self.dyadic(name, self.relational(first, scope), self.relational(args[1], scope), scope)
        if name in COMPARES:
            return getattr(first, COMPARES[name])(args[1])
        if name == "count" and len(args) == 1:
            return self.count(first, scope)
        if name == "degree" and table:
            return Decimal(len(self.relational(first, scope).own if not isinstance(first, Relation) else first.columns))
        if name == "schema" and isinstance(first, Relation):
            return first.schema()
        if name in ("take", "skip") and table:
            v = self.relational(first, scope)
            if isinstance(v, OpenRelation):
                return self.take_each(v, name, int(args[1]))
            return getattr(v, name)(int(args[1]))
        if name in WINDOWS:
            if name in ("ord", "ordg"):
                return Open(Window(name), "number")
            n = int(args[1]) if len(args) > 1 else 1
            return Open(Window(name, self.expr(first, scope), n), "number" if name == "rank" else type_of(first))
        if name == "seq" and len(args) == 1 and not isinstance(first, Open):
            return Relation.seq(self.spark, int(first))
        if name in ("rel", "tup") and len(args) == 1:
            return self.convert(name, first)
        if name in ("pp", "write", "type", "now", "read", "pause", "fail", "assert") or self.system_name(name):
            return self.system(name, args, scope)
        return NotImplemented

    def system_name(self, name: str) -> bool:
        """Names of system relations: any prefix, then one of four endings, as in sys_catalog."""
        prefix, _, ending = name.rpartition("_")
        return bool(prefix) and ending in ("catalog", "variable", "operator", "member") and name not in self.globals.names

    def tuple_set(self, name: str, a: Tup, b: Tup) -> Tup:
        left, right = a.fields, b.fields
        return Tup({
            "union": lambda: right | left,
            "intersect": lambda: {k: v for k, v in left.items() if k in right},
            "minus": lambda: {k: v for k, v in left.items() if k not in right},
            "rminus": lambda: {k: v for k, v in right.items() if k not in left},
            "symdiff": lambda: {k: v for k, v in (left | right).items() if (k in left) != (k in right)},
        }[name]())

    def dyadic(self, name: str, a: object, b: object, scope: Scope) -> object:
        if isinstance(a, Relation) and isinstance(b, Relation):
            return getattr(a, name)(b)
        whole = name in SETS or name in ("rajoin", "rajoinr") or (name == "ajoin" and isinstance(b, OpenRelation))
        if whole or isinstance(b, OpenRelation):
            a, b = self.beside(a, scope), self.beside(b, scope)
        outer = a.outer
        left, right = a.relation, b.relation if isinstance(b, OpenRelation) else b
        mine, theirs = a.own, [c for c in right.columns if c not in outer]
        common = [c for c in mine if c in theirs]
        deps = a.deps | (b.deps if isinstance(b, OpenRelation) else frozenset()) if a.deps is not None and (not isinstance(b, OpenRelation) or b.deps is not None) else None
        if a.image and isinstance(b, Relation) and name in ("rdivide", "rsemijoin"):  # what is there of the tuple is what both have
            deps = frozenset(a.image[c] for c in common)
        shape = {"join": [*mine, *[c for c in theirs if c not in mine]], "compose": [c for c in [*mine, *theirs] if c not in common], "divide": [c for c in mine if c not in common], "rdivide": [c for c in theirs if c not in common], "rsemijoin": theirs}
        if name in SETS or name == "semijoin":
            out = getattr(left, name)(right)
        elif name in shape:
            out = (left.semijoin(right) if name == "divide" else left.join(right)).project(*outer, *shape[name])
        elif name in ("ajoin", "ajoinl"):
            out = left.ajoin(right)
            out = out.project(*outer, *(c for c in mine if c not in common)) if name == "ajoinl" else out
        else:
            out = right.ajoin(left)
            out = out.project(*outer, *(c for c in theirs if c not in common)) if name == "rajoinr" else out
        return OpenRelation(out, outer, deps)

    def count(self, v: object, scope: Scope) -> object:
        if isinstance(v, Relation):
            return Decimal(v.count())
        if isinstance(v, Held):
            v = self.rows_of(v, scope)
        if isinstance(v, Open):
            return Open(Call(lambda c: F.size(c).cast("long"), v.expr), "number")
        if isinstance(v, OpenRelation):
            df = v.relation.df.groupBy(*map(_c, v.outer)).agg(F.count("*").alias("_n"))
            return Open(self.row_scope(scope).attach(df, "_n", F.lit(0).cast("long")), "number")
        raise RelationError("count needs a relation")

    def take_each(self, v: OpenRelation, name: str, n: int) -> OpenRelation:
        order = [_c(c).desc() if d else _c(c).asc() for c, d, _ in v.relation.sorting if c not in v.outer] + [_c(c) for c in sorted(v.own)]
        ranked = v.relation.df.withColumn("_n", F.row_number().over(W.partitionBy(*map(_c, v.outer)).orderBy(*order)))
        return OpenRelation(Relation(ranked.where(F.col("_n") <= n if name == "take" else F.col("_n") > n).drop("_n"), v.relation.keys), v.outer, v.deps)

    def convert(self, name: str, v: object) -> object:
        if name == "rel":
            if isinstance(v, Tup):
                return self.relation([v.fields], {n: type_of(x) for n, x in v.fields.items()})
            return v
        if isinstance(v, Relation):
            got = v.df.limit(1).collect()
            if not got:
                raise RelationError("an empty relation has no tuple")
            return Tup({f.name: value_of(got[0][f.name], f.dataType, self.spark) for f in v.df.schema})
        return Tup(dict(v.fields))

    def system(self, name: str, args: list, scope: Scope) -> object:
        if name == "write":
            self.write(text(args[0]))
            return None
        if name == "pp":
            return pretty(args[0])
        if name == "type":
            tag = type_of(args[0])
            return tag if isinstance(tag, str) else tag[1] if tag[0] == "user" else {"rel": "relation", "tup": "tuple"}[tag[0]]
        if name == "now":
            return datetime.datetime.now()
        if name == "read":
            return self.read_line()
        if name == "pause":
            return None
        if name == "fail":
            raise RelationError(f"{text(args[0])}: {text(args[1])}")
        if name == "assert":
            if isinstance(args[0], Open):  # checked for every tuple
                failed = F.raise_error(F.concat(F.lit("assertion failed: "), column(self.expr(args[1], scope), Place()).cast("string"))).cast("boolean")
                return Open(Call(lambda c: F.when(c, F.lit(True)).otherwise(failed), args[0].expr), "bool")
            if not args[0]:
                raise RelationError(f"assertion failed: {text(args[1])}")
            return True
        from relata.plans import catalog

        return catalog.system_relation(self, name)

    # --- updates ---

    def variable(self, name: str) -> Binding:
        found = self.globals.find(name)
        if not found or not isinstance(found[1].value, Relation):
            raise RelationError(f"{name} is not a relation variable")
        return found[1]

    def update_set(self, node: tuple, scope: Scope) -> None:
        from relata.sources.store import settle

        _, name, op, e = node
        b = self.variable(name)
        other = self.relational(self.value(e, scope), scope)
        out = getattr(b.value, op)(other)
        if set(out.columns) != set(b.value.columns):
            raise RelationError("an update must keep the heading")
        b.value = Relation(settle(self.like(out, b.value).df), [k for k in b.value.keys if op in ("minus", "intersect")])

    def update_where(self, node: tuple, scope: Scope) -> None:
        from relata.sources.store import settle

        _, name, where, action = node
        b = self.variable(name)
        b.value = gathered(b.value)
        row = self.inside(b.value, scope)
        test = self.expr(self.value(where, row), row) if where else F.lit(True)
        if action is None:
            b.value = Relation(settle(b.value.where(Call(lambda c: ~c, test)).df), b.value.keys)
            return
        changes = {n: self.expr(self.value(e, row), row) for n, e in action[1]}
        if not set(changes) <= set(b.value.columns):
            raise RelationError("an update must keep the heading")
        types = {f.name: f.dataType for f in b.value.df.schema}
        new = {n: Call(lambda t, x, old, k=types[n]: F.when(t, x).otherwise(old).cast(k), test, e, Attr(n)) for n, e in changes.items()}
        b.value = Relation(settle(row.extended().df.select(*(column(new[c], Place()).alias(c) if c in new else _c(c) for c in b.value.columns)).distinct()))

    def like(self, v: Relation, model: Relation) -> Relation:
        return Relation(v.df.select(*(_c(f.name).cast(f.dataType).alias(f.name) for f in model.df.schema)), v.keys)


_DETACHED: dict[int, Interp] = {}


def detached(names: dict, types: dict) -> Interp:
    """An interpreter without Spark that knows some functions and values; one for each process and set of names."""
    key = hash(repr(sorted(names)) + repr(names.values()))
    if key not in _DETACHED:
        i = Interp()
        i.types = types
        for n, (kind, value) in names.items():
            i.globals.names[n] = Binding(kind, [Code(c, p, r, b, i.globals) for c, p, r, b in value] if kind == "fun" else value)
        _DETACHED[key] = i
    return _DETACHED[key]
