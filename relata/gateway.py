"""A session for programs: run scripts, get and set values, call functions, also by JSON and by REST names."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import SparkSession

from relata.plans import catalog
from relata.plans.interp import Binding, Interp, Scope
from relata.plans.parser import Parser
from relata.plans.values import Tup, spark_type, type_of, value_of
from relata.relation import Relation
from relata.types import RelationError


class Session:
    def __init__(self, spark: SparkSession, store: str | None = None, source_path: str = ".", load: bool = False):
        self.lines: list[str] = []
        self.store = store
        self.interp = Interp(spark, source_path, self.lines.append)
        self.loaded = False
        self.interp.opened = self._open
        if load and store:
            self._open({"load"})

    def _open(self, options: set[str]) -> None:
        """The store's names come in with #catalog load or update, but with new the catalog starts empty."""
        if self.store and not self.loaded and "new" not in options and options & {"load", "update"} and catalog.exists(self.store):
            self.loaded = True
            catalog.load(self.interp, self.store)

    # --- scripts ---

    def run_script(self, text: str, filename: str = "", write: Callable[[str], None] | None = None) -> str:
        """Runs a program and returns what it printed; saves the catalog at the end if the program asks for update.

        A program that fails leaves names, types and the stored catalog as they were.
        """
        start = len(self.lines)
        names, types = self.interp.globals.names, self.interp.types
        before = {n: (b, b.value) for n, b in names.items()}, dict(types)
        try:
            self.interp.run(text, filename)
        except Exception:
            # a program takes effect as a whole: relvars are never changed in place, so names are all there is to restore
            names.clear()
            for n, (b, value) in before[0].items():
                b.value = value
                names[n] = b
            types.clear()
            types.update(before[1])
            raise
        if "update" in self.interp.options and self.store:
            catalog.save(self.interp, self.store)
        out = "\n".join(self.lines[start:])
        if write:
            write(out)
        return out

    def run_script_json(self, text: str) -> str:
        """{"ok": true, "value": printed text} or {"ok": false, "error": message}."""
        try:
            return json.dumps({"ok": True, "value": self.run_script(text)})
        except RelationError as e:
            return json.dumps({"ok": False, "error": str(e)})

    # --- native ---

    def evaluate(self, text: str) -> object:
        """The value of one expression."""
        (node, _, _), = Parser(text).program()
        return self.interp.value(node, Scope(self.interp.globals))

    def get_value(self, name: str) -> object:
        return self.interp.name(name, self.interp.globals)

    def set_value(self, name: str, value: object) -> None:
        value = Decimal(str(value)) if isinstance(value, int | float) and not isinstance(value, bool) else value
        have = self.interp.globals.names.get(name)
        if have is not None and have.kind == "value" and type_of(have.value) != type_of(value):
            raise RelationError(f"{name} has the type {type_of(have.value)}")
        self.interp.globals.names[name] = Binding("value", value, True)

    def call(self, name: str, *args: object) -> object:
        args = [Decimal(str(a)) if isinstance(a, int | float) and not isinstance(a, bool) else a for a in args]
        return self.interp.call(name, args, Scope(self.interp.globals))

    # --- JSON ---

    def call_json(self, name: str, *args: str) -> str:
        """Arguments and result as JSON; the function's parameter types say how to read arguments."""
        try:
            codes = self.interp.user(name, self.interp.globals) or []
            code = next((c for c in codes if len(c.params) == len(args)), None)
            if code is None:
                raise RelationError(f"no {name} takes {len(args)} arguments")
            values = [self.from_json(json.loads(a), t) for a, (_, t) in zip(args, code.params, strict=True)]
            return json.dumps({"ok": True, "value": self.to_json(self.call(name, *values))})
        except (RelationError, ValueError) as e:
            return json.dumps({"ok": False, "error": str(e)})

    def from_json(self, x: object, tag: object) -> object:
        if tag == "number":
            return Decimal(str(x))
        if tag == "time":
            return datetime.datetime.fromisoformat(x)
        if tag == "date":
            return datetime.date.fromisoformat(x)
        if tag == "binary":
            return bytes.fromhex(x)
        if isinstance(tag, tuple) and tag[0] == "user":
            return Tup({n: self.from_json(x[n], t) for n, t in self.interp.types[tag[1]]}, tag[1])
        if isinstance(tag, tuple) and tag[0] == "tup":
            return Tup({n: self.from_json(x[n], t) for n, t in tag[1].items()})
        if isinstance(tag, tuple):
            rows = [{n: self.from_json(r[n], t) for n, t in tag[1].items()} for r in x]
            if not rows:
                return Relation(self.interp.spark.createDataFrame([], spark_type(("tup", tag[1]), self.interp.types)))
            return self.interp.relation(rows, tag[1])
        return x

    def to_json(self, v: object) -> object:
        if isinstance(v, Decimal):
            return int(v) if v == v.to_integral_value() else float(v)
        if isinstance(v, bytes):
            return v.hex()
        if isinstance(v, datetime.date):
            return v.isoformat()
        if isinstance(v, Tup):
            return {k: self.to_json(x) for k, x in v.fields.items()}
        if isinstance(v, Relation):
            return [{f.name: self.to_json(value_of(r[f.name], f.dataType, self.interp.spark)) for f in v.df.schema} for r in v.df.toLocalIterator()]
        return v

    def describe(self) -> str:
        """Types, variables and operators as JSON, for clients that make their own bindings."""
        shown = lambda t: t if isinstance(t, str) else {"kind": t[0], "of": {n: shown(x) for n, x in t[1].items()} if isinstance(t[1], dict) else t[1]}
        names = self.interp.globals.names
        return json.dumps({
            "types": {n: [[f, shown(t)] for f, t in fields] for n, fields in self.interp.types.items()},
            "variables": {n: shown(type_of(b.value)) for n, b in names.items() if b.kind == "value"},
            "operators": {n: [[[p, shown(t)] for p, t in c.params] for c in b.value] for n, b in names.items() if b.kind == "fun"},
        })

    # --- REST names ---

    def rest(self, method: str, name: str, id: str | None = None, query: dict[str, str] | None = None, body: str | None = None) -> str:
        """GET x -> get_x, get_x_id, get_x_q; POST -> add_x; PUT -> put_x_id; DELETE -> delete_x_id.

        A query string becomes a relation {Key, Value}.
        """
        verb = {"GET": "get", "POST": "add", "PUT": "put", "DELETE": "delete"}[method.upper()]
        function = f"{verb}_{name}" + ("_id" if id is not None else "") + ("_q" if query else "")
        args = [json.dumps(id)] if id is not None else []
        if query:
            args.append(json.dumps([{"Key": k, "Value": v} for k, v in query.items()]))
        if body is not None:
            args.append(body)
        return self.call_json(function, *args)
