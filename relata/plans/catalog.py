"""What a session knows, as relations, and its persistence.

A saved catalog is a folder: a parquet folder for each version of a relvar, and catalog.json, which is
written last and names the versions that count; so a save that breaks off leaves the old state.
"""

from __future__ import annotations

import json
import uuid
from decimal import Decimal

from pyarrow import fs

from relata.plans.values import Code, Tup, type_of
from relata.relation import Relation


def _shown(tag: object) -> str:
    if isinstance(tag, str):
        return tag
    if tag[0] == "user":
        return tag[1]
    return "relation" if tag[0] == "rel" else "tuple"


def system_relation(interp, name: str) -> Relation:
    rows, schema = [], "Name string, Kind string, Type string, Value string"
    for n, b in sorted(interp.globals.names.items()):
        if b.kind == "fun":
            for c in b.value:
                rows.append((n, "operator", _shown(c.result) if c.result else "any", ",".join(p for p, _ in c.params)))
        else:
            rows.append((n, "variable" if b.kind == "value" else "deferred", _shown(type_of(b.value)) if b.kind == "value" else "any", ""))
    if name.endswith("_variable"):
        return Relation.literal(interp.spark, [(n, t) for n, k, t, _ in rows if k == "variable"], "Name string, Type string")
    if name.endswith("_operator"):
        return Relation.literal(interp.spark, [(n, t, v) for n, k, t, v in rows if k == "operator"], "Name string, Type string, Arguments string")
    if name.endswith("_member"):
        members = [(n, f, _shown(t)) for n, fields in interp.types.items() for f, t in fields]
        return Relation.literal(interp.spark, members, "Name string, Member string, Type string")
    return Relation.literal(interp.spark, rows, schema)


def _encode(v: object) -> object:
    if isinstance(v, Decimal):
        return {"number": str(v)}
    if isinstance(v, bytes):
        return {"binary": v.hex()}
    if isinstance(v, Tup):
        return {"tuple": {k: _encode(x) for k, x in v.fields.items()}, "user": v.user}
    if hasattr(v, "isoformat"):
        return {"time" if hasattr(v, "hour") else "date": v.isoformat()}
    return v


def _decode(v: object) -> object:
    import datetime

    if not isinstance(v, dict):
        return v
    if "number" in v:
        return Decimal(v["number"])
    if "binary" in v:
        return bytes.fromhex(v["binary"])
    if "time" in v:
        return datetime.datetime.fromisoformat(v["time"])
    if "date" in v:
        return datetime.date.fromisoformat(v["date"])
    return Tup({k: _decode(x) for k, x in v["tuple"].items()}, v["user"])


def save(interp, folder: str) -> None:
    """Write all names but transient ones (@ and _)."""
    entries, version = [], uuid.uuid4().hex
    for n, b in interp.globals.names.items():
        if n[0] in "@_":
            continue
        if b.kind in ("fun", "defer"):
            sources = [c.source for c in b.value] if b.kind == "fun" else [b.source]
            entries.append({"name": n, "sources": sources})
        elif isinstance(b.value, Relation) and b.value.columns:
            path = f"{folder}/{uuid.uuid4().hex}-{version}.parquet"
            b.value.df.write.parquet(path)
            entries.append({"name": n, "path": path, "keys": [sorted(k) for k in b.value.keys], "variable": b.variable})
        elif isinstance(b.value, Relation):
            entries.append({"name": n, "rows": b.value.count(), "variable": b.variable})
        elif isinstance(b.value, Code):
            entries.append({"name": n, "sources": [f"{n} := {b.value.source}"], "variable": b.variable})
        else:
            entries.append({"name": n, "value": _encode(b.value), "variable": b.variable})
    types = [[n, [[f, t] for f, t in fields]] for n, fields in interp.types.items()]
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/.catalog-{version}") as out:
        out.write(json.dumps({"types": types, "entries": entries}).encode())
    store.move(f"{base}/.catalog-{version}", f"{base}/catalog.json")


def _tag(t: object) -> object:
    return t if isinstance(t, str) else (t[0], {k: _tag(x) for k, x in t[1].items()} if isinstance(t[1], dict) else t[1])


def exists(folder: str) -> bool:
    store, base = fs.FileSystem.from_uri(folder)
    return store.get_file_info(f"{base}/catalog.json").type == fs.FileType.File


def load(interp, folder: str) -> None:
    from relata.plans.interp import Binding

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/catalog.json") as source:
        state = json.loads(source.read())
    interp.types |= {n: [(f, _tag(t)) for f, t in fields] for n, fields in state["types"]}
    for e in state["entries"]:
        if "path" in e:
            interp.globals.names[e["name"]] = Binding("value", Relation(interp.spark.read.parquet(e["path"]), e["keys"]), e["variable"])
        elif "rows" in e:
            interp.globals.names[e["name"]] = Binding("value", Relation(interp.spark.range(e["rows"]).select()), e["variable"])
        elif "value" in e:
            interp.globals.names[e["name"]] = Binding("value", _decode(e["value"]), e["variable"])
    for e in state["entries"]:
        for source in e.get("sources", ()):
            interp.run(source, interactive=False)
