"""Line dedup by a deletion-neighbourhood join: a line goes if an earlier one lies within one edit.

Lines are compared without outer white space. Every line that then holds a character takes part;
a caller may leave those shorter than min_chars alone. Earlier means less (document id, line
number). An edit inserts, deletes or replaces one character, so of lines of one character only the
first stays.

1. Equal lines meet by a 128-bit digest; the earliest occurrence stands for them, so copies are joined once.
2. Two lines within one edit share their first or second half (cut at half the shorter length).
   Each line emits its hashed halves, for its own length and for one less; only lines that share a
   half with a different line go on. min() and max() over a half tell that, combined map-side.
3. Those emit all variants with one character deleted from the half that is not shared, as
   hashed keys. Lines of equal length replace one character if they agree without it at the same
   place; a line lies one insertion away if it equals a variant. Equal keys are joined; as lines are
   distinct, a key's group is at most an alphabet large. Each line meets the earliest of each group.
4. What met is verified by its edit distance on the texts. A line with a partner that fails there
   (its hash collides) and none that holds is joined once more, with all of its groups' members.

A line goes if any earlier line within one edit exists, also one that goes itself.

Defined results: a null text stays null, with no lines; an empty text has one empty line; rows with
equal id and text count as one document, and a null id comes first; documents that lose all lines
stay with an empty text; other columns are kept as they are, but n_chars is counted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relata.llm.common import prepare, settle, unused
from relata.llm.hashing import BASE, POINT, Ranges, U, digest_halves, mix, points

MIN_CHARS = 1
#: Places of a line whose variants go in one batch, so that a long line's don't fill a worker.
PLACES = 1 << 16
#: Which half two lines share: first or second, at a line's own length or at one less.
OWN_FIRST, OWN_SECOND, LESS_FIRST, LESS_SECOND = 1, 2, 4, 8


def halves(lines: list[str]) -> np.ndarray:
    """Each line's four keys (OWN_FIRST, OWN_SECOND, LESS_FIRST, LESS_SECOND)."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    end = np.cumsum(size)
    start = end - size
    ranges = Ranges(POINT[points("".join(lines))])
    keys = np.empty((len(lines), 4), dtype=np.uint64)
    for i in range(4):
        length = size - (i > 1)
        half = length // 2
        low, high = (start, start + half) if i % 2 == 0 else (end - (length - half), end)
        keys[:, i] = mix(ranges.raw(low, high) * BASE + length.astype(np.uint64) * U(4) + U(i % 2))
    return keys.view(np.int64)


def variants(line: str, flags: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of keys and kinds: 0 replace (with the place), 1 the line itself, 2 the line less one character."""
    ranges, n = Ranges(POINT[points(line)]), len(line)

    def keyed(hashes: np.ndarray, length: int, kind: int, places: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        space = 0 if kind == 0 else 1
        keys = np.unique(mix((hashes * BASE + U(length)) * BASE + np.asarray(places, dtype=np.uint64) * U(2) + U(space)))
        return keys.view(np.int64), np.full(len(keys), kind, dtype=np.int8)

    half, less = n // 2, (n - 1) // 2
    if flags & (OWN_FIRST | OWN_SECOND):
        yield keyed(ranges.raw(np.array([0]), np.array([n])), n, 1, 0)
    for kind, low, high in (
        (0, 0 if flags & OWN_SECOND else half, n if flags & OWN_FIRST else half),
        (2, 0 if flags & LESS_SECOND else less, n if flags & LESS_FIRST else less + 1),
    ):
        if not flags & ((OWN_FIRST | OWN_SECOND) if kind == 0 else (LESS_FIRST | LESS_SECOND)):
            continue
        for first in range(low, high, PLACES):
            at = np.arange(first, min(first + PLACES, high))
            yield keyed(ranges.without(at), n if kind == 0 else n - 1, kind, at if kind == 0 else 0)


def within_one(a: str, b: str) -> bool:
    """Whether one edit at most lies between two lines; linear, where a table of distances is not."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # the common beginning's length lies between
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return (a[low + 1 :] if len(a) == len(b) else a[low:]) == b[low + 1 :]


def _eligible(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if len(s := x.strip()) >= min_chars]


def dropped_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines that go: rows (doc_id, tag, line), tag being the hash of the text that holds the line."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_eligible(t, min_chars) for t in batch.column(2).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            contents = [c for x in found for _, c in x]
            digest, keys = digest_halves(contents), halves(contents)
            taken = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "tag"]).take(pa.array(row))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * 4), pa.array(keys.reshape(-1)))
            numbers = pa.array([i for x in found for i, _ in x], pa.int32())
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), numbers, pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["doc_id", "tag", "line", "h", "g", "keys"])

    lines = settle(slim.mapInArrow(cut, f"doc_id {kind}, tag long, line int, h long, g long, keys array<long>"), "lines")
    place = F.struct("doc_id", "line", "tag")
    first = settle(lines.groupBy("h", "g").agg(F.min(place).alias("first")), "first")

    keyed = lines.select("h", "g", F.posexplode("keys").alias("i", "key"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("h", "g") for n, f in (("min", F.min), ("max", F.max))]
    shared = settle(keyed.groupBy("key").agg(*ends).where("min_h <> max_h or min_g <> max_g").select("key"), "shared")
    near = settle(keyed.join(shared, "key", "left_semi").groupBy("h", "g").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("flags")), "near")
    wanted = near.join(first, ["h", "g"]).groupBy(F.col("first.doc_id").alias("_id"), F.col("first.tag").alias("_tag")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h", "g", "flags")).alias("wanted"))
    source = slim.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("doc_id", "text", "wanted")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "line", "h", "g", "content", "keys", "kinds"]
        for batch in batches:
            for doc_id, text, rows in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, out, held = text.split("\n"), [], 0
                for r in rows:
                    content = parts[r["line"]].strip()
                    for i, (keys, kinds) in enumerate(variants(content, r["flags"])):
                        out.append((r["line"], r["h"], r["g"], None if i else content, keys, kinds))
                        held += len(keys)
                        if held >= PLACES:
                            yield packed(doc_id, out, names)
                            out, held = [], 0
                if out:
                    yield packed(doc_id, out, names)

    def packed(doc_id: pa.Scalar, out: list[tuple], names: list[str]) -> pa.RecordBatch:
        line, h, g, content, keys, kinds = zip(*out, strict=True)
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (keys, kinds)]
        return pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(out), doc_id.type), pa.array(line, pa.int32()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(content, pa.string()), *lists], names)

    survivors = settle(source.mapInArrow(emit, f"doc_id {kind}, line int, h long, g long, content string, keys array<long>, kinds array<tinyint>"), "survivors")
    me = F.struct("doc_id", "line", "h", "g")
    spread = survivors.select(me.alias("me"), F.explode(F.arrays_zip("keys", "kinds")).alias("v")).select("me", F.col("v.keys").alias("key"), F.col("v.kinds").alias("kind")).distinct()
    content = survivors.where("content is not null").select("h", "g", "content").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = [within_one(a.as_py(), b.as_py()) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(holds, pa.bool_())], ["h", "g", "holds"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs of lines (me, other) as (h, g, holds), by the edit distance of their texts."""
        ids = pairs.select(F.col("me.h").alias("h"), F.col("me.g").alias("g"), F.col("other.h").alias("oh"), F.col("other.g").alias("og")).distinct()
        both = ids.join(content, ["h", "g"]).join(content.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("content").alias("earlier")), ["oh", "og"])
        return settle(both.select("h", "g", "content", "earlier").mapInArrow(compare, "h long, g long, holds boolean"), name)

    group = W.partitionBy("key")
    own = lambda k: F.min(F.when(F.col("kind") == k, F.col("me"))).over(group)
    met = spread.withColumns({"same": own(0), "full": own(1), "longer": own(2)})
    best = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("longer")).otherwise(F.col("full"))
    checked = verified(met.select("me", best.alias("other")).where("other < me"), "checked")
    gone = checked.where("holds").select("h", "g").distinct()
    missed = settle(checked.where("not holds").select("h", "g").distinct().join(gone, ["h", "g"], "left_anti"), "missed")
    if not missed.isEmpty():
        again = spread.join(missed, (F.col("me.h") == missed.h) & (F.col("me.g") == missed.g), "left_semi")
        other = spread.select(F.col("key").alias("k"), F.col("kind").alias("other_kind"), F.col("me").alias("other"))
        every = again.join(other, (F.col("key") == F.col("k")) & (F.col("kind") + F.col("other_kind") == F.when(F.col("kind") == 0, 0).otherwise(3)) & (F.col("other") < F.col("me")))
        gone = gone.union(verified(every.select("me", "other"), "rechecked").where("holds").select("h", "g").distinct())
    gone = settle(gone, "gone")

    marks = first.join(gone.withColumn("near", F.lit(True)), ["h", "g"], "left")
    hit = lines.select("doc_id", "tag", "line", "h", "g").join(marks, ["h", "g"])
    again = ~place.eqNullSafe(F.col("first"))
    return hit.where(again | F.col("near")).select("doc_id", "tag", "line").distinct()


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines gone, and columns n_lines and n_dropped after its own (in place of such ones that it has)."""
    gone = dropped_lines(docs, min_chars=min_chars, id_col=id_col, text_col=text_col)
    i, t, d, own = unused(docs, "_id", "_tag", "_drop", "_own")
    drops = settle(gone.groupBy(F.col("doc_id").alias(i), F.col("tag").alias(t)).agg(F.collect_list("line").alias(d)), "drops")
    parts, drop = F.split(docs[text_col], "\n", -1), F.col(d)
    tagged = docs.withColumn(own, F.xxhash64(docs[text_col]))
    both = tagged.join(drops, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(t)), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)
    text = F.when(drop.isNull(), docs[text_col]).otherwise(F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n"))
    columns = {c: docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")} | {text_col: text.alias(text_col)}
    if "n_chars" in columns and text_col != "n_chars":
        columns["n_chars"] = F.when(drop.isNull(), docs["n_chars"]).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return both.select(*columns.values(), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).alias("n_dropped"))
