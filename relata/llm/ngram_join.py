"""N-gram Jaccard join: all pairs of texts whose sets of five-word shingles overlap by 0.8 or more.

1. Texts are brought to lower case with single blanks; those with one 128-bit digest are copies and
   stand for one numbered text (node) from here on, so copies are never paired.
2. MinHash banding finds candidates: 51 bands of 8 rows find a pair at the threshold with
   probability 0.9999. Only (band key, node) rows are shuffled. min() and max() over a key tell which
   keys several texts share, so no pairs are made; such keys give star edges, whose connected
   components hold every candidate pair.
3. A component is verified on full n-gram sets, taken from the texts: words and n-grams are numbered
   within the task, so nothing is hashed. It is cut into blocks, and each pair of blocks is a task of
   bounded size that counts the links of each text and keeps a spanning forest of them.
4. The forests' components are the classes.

A pair is a link if and only if it shares a band key and its sets overlap enough, however large its
component is. Components of more than `split` texts (chains of weak candidates, mostly) are not
compared all with all: there each shared band key is a unit of its own, and a pair counts at its first
one. Both ways find the same links; `split` says where the second costs less.

Defined results: a null text counts as empty; empty texts are copies of each other; a text of one
to four words has one shingle; a class is named by the least id in it; rows with the same id are
answered alike by text; a null id is never the least unless all are null; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import components, prepare, settle
from relata.llm.hashing import MinHash, bands_and_rows, digests, normal, shingles

ROWS, RECALL = 8, 0.9999
#: Texts of a block, and characters of each on average at most; component size from which band keys are units.
BLOCK, CHARS, SPLIT = 256, 16_384, 4096


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The set of each normal text's runs of n words, as numbers that equal runs share.

    Words are numbered by a dictionary, and runs of k + 1 words as pairs (run of k words, word), so
    equal numbers mean equal words. A text of fewer than n words has one run, all its words.
    """
    names: dict[str, int] = {}
    long, short = [], {}
    for i, text in enumerate(texts):
        own = [names.setdefault(w, len(names)) for w in text.split(" ")] if text else []
        long.append(np.array(own, dtype=np.int64) if len(own) >= n else np.zeros(0, dtype=np.int64))
        if 0 < len(own) < n:
            short[i] = text
    sizes = [len(x) for x in long]
    words, owner = np.concatenate([*long, np.zeros(0, dtype=np.int64)]), np.repeat(np.arange(len(texts)), sizes)
    left, run = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))), words
    for k in range(1, n):
        at = np.flatnonzero(left[: len(words) - k] > k) if k < len(words) else np.zeros(0, dtype=np.int64)
        run_, next_ = run[at], words[at + k]
        _, ids = np.unique(run_ * len(names) + next_, return_inverse=True)
        run = np.full(len(words), -1, dtype=np.int64)
        run[at] = ids
    at = np.flatnonzero(left >= n)
    pairs = np.unique(np.stack([owner[at], run[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), dtype=np.int64)
    out = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(texts))))
    whole: dict[str, int] = {}
    for i, text in short.items():
        out[i] = np.array([-1 - whole.setdefault(text, len(whole))], dtype=np.int64)
    return out


def _overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    n, sizes = len(sets), [len(s) for s in sets]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(n), sizes), counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse][shared]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, n), dtype=np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        block = np.zeros((n, min(width, int(column[-1]) + 1 - low)), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        total += block @ block.T
    return total


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent, kept = list(range(n)), []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = x, y
        while parent[rx] != rx:
            parent[rx] = rx = parent[parent[rx]]
        while parent[ry] != ry:
            parent[ry] = ry = parent[parent[ry]]
        if rx != ry:
            parent[rx] = ry
            kept.append((x, y))
    return kept


def verify(group: pd.DataFrame, threshold: float, n: int) -> pd.DataFrame:
    """Links of one pair of blocks: rows (node, other, links); other is null in counts, links 0 in edges."""
    group = group.drop_duplicates("node")
    sets = gram_sets(group.body.tolist(), n)
    size, block, node = np.array([len(s) for s in sets], dtype=np.float64), group.block.to_numpy(), group.node.to_numpy()
    both = _overlaps(sets)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if group.low.iat[0] != group.high.iat[0]:
        linked &= block[:, None] != block[None, :]
    key = group.key.iat[0]
    bands = np.array([np.frombuffer(b, dtype=np.int64) for b in group.bands])
    for i in range(len(sets)):
        at = np.flatnonzero(linked[i])
        if len(at):
            same = bands[at] == bands[i]
            linked[i, at] = same.any(axis=1) if key is None or pd.isna(key) else bands[i][same.argmax(axis=1)] == int(key)
    count = linked.sum(axis=1)
    a, b = np.nonzero(np.triu(linked))
    edges = _forest(len(sets), a, b)
    has = np.flatnonzero(count)
    return pd.DataFrame({
        "node": np.concatenate((node[has], node[[x for x, _ in edges]])).astype(np.int64),
        "other": pd.array([None] * len(has) + [int(node[y]) for _, y in edges], dtype="Int64"),
        "links": np.concatenate((count[has], np.zeros(len(edges)))).astype(np.int64),
    })


def similar(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, class_id, n_links (other texts it is linked with), n_copies (documents of its text)."""
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    bands = bands_and_rows(threshold, recall, rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            hashes, starts = shingles(texts, n)
            keys = minhash.keys(hashes, starts)
            offsets = np.concatenate(([0], np.cumsum(np.where(np.diff(starts) > 0, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[np.diff(starts) > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests(texts), pa.binary()), pa.array(map(len, texts), pa.int64()), lists], ["doc_id", "digest", "chars", "keys"])

    signed = settle(slim.mapInArrow(sign, f"doc_id {kind}, digest binary, chars long, keys array<long>"), "signed")
    counted = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.max("chars").alias("chars"))
    nodes = settle(counted.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are kept by the written table
    # The joins below are with tables that grow with the corpus: merged at every size, never broadcast.
    first = nodes.select("node", F.col("digest").alias("_digest"), F.col("least").alias("_least")).hint("merge")
    keyed = settle(signed.join(first, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_least"))).select("node", "keys"), "keyed")
    keyed = keyed.select("node", F.explode("keys").alias("key"))
    shared = settle(keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key", "a"), "keys")
    members = settle(keyed.join(shared.hint("merge"), "key").select("key", "a", "node").distinct(), "members")
    roots = components(members.select("a", F.col("node").alias("b")).where("a <> b").distinct())
    def parted(members: DataFrame, unit: str) -> DataFrame:
        """Members of units with the number of blocks of their unit: so many texts and characters a block."""
        sizes = members.groupBy(unit).agg(F.count("*").alias("m"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("chars") / (block * CHARS))).cast("int").alias("parts"))
        return members.join(sizes, unit)

    sized = parted(roots.join(nodes.select("node", "chars").hint("merge"), "node"), "root")
    whole = sized.where(F.col("m") <= split).select(F.col("root").alias("unit"), F.lit(None).cast("long").alias("key"), "node", "parts")
    cut = parted(members.join(sized.where(F.col("m") > split).select("node", "chars"), "node"), "key").select(F.col("key").alias("unit"), "key", "node", "parts")
    units = settle(whole.union(cut), "units")

    wanted = units.select("node").distinct().join(nodes, "node").select("node", F.col("digest").alias("_digest"), F.col("least").alias("_least"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            keys = minhash.keys(*shingles(texts, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests(texts), pa.binary()), pa.array(texts, pa.string()), pa.array([k.tobytes() for k in keys], pa.binary())], ["doc_id", "digest", "body", "bands"])

    ids = wanted.select(F.col("_least").alias("_id")).distinct().hint("merge")
    loaded = slim.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(load, f"doc_id {kind}, digest binary, body string, bands binary")
    bodies = loaded.join(wanted.hint("merge"), (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_least"))).select("node", "body", "bands")
    placed = units.select("unit", "key", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("partner"))
    placed = placed.select("unit", "key", "node", "block", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"))
    met = bodies.join(placed, "node").select("unit", "low", "high", "node", "block", "key", "body", "bands")
    found = settle(met.groupBy("unit", "low", "high").applyInPandas(lambda g: verify(g, threshold, n), "node long, other long, links long"), "links")

    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = settle(named.select("digest", "root", "least", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(least, "root").select("digest", "class_id", "n_links", "n_copies")
    return signed.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents of docs but those that are not the least id of their class. A row with a null id stays."""
    id_col = options.get("id_col", "doc_id")
    gone = similar(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone._gone, "left_anti")
