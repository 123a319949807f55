"""Byte-level BPE encoding and decoding by ranks, with a segment tree over byte positions.

A pretoken's bytes are the leaves of a tree; leaf i holds (rank of the pair that starts at byte i,
i), so the root is the leftmost pair of least rank. A merge changes three leaves (the merged pair's
own, its right half's and its left neighbour's) and their ancestors: O(log n) for each merge.
Short pretokens are merged many at a time in numpy (one tree a row), long ones one by one.

The pattern's matches (pretokens) are independent, so their ids are remembered. The memory is bounded;
what it cannot hold is encoded again. Texts in Latin-1 are cut by a byte pattern that says the same
as the public one; others by the pattern itself.

Defined results: a null text is encoded as an empty one (no ids); every row is answered on its own,
so repeated rows and repeated ids give repeated answers; extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import prepare

#: A public pattern, and Latin-1's letters, numbers and white space in its sense.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
L, N, S = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\t-\r \x85\xa0"
LATIN = re.compile(b" ?[%b]+|'(?:s|t|re|ve|m|ll|d)| ?[%b]+| ?[^%b%b%b]+|[%b]+(?![^%b])|[%b]+" % (L, N, S, L, N, S, S, S))
NO_PAIR = np.int64(1 << 40)
ROW_BYTES = 64


class ByteBPE:
    """Encoder and decoder for one rank file (lines of base64 token, space, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 250_000):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.latin = LATIN.findall if pattern == KNOWN else None
        self.remember = remember
        self.digits: dict[str | bytes, bytes] = {}
        self.decoded: dict[str | bytes, bytes] = {}
        self.written = {i: b"%d," % i for i in self.tokens}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], NO_PAIR)

    @classmethod
    def from_file(cls, path: str, pattern: str, **options) -> ByteBPE:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern, **options)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_PAIR)

    def merge_long(self, data: bytes) -> list[int]:
        """Ids of one pretoken by a segment tree of Python integers."""
        n = len(data)
        width = 1 << max(n - 1, 1).bit_length()
        shift, pairs = width.bit_length(), self.pairs
        none = 1 << 62
        ids = [int(self.byte_ids[b]) for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best
                node >>= 1

        while (root := tree[1]) < none:
            i = root & ((1 << shift) - 1)
            j = after[i]
            ids[i] = root >> shift
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1 or tree[width + j] < none:
                put(j, none)
            rank = None
            if k < n:
                before[k] = i
                rank = pairs.get(ids[i] << 20 | ids[k])
            put(i, none if rank is None else rank << shift | i)
            if (p := before[i]) >= 0:
                rank = pairs.get(ids[p] << 20 | ids[i])
                put(p, none if rank is None else rank << shift | p)
        return [x for x in ids if x >= 0]

    def merge_rows(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many pretokens of at most ROW_BYTES bytes: one tree a row, one merge of each row a step."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words])
        low = 0
        for width in (4, 8, 16, 32, ROW_BYTES):
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for start in range(0, len(own), 4096):
                part = own[start : start + 4096]
                ids = self._merge_block([words[i] for i in part], sizes[part], width)
                for i, row in zip(part.tolist(), ids.tolist(), strict=True):
                    out[i] = [x for x in row if x >= 0]
        return out

    def _merge_block(self, words: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
        m, shift = len(words), 7
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(m, width)
        inside = np.arange(width) < sizes[:, None]
        ids = np.where(inside, self.byte_ids[raw], -1)
        after = np.tile(np.arange(1, width + 1), (m, 1))
        before = np.tile(np.arange(-1, width - 1), (m, 1))
        tree = np.full((m, 2 * width), NO_PAIR << shift, dtype=np.int64)
        rank = self._rank(np.where(inside, ids, 0)[:, :-1], np.where(inside, ids, 0)[:, 1:])
        rank = np.where(inside[:, 1:], rank, NO_PAIR)
        tree[:, width : 2 * width - 1] = rank << shift | np.arange(width - 1)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.arange(m)
        while True:
            rows = rows[tree[rows, 1] < NO_PAIR << shift]
            if not len(rows):
                return ids
            root = tree[rows, 1]
            i = root & (1 << shift) - 1
            j = after[rows, i]
            new = root >> shift
            k = after[rows, j]
            ids[rows, i], ids[rows, j], after[rows, i] = new, -1, k
            has = k < sizes[rows]
            before[rows[has], k[has]] = i[has]
            right = np.where(has, ids[rows, np.minimum(k, width - 1)], 0)
            p = before[rows, i]
            left = np.where(p >= 0, ids[rows, p], 0)
            tree[rows, width + j] = NO_PAIR << shift
            tree[rows, width + i] = np.where(has, self._rank(new, right), NO_PAIR) << shift | i
            some, q = rows[p >= 0], p[p >= 0]
            tree[some, width + q] = self._rank(left[p >= 0], new[p >= 0]) << shift | q
            ups = [(rows, width + i), (rows, width + j), (some, width + q)]
            while ups[0][1][0] > 1:
                ups = [(r, node >> 1) for r, node in ups]
                for r, node in ups:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    def _learn(self, pieces: list[str | bytes]) -> None:
        ids: list[list[int] | None] = []
        short = []
        for piece in pieces:
            data = piece.decode("latin-1").encode() if type(piece) is bytes else piece.encode()
            if (rank := self.ranks.get(data)) is not None:
                ids.append([rank])
            elif len(data) > ROW_BYTES:
                ids.append(self.merge_long(data))
            else:
                short.append((len(ids), data))
                ids.append(None)
        for (i, _), own in zip(short, self.merge_rows([d for _, d in short]), strict=True):
            ids[i] = own
        write = self.written.__getitem__
        for piece, own in zip(pieces, ids, strict=True):
            self.digits[piece] = b"".join(map(write, own))
            self.decoded[piece] = self.decode(own)

    def pretokens(self, text: str) -> list[str] | list[bytes]:
        if self.latin is not None:
            try:
                return self.latin(text.encode("latin-1"))
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def encode_batch(self, texts: Iterable[str]) -> Iterator[tuple[bytes, int, bytes]]:
        """For each text: its ids in decimal, each with a comma after it; their number; the bytes decoded from them."""
        lists = [self.pretokens(t) for t in texts]
        fresh = list(set(filterfalse(self.digits.__contains__, chain.from_iterable(lists))))
        self._learn(fresh)
        digits, decoded = self.digits.__getitem__, self.decoded.__getitem__
        for pieces in lists:
            written = b"".join(map(digits, pieces))
            yield written, written.count(b","), b"".join(map(decoded, pieces))
        if len(self.digits) > self.remember:
            for piece in fresh:
                del self.digits[piece], self.decoded[piece]

    def encode(self, text: str) -> list[int]:
        (digits, _, _), = self.encode_batch([text])
        return [int(x) for x in digits.split(b",")[:-1]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[tuple, ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each rank file and process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteBPE.from_file(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, ids_sha256, decoded_sha256, and on request ids.

    No shuffle: a map over Arrow batches. A null text counts as empty. ids_sha256 is over the
    decimal ids joined by commas, decoded_sha256 over the bytes decoded from the ids.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha, ids = [], [], [], []
            for digits, count, decoded in bpe.encode_batch(batch.column(1).to_pylist()):
                n.append(count)
                ids_sha.append(hashlib.sha256(digits[:-1]).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in digits.split(b",")[:-1]])
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return slim.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from arrays of ids: rows (doc_id, text); null ids give an empty text; an id outside the ranks is an error."""
    prepare(encoded.sparkSession)
    slim = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return slim.mapInArrow(decode, f"doc_id {kind}, text string")
