"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A file part-NNNNNN.rec holds one record a document, in ascending order of document id over all
files. A record is framed as

    length   8 bytes, little endian, of the data
    check    4 bytes, masked CRC-32 of those 8 bytes
    data     flag (1 byte, 1 if the id is not null), id (8 bytes), ids (2 or 4 bytes each)
    check    4 bytes, masked CRC-32 of the data

where masked means rotated right by 15 bits plus a constant, so that a checksum of data that holds
checksums stays sound. part-NNNNNN.idx holds flag, id and offset of each record (17 bytes) and their
masked CRC-32 (4 bytes). A reader in file order checks every record against the index. Files are
written under a temporary name and moved, so a task that runs again leaves one whole file.

The tokenizer ignores white space but as a boundary, so the ids of a text are those of its words
in a row; ids of words are remembered up to a bound.

Defined results: a null text counts as empty (the end id alone); a null id sorts first; rows of
equal id are ordered by their text's hash; extra columns are not read; an empty table gives no files;
ids are stored as 64-bit integers, and an id that is no number is an error. The manifest's running
count of ids is a window in one task, over a row a file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from relata.llm.common import prepare, settle, shared_dir

MASK_DELTA = 0xA282EAD8
HEAD, ENTRY = "<Bq", "<BqQ"
HEAD_BYTES, ENTRY_BYTES = struct.calcsize(HEAD), struct.calcsize(ENTRY) + 4
REMEMBER = 250_000
#: Fixed value: the lower-case letters of Latin-1.
LETTERS = "a-zªºµß-öø-ÿ"
#: Latin-1 without control characters other than white space, and its lower case.
USUAL = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])
LOWER = bytes(ord(chr(c).lower()) if c != 0xB5 else c for c in range(256))


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked_crc(length)), data, struct.pack("<I", masked_crc(data))))


def read_frame(stream) -> bytes | None:
    """The next record's data; None at the end; ValueError if a length or checksum does not hold."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("a record's length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked_crc(body[:n]):
        raise ValueError("a record's data is damaged")
    return body[:n]


def entry(known: bool, doc_id: int, offset: int) -> bytes:
    data = struct.pack(ENTRY, known, doc_id, offset)
    return data + struct.pack("<I", masked_crc(data))


def read_entries(stream) -> Iterator[tuple[int, int, int]]:
    """(flag, id, offset) of each entry of an index; ValueError if a checksum does not hold."""
    while block := stream.read(ENTRY_BYTES * 65536):
        if len(block) % ENTRY_BYTES:
            raise ValueError("an index is cut off")
        for at in range(0, len(block), ENTRY_BYTES):
            data = block[at : at + ENTRY_BYTES]
            if struct.unpack_from("<I", data, ENTRY_BYTES - 4)[0] != masked_crc(data[:-4]):
                raise ValueError("an index entry is damaged")
            yield struct.unpack_from(ENTRY, data)


class WordTokenizer:
    """Ids of texts by a tokenizer file, as little-endian integers of `width` bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memory: dict[str | bytes, bytes] = {}
        letters, white = LETTERS.encode("latin-1"), rb" \t-\r"
        self.plain = re.compile(b"[%b]+|[^%b%b]+" % (letters, letters, white)).findall
        self.quoted = re.compile(b"[^%b']*'[^%b]*|[%b]+|[^%b%b]+" % (white, white, letters, letters, white)).findall
        self.letters = re.compile(b"[%b]+" % letters).fullmatch

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), 4096):
            for got in self.tokenizer.encode_batch_fast(words[start : start + 4096], add_special_tokens=False):
                yield np.array(got.ids, dtype=self.dtype).tobytes()

    def _encode_letters(self, words: list[str]) -> Iterator[bytes]:
        """Words of letters only, thousands in one call: the last token of each ends a word."""
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            whole = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]  # keeps no offsets
            ids = np.array(whole.ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                yield from self._encode(part)
                continue
            data, stops = ids.tobytes(), stops * self.width
            yield from (data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True))

    def _learn(self, pieces: list[str | bytes]) -> None:
        words = [p for p in pieces if type(p) is bytes and self.letters(p)]
        self.memory.update(zip(words, self._encode_letters([w.decode("latin-1") for w in words]), strict=True))
        rest = [p for p in pieces if p not in self.memory]
        self.memory.update(zip(rest, self._encode([p.decode("latin-1") if type(p) is bytes else p for p in rest]), strict=True))

    def pieces(self, text: str) -> list[str] | list[bytes]:
        """Parts whose ids in a row are the text's.

        The tokenizer cuts at white space and between letters and other characters, but for
        apostrophes, and reads lower case. In Latin-1, lower case and the normal form don't depend on
        neighbours, so words are looked up in lower case and without marks, as bytes; other texts are
        cut at blanks alone.
        """
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            data = None
        if data is None or data.translate(None, USUAL) or b"<|" in data:
            return text.replace("\n", " ").split(" ")
        return (self.quoted if b"'" in data else self.plain)(data.translate(LOWER))

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        lists = [self.pieces(t) for t in texts]
        fresh = list(set(filterfalse(self.memory.__contains__, chain.from_iterable(lists))))
        self._learn(fresh)
        get = self.memory.__getitem__
        for pieces in lists:
            yield b"".join(map(get, pieces))
        if len(self.memory) > REMEMBER:
            for piece in fresh:
                del self.memory[piece]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id and write files; returns the manifest.

    One range shuffle on (id, hash of text) puts documents in order; sorting spills, and a file is
    written as its rows arrive, so memory does not grow with a file. The manifest has a row a file:
    part, file, width, n_docs, n_ids, n_bytes, start (ids in all files before it).
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or f"{shared_dir(spark)}/tokens"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        words, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=words.dtype).tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, mark = f"part-{part:06d}", uuid.uuid4().hex
        own = {ext: f"{base}/.{name}-{mark}.{ext}" for ext in ("rec", "idx")}
        n_docs = n_ids = offset = 0
        with store.open_output_stream(own["rec"]) as records, store.open_output_stream(own["idx"]) as index:
            batch = first
            while batch is not None:
                ids = batch.column(0).to_pylist()
                for doc_id, tokens in zip(ids, words.encode_batch(batch.column(1).to_pylist()), strict=True):
                    key = (doc_id is not None, doc_id or 0)
                    record = frame(b"".join((struct.pack(HEAD, *key), tokens, end)))
                    index.write(entry(*key, offset))
                    records.write(record)
                    offset += len(record)
                    n_docs += 1
                    n_ids += (len(tokens) + len(end)) // words.width
                batch = next(batches, None)
        for ext, temporary in own.items():
            store.move(temporary, f"{base}/{name}.{ext}")
        yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{folder}/{name}.rec", "width": words.width, "n_docs": n_docs, "n_ids": n_ids, "n_bytes": offset}])

    manifest = settle(ordered.mapInArrow(write, "part long, file string, width long, n_docs long, n_ids long, n_bytes long"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every record of the files, its frame and its index entry verified: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; ids_crc32 is the unsigned CRC-32 of its ids as
    little-endian unsigned 32-bit integers. A file streams through its task record by record.
    """
    spark = manifest.sparkSession
    prepare(spark)
    files = manifest.select("file", "width", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["file"])
                at, out, offset = row["start"], [], 0
                with store.open_input_stream(path, buffer_size=1 << 20) as stream, store.open_input_stream(path[:-3] + "idx") as index:
                    entries = read_entries(index)
                    while (data := read_frame(stream)) is not None:
                        known, doc_id = struct.unpack_from(HEAD, data)
                        if next(entries, None) != (known, doc_id, offset):
                            raise ValueError("a record and its index entry differ")
                        offset += len(data) + 16
                        ids = np.frombuffer(data, dtype=f"<u{row['width']}", offset=HEAD_BYTES)
                        out.append((doc_id if known else None, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                            out = []
                    if next(entries, None) is not None:
                        raise ValueError("an index has more entries than there are records")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_index(manifest: DataFrame) -> DataFrame:
    """The offset index as a table: doc_id, file, offset; shuffle or filter it and hand it to read_at."""
    prepare(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(file[:-3] + "idx")
                with store.open_input_stream(path) as stream:
                    entries = read_entries(stream)
                    while rows := list(islice(entries, 65536)):
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i if k else None for k, i, _ in rows], pa.int64()), "file": [file] * len(rows), "width": pa.array([width] * len(rows), pa.int64()), "offset": pa.array([o for _, _, o in rows], pa.int64())})

    return manifest.select("file", "width").mapInArrow(read, "doc_id long, file string, width long, offset long")


def read_at(index: DataFrame) -> DataFrame:
    """Records at given offsets, in the order in which the index rows come: doc_id, ids."""
    prepare(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] not in open_files:
                    if len(open_files) > 64:
                        open_files.popitem()[1].close()
                    store, path = fs.FileSystem.from_uri(row["file"])
                    open_files[row["file"]] = store.open_input_file(path)
                stream = open_files[row["file"]]
                stream.seek(row["offset"])
                data = read_frame(stream)
                out.append(np.frombuffer(data, dtype=f"<u{row['width']}", offset=HEAD_BYTES).tolist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(out, pa.list_(pa.int64()))})

    return index.select("doc_id", "file", "width", "offset").mapInArrow(read, "doc_id long, ids array<long>")


def token_records(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents and read the files back."""
    return read_token_files(write_token_files(docs, tokenizer_path, end_id=end_id))
