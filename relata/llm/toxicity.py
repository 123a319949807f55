"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's odds come from the words in it and their beginnings; a document is toxic if any of its sentences is, so its
score is the noisy-or 1 - prod(1 - p) of its sentences. Only documents carry labels; gradients pass
through the noisy-or to the sentences, which are thereby located without labels of their own.

The model is fitted on the driver from a bounded sample of labelled documents (max_docs and max_bytes,
taken in order of a hash) and holds at most max_words weights. Scoring is a map over whole texts.

Defined results: a null text counts as empty, and an empty text scores 0; labels that are null are
left out; with no labelled document of either kind all scores are 0; a null id is never held out;
repeated rows get equal scores; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.llm.common import prepare

MAX_DOCS, MAX_BYTES, MAX_WORDS, MEMORY = 6000, 24_000_000, 20_000, 400_000
SENTENCE = r"[^.!?\n]+[.!?]*"
WORD = r"[^\W\d_]+"
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bags(texts: list[str]) -> tuple[list[set[str]], np.ndarray]:
    """The sets of words of all sentences that hold words, and where each text's start."""
    sentence, word = re.compile(SENTENCE), re.compile(WORD)
    out, starts = [], [0]
    for text in texts:
        out += [set(w) for s in sentence.findall(text.lower()) if (w := word.findall(s))]
        starts.append(len(out))
    return out, np.array(starts)


def marks(word: str) -> list[str]:
    """What a word is known by: itself and its beginnings, as insults are inflected."""
    return ["=" + word, *("^" + word[:n] for n in (3, 4, 5) if len(word) > n)]


@dataclass
class Model:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)
    memory: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "memory": {}}

    def _learn(self, words: set[str]) -> None:
        get = self.weights.get
        for w in words:
            self.memory[w] = sum([get(m, 0.0) for m in marks(w)])

    def logits(self, sentences: list[set[str]]) -> np.ndarray:
        """Log odds of each sentence: the bias and the weights of its words."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        self._learn(set(filterfalse(self.memory.__contains__, chain.from_iterable(sentences))))
        get = self.memory.__getitem__
        return self.bias + np.array([sum(map(get, s)) for s in sentences], dtype=np.float64)

    def scores(self, texts: list[str]) -> np.ndarray:
        sentences, starts = bags(texts)
        total = np.concatenate(([0.0], np.cumsum(np.logaddexp(0, self.logits(sentences)))))
        return -np.expm1(-(total[starts[1:]] - total[starts[:-1]]))

    def located(self, text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence at or above the threshold, in code points."""
        found, word = [], re.compile(WORD)
        for m in re.finditer(SENTENCE, text):
            words = set(word.findall(m[0].lower()))
            p = float(1 / (1 + np.exp(-self.logits([words])[0]))) if words else 0.0
            if p >= threshold:
                found.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), p))
        return found


def fit(texts: list[str], labels: list[int], *, max_words: int = MAX_WORDS, rounds: int = 400, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """Full-batch Adam on the documents' log loss.

    Marks take part that at least three toxic documents hold, and so much more often than others
    that chance hardly explains it (four standard errors); the rest of the vocabulary is noise to a
    noisy-or over many sentences.
    """
    y = np.array(labels, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return Model()
    # words and marks as numbers from here on: a sample's strings are held once
    words: dict[str, int] = {}
    names: dict[str, int] = {}
    marks_of: list[list[int]] = []
    own_words, own_sizes, counts = [], [], []
    for text in texts:
        sentences, _ = bags([text])
        for s in sentences:
            for w in s:
                if w not in words:
                    words[w] = len(words)
                    marks_of.append([names.setdefault(m, len(names)) for m in marks(w)])
        own_words.append(np.array([words[w] for s in sentences for w in s], dtype=np.int32))
        own_sizes.append(np.array([len(s) for s in sentences], dtype=np.int32))
        counts.append(len(sentences))
    table = np.full((len(words), 4), len(names), dtype=np.int32)
    for i, own in enumerate(marks_of):
        table[i, : len(own)] = own
    seen = np.zeros((2, len(names) + 1))
    for label, own in zip(labels, own_words, strict=True):
        seen[int(label > 0), np.unique(table[np.unique(own)])] += 1
    a, b, toxic, clean = seen[1, :-1], seen[0, :-1], y.sum(), len(y) - y.sum()
    share = (a + b) / len(y)
    z = (a / toxic - b / clean) / np.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-12)
    chosen = np.flatnonzero((a >= 3) & (z >= 4))
    listed = list(names)
    chosen = np.array(sorted(chosen.tolist(), key=lambda i: (-z[i], listed[i]))[:max_words], dtype=np.int64)
    number = np.full(len(names) + 1, -1, dtype=np.int64)
    number[chosen] = np.arange(len(chosen))
    vocabulary = [listed[i] for i in chosen]
    owner, sizes = np.repeat(np.arange(len(texts)), counts), np.concatenate(own_sizes)
    held = number[table[np.concatenate(own_words)]]
    at, mark = np.divmod(np.unique((np.repeat(np.arange(len(sizes)), sizes)[:, None] * max(1, len(chosen)) + held)[held >= 0]), max(1, len(chosen)))
    n, m = len(vocabulary), len(sizes)
    w, bias = np.zeros(n), -np.log(m / max(1.0, y.sum()))
    first, second, b1, b2 = np.zeros(n + 1), np.zeros(n + 1), 0.9, 0.99
    for step in range(1, rounds + 1):
        z = bias + np.bincount(at, weights=w[mark], minlength=m)
        total = np.maximum(np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(y)), 1e-9)
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 500)), 1.0) / len(y)
        g = slope[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(mark, weights=g[at], minlength=n) + decay * w, g.sum())
        first, second = b1 * first + (1 - b1) * grad, b2 * second + (1 - b2) * grad * grad
        move = rate * first / (1 - b1**step) / (np.sqrt(second / (1 - b2**step)) + 1e-7)
        bias, w = bias - move[-1], w - move[:-1]
    return Model(float(bias), {vocabulary[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)})


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents that are not held out, in order of a hash of id and text.

    The sample has max_docs documents and max_bytes of text at most, so what is broadcast and what comes
    to the driver is bounded. Rows with equal id and text count once, an id labelled twice is toxic if
    any label says so, and documents that share an id take that id's label.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = slim.join(F.broadcast(known), F.col("id") == F.col("_id")).select("id", "text", F.xxhash64("text").alias("tag"), F.col("_toxic").alias("toxic"))
    sizes = rows.select("id", "tag", F.octet_length("text").alias("bytes")).distinct().orderBy(F.xxhash64("id", "tag"), "id", "tag").limit(max_docs).collect()
    total = np.cumsum([r["bytes"] for r in sizes])
    taken = [(r.id, r.tag) for r, n in zip(sizes, total, strict=True) if n <= max_bytes]
    if not taken:
        return Model()
    wanted = docs.sparkSession.createDataFrame(taken, rows.select("id", "tag").schema).toDF("_i", "_t")
    got = rows.join(F.broadcast(wanted), (F.col("id") == F.col("_i")) & (F.col("tag") == F.col("_t"))).select("id", "text", "toxic").dropDuplicates(["id", "text"])
    got = sorted(got.collect(), key=lambda r: (r.id, r.text))
    return fit([r.text for r in got], [r.toxic for r in got])


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted, offending (start, end, score of sentences)."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            scores = model.scores(texts)
            found = [[{"start": a, "end": b, "score": p} for a, b, p in model.located(t, threshold)] if s >= threshold else [] for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(found, spans)], ["doc_id", "held_out", "score", "predicted", "offending"])

    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without those that score at or above the threshold; all columns as they are."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
