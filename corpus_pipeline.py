"""A corpus pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the
shared folder and reads again as the next stage's docs. All stages but the last return the columns
of documents.

* toxicity: documents that score at or above the threshold go.
* line dedup: lines within one edit of an earlier line go; a document that loses every line stays,
  with an empty text, and the next stage sees to it.
* n-gram Jaccard join: of each class of near copies the document with the least id stays.
* mixing: documents are repeated or left out so that sources come near their targets.
* BPE: a row for each document that the mix holds, with the number and digests of its ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relata.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from relata.llm.common import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: MinHash, a fitted model and hashes that DuckDB lacks can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
