"""The pipeline's stages on a small corpus, and what the queries return."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from relata.llm import bpe, common, mixing, toxicity
from tests.llm.test_operators import classes_by_hand, lines_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = common.settle(stage(spark, docs, SF))
        assert tuple(new.columns) == corpus_pipeline.COLUMNS, name
        assert [f.dataType for f in new.schema] == [f.dataType for f in docs.schema]
        if name == "line_dedup":
            assert new.count() == docs.count()
            assert new.agg({"n_chars": "sum"}).first()[0] < docs.agg({"n_chars": "sum"}).first()[0]
        if name == "ngram_jaccard_join":
            texts = [r.text for r in new.select("text").collect()]
            assert len({" ".join((t or "").lower().split()) for t in texts}) == len(texts)
        docs = new
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[3] < counts[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == counts[-1]


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_one_query(n):
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


def test_pipeline_is_registered():
    assert "pipeline" in entry.queries() and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_equals_the_stages_by_brute_force(spark):
    """Model, lines, near copies and ids one document at a time; the draw itself is tested beside its operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r, score in zip(rows, model.scores([r[1] or "" for r in rows]), strict=True) if score < toxicity.THRESHOLD]
    kept = lines_by_hand(rows, 1)
    rows = [(r[0], kept[r[0]][0], *r[2:]) for r in rows]
    classes = classes_by_hand(rows)
    rows = [r for r in rows if r[0] is None or classes[r[0]][0] == r[0]]
    times = {r.doc_id: r.copies for r in mixing.copies(spark.createDataFrame(rows, docs.schema)).collect()}
    ranks = bpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text, *_ in rows:
        ids = other.encode_ordinary(text or "")
        want += [(doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * times[doc_id]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in entry.queries()["pipeline"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50
