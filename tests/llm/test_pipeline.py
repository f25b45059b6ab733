"""The pipeline and all registered queries of the subpackage, over small tables."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tapelight.llm import pii, quality, queries

from .helpers import awkward, none
from .test_dedup import brute


def write(spark, folder, documents, labels):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def brute_pipeline(spark, folder, forest):
    """All stages but the packing's choice of places, with plain loops: the ids of every piece."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality.score_quality(spark.read.parquet(f"{folder}/documents.parquet"), forest).where("kept").collect()}
    by_text = {}
    for i in kept:
        by_text[rows[i]] = max(i, by_text.get(rows[i], -1))
    left = sorted(by_text.values())
    label = brute([(i, rows[i]) for i in left], 5, 80)
    left = [i for i in left if label[i][1] == i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for i in left:
        base = pii.base_spans(rows[i])
        text = pii.redact(rows[i], base + pii.added_spans(pii.train(), rows[i], base))
        out[i] = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    return out


def test_pipeline_against_loops(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    folder = write(spark, tmp_path / "in", source, labels)
    rows = corpus_pipeline.run(spark, folder).collect()
    forest = quality.train_quality(source, spark.read.parquet(f"{folder}/labels.parquet"))
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == brute_pipeline(spark, folder, forest)


def test_stages_return_documents(spark, tmp_path):
    folder = write(spark, tmp_path / "in", awkward(spark), [(3, 1), (4, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = corpus_pipeline.table(docs)
    assert docs.count() >= 1


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "in", none(spark), [])).count() == 0


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op8_byte_bpe", "op9_quality_rules", "op2_pii"])
def test_queries_run(spark, name):
    rows = queries.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    if name == "op5_exact_dedup":
        texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
        assert all(r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows)
