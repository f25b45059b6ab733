"""A pipeline from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; `run` writes each stage's rows
as Parquet to the shared folder and reads them again for the next. All stages but the last return the columns of
`documents`. Rows may hold nulls anywhere; texts that are null count as empty (and are rejected by the quality
rules). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelight.llm import exact_dedup, near_dedup, packing, pii, quality
from tapelight.llm.queries import read, vocabulary
from tapelight.llm.scratch import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep. The trees learn from the labelled ones among them."""
    return quality.keep_quality(docs, quality.train_quality(docs, read(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id."""
    return exact_dedup.drop_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 of five-word shingles, the document with the smallest doc_id."""
    return near_dedup.drop_near(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is the new text's."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of at most 2048."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: The quality trees, the span model and the packing can't be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return table(STAGES[-1][1](spark, docs, sf_dir))
