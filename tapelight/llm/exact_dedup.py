"""Exact deduplication that takes very frequent texts out before the shuffle.

1. Every text is hashed (SHA-256 in the JVM) and (digest, id) is written once as a slim table.
2. Each partition keeps a Misra-Gries summary of at most `counters` digests. A digest's summed counter is at
   most its frequency and less than it by at most rows / counters, so digests whose counter is above
   rows / counters - fewer than `counters` of them - include all with a frequency over 2 * rows / counters.
   That bound makes them safe to broadcast.
3. The winners are verified: one pass counts them exactly and finds the row that stays; partial aggregation
   leaves at most `counters` rows a task to shuffle. Their rows get the answer by a broadcast join.
4. All other digests, each of a bounded share of the rows, are grouped by an ordinary shuffle of digests.

Texts never take part in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

COUNTERS = 1024


def misra_gries(counters: int):
    """A mapInArrow function: the (digest, estimate) summary of one partition's digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts():
                digest, n = pair["values"].as_py(), pair["counts"].as_py()
                if digest in kept or len(kept) < counters:
                    kept[digest] = kept.get(digest, 0) + n
                else:  # n rows meet a full summary: each cancels one of every counter
                    least = min(n, min(kept.values()))
                    kept = {k: v - least for k, v in kept.items() if v > least}
                    if n > least:
                        kept[digest] = n - least
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "estimate"])

    return run


def heavy_hitters(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Fewer than `counters` digests, with all those in more than 2 / counters of the rows. digests: a column digest (binary)."""
    summary = digests.select("digest").mapInArrow(misra_gries(counters), "digest binary, estimate long")
    rows = digests.agg(F.count(F.lit(1)).alias("n_rows"))  # one row
    return summary.groupBy("digest").agg(F.sum("estimate").alias("estimate")).crossJoin(F.broadcast(rows)).where(F.col("estimate") > F.col("n_rows") / counters).select("digest")


def exact_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, byte for byte; null counts as empty. Of equal texts the row with the
    largest (or smallest) id stays. Rows with a null id stay only if the whole group has none. Repeated rows of
    one id share one decision. An empty table gives no rows. Other columns are ignored.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    slim = table(documents.select(F.col(id_column).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256)).alias("digest")))
    heavy = table(heavy_hitters(slim, counters))
    known = F.broadcast(heavy)  # fewer than `counters` rows of 32 bytes
    winners = slim.join(known, "digest").groupBy("digest").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    frequent = slim.join(F.broadcast(table(winners)), "digest")
    by = Window.partitionBy("digest")
    rest = slim.join(known, "digest", "left_anti").select("*", best("doc_id").over(by).alias("keep_id"), F.count(F.lit(1)).over(by).alias("group_size"))
    return frequent.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, one of each distinct text, with their columns as they were.

    It is the row that `exact_groups` keeps, by id and text: a row with a null id if the whole group has none, and one of
    the rows that repeat an id with the same text. An id's rows with other texts are decided by those texts.
    """
    names = documents.columns
    kept = exact_groups(documents, id_column, text_column, keep, counters).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha256")).agg(F.count(F.lit(1)).alias("_rows"))
    kept = table(kept)
    own = documents.withColumn("_digest", F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256))
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha256"))
    single = own.join(kept.where("_rows = 1"), same, "left_semi")
    repeated = own.join(kept.where("_rows > 1"), same, "left_semi").dropDuplicates([id_column, "_digest"])
    return single.unionByName(repeated).select(*names)
