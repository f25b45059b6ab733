"""Token ids in compressed files: writing in ascending order of ids, and reading back.

Files are Parquet, so that Spark writes, commits and reads them in any store; the ids in them are the coder's own
format. Documents are range-partitioned and sorted by id. A partition becomes rows of whole documents with about
ROW_IDS ids: part, row, doc_ids, n_tokens, blocks. Reading needs no order: the ids before a row follow from the
rows' totals, the ids before a document in its row from the row itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import slices, utf8
from .idcoder import decode, encode
from .tokenizer import library_ids

ROW_IDS = 4 << 20
#: Segments that a worker remembers the ids of.
REMEMBERED = 900_000


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", row_ids: int = ROW_IDS) -> None:
    """Write each document's ids (of its text, null being empty, then `end_id`) in ascending order of the id column.

    Rows with a null id come first; repeated ids are written as often as they come. No rows give no blocks. Other
    columns are ignored.
    """
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, row = library_ids(tokenizer, REMEMBERED), TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            keys, sizes = pa.concat_arrays(docs), np.concatenate(counts)
            whole = pa.array([0, len(keys)], pa.int32())
            arrays = [pa.array([part], pa.int32()), pa.array([row], pa.int32()), pa.ListArray.from_arrays(whole, keys), pa.ListArray.from_arrays(whole, pa.array(sizes, pa.int64())), pa.array([b"".join(encode(np.concatenate(ids)))], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "row", "doc_ids", "n_tokens", "blocks"])

        for batch in slices(batches):
            flat, at = memo(*utf8(batch.column("text")))
            sizes = np.diff(at) + 1
            with_end = np.insert(flat, at[1:], end_id)
            docs.append(batch.column("doc_id"))
            ids.append(with_end)
            counts.append(sizes)
            if sum(map(len, ids)) >= row_ids:
                yield rows()
                docs, ids, counts, row = [], [], [], row + 1
        if docs:
            yield rows()

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.selectExpr(f"`{id_column}` AS doc_id", f"coalesce(`{text_column}`, '') AS text")
    # Rows of one id, or of none, may be many: their texts' hashes deal them over files.
    ties = F.xxhash64("text")
    ordered = ordered.repartitionByRange(n, "doc_id", ties).sortWithinPartitions("doc_id", ties)
    ordered.mapInArrow(run, f"part int, row int, doc_ids array<{kind}>, n_tokens array<long>, blocks binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids on request, of every document."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                flat = decode(one["blocks"]).astype("<u4")
                ends = np.cumsum(one["n_tokens"])
                if len(flat) != ends[-1]:
                    raise ValueError("a row's blocks don't hold its documents' ids")
                bounds = list(zip((ends - one["n_tokens"]).tolist(), ends.tolist(), strict=True))
                n = len(bounds)
                arrays = [pa.array([one["part"]] * n, pa.int32()), pa.array([one["row"]] * n, pa.int32()), pa.array(one["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array([a for a, _ in bounds], pa.int64()), pa.array(one["n_tokens"], pa.int64()), pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in bounds], pa.int64())]
                names = ["part", "row", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    decoded = files.mapInArrow(run, f"part int, row int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    totals = files.select("part", "row", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("total"))
    parts = totals.groupBy("part").agg(F.sum("total").alias("of_part"))
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))  # one row a file
    rows = totals.select("part", "row", (F.sum("total").over(Window.partitionBy("part").orderBy("row")) - F.col("total")).alias("in_part")).join(before, "part")
    start = (F.col("before") + F.col("in_part") + F.col("inside")).alias("start")
    return decoded.join(rows, ["part", "row"]).select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if ids else []))
