"""Packing token pieces into sequences: best fit, then swap-based local search.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by a hash of the row's number into blocks of about
`block` pieces - no text, source or repeated id can crowd one - and each block is packed by best fit in falling length.
The local search then looks at bins with room: pieces move into other bins, one piece is exchanged for one, and two for
one, whenever that raises the sum of squared fills, so that the emptiest bins run empty. The pieces of bins that still have
room are dealt anew and packed once more together. ROUNDS of search and LEVELS of dealing anew are parameters; None goes
on until nothing helps, and until a level saves no sequence. Only row numbers
and lengths take part; the pieces get their places by a join.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices, utf8
from .scratch import table
from .tokenizer import library_ids

CAPACITY = 2048
BLOCK = 8192
#: Text bytes that are encoded at a time: a worker holds several times their ids beside the tokenizer and its memo.
SLICE = 1 << 20
#: More rounds and levels save few sequences for much time: see the README.
ROUNDS, LEVELS = 4, 1


def cut_pieces(documents: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece.

    A document's ids are those of its text (null: empty), then `end_id`. Longer ones are cut so that only the first
    piece is shorter than `capacity`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = library_ids(path)
        for batch in slices(batches, most=SLICE):
            flat, at = memo(*utf8(batch.column("text")))
            flat = flat.astype("<u4")
            rows: list[tuple] = []
            for doc, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = np.append(flat[a:b], np.uint32(end_id))
                edges = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                rows += [(doc, k, x, own[x:y]) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            docs, numbers, starts, parts = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return documents.selectExpr(f"`{id_column}` AS doc_id", f"coalesce(`{text_column}`, '') AS text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers; each piece, longest first, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0  # bit r: a bin with room r
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[k]
        fit = has >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                has &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        by_room[room - size].append(b)
        has |= 1 << (room - size)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, rounds: int | None = ROUNDS) -> list[list[int]]:
    """Empty bins by moves, one-for-one and two-for-one exchanges, each of which raises the sum of squared fills.

    The emptiest bin gives to the fuller ones that have room, until it is empty or nothing helps; then the next
    emptiest; so many rounds at most, without end until nothing helps where that is None. No piece is lost: an exchange
    only changes places.
    """
    fill = [sum(lengths[k] for k in b) for b in bins]
    changed, done = True, 0
    while changed and done != rounds:
        changed, done = False, done + 1
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: fill[b])
        for n, a in enumerate(under):
            others = under[n + 1 :]
            for b in reversed(others):  # the fullest first
                room = capacity - fill[b]
                if not bins[a]:
                    break
                if not bins[b] or room == 0 or fill[b] < fill[a]:
                    continue
                give = take = None
                gain = 0
                mine = sorted(bins[a], key=lengths.__getitem__)
                sizes = [lengths[k] for k in mine]
                if k := bisect_right(sizes, room):  # move the longest that fits
                    give, take, gain = [mine[k - 1]], [], sizes[k - 1]
                if gain < room:
                    for y in bins[b]:
                        k = bisect_right(sizes, lengths[y] + room)  # one for one
                        if k and sizes[k - 1] - lengths[y] > gain:
                            give, take, gain = [mine[k - 1]], [y], sizes[k - 1] - lengths[y]
                        if len(mine) > 1:  # two for one: the best partner of each
                            for i, x in enumerate(sizes):
                                j = bisect_right(sizes, lengths[y] + room - x) - 1
                                j -= j == i
                                if j >= 0 and x + sizes[j] - lengths[y] > gain:
                                    give, take, gain = [mine[i], mine[j]], [y], x + sizes[j] - lengths[y]
                        if gain == room:
                            break
                if give is None or 2 * gain * (fill[b] - fill[a] + gain) <= 0:
                    continue
                bins[a] = [k for k in bins[a] if k not in give] + take
                bins[b] = [k for k in bins[b] if k not in take] + give
                fill[a] -= gain
                fill[b] += gain
                changed = True
    return [b for b in bins if b]


def pack_block(capacity: int, level: int, rounds: int | None = ROUNDS):
    """An applyInPandas function: (_row, _sequence, _offset, _full) of the pieces (_row, _length, _block) of one block."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["_length", "_row"], kind="stable").reset_index(drop=True)
        lengths = block["_length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity, rounds)
        where, offset, full = np.empty(len(block), np.int64), np.empty(len(block), np.int64), np.empty(len(block), bool)
        for number, b in enumerate(bins):
            at = 0
            for k in b:
                where[k], offset[k] = number, at
                at += lengths[k]
            full[b] = at == capacity
        base = (level << 56) | (int(block["_block"].iloc[0]) << 20)
        return pd.DataFrame({"_row": block["_row"], "_length": block["_length"], "_sequence": base + where, "_offset": offset, "_full": full})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, rounds: int | None = ROUNDS, levels: int | None = LEVELS) -> DataFrame:
    """The pieces (length and any other columns, which stay as they are) with sequence_id and offset, gapless from 0.

    Every piece gets a place; lengths are 1 to `capacity`. Repeated rows, and rows with repeated or null ids, are packed
    each for itself; no pieces, no rows. Columns named sequence_id or offset are replaced.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = "_row"
    while row in names:
        row += "_"
    pieces = table(pieces.select(*names, F.monotonically_increasing_id().alias(row)))

    def packed(frame: DataFrame, n: int, level: int) -> DataFrame:
        blocks = max(1, -(-n // block))
        dealt = frame.select("_row", "_length", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(blocks)).alias("_block"))
        return table(dealt.groupBy("_block").applyInPandas(pack_block(capacity, level, rounds), "_row long, _length long, _sequence long, _offset long, _full boolean"))

    def used(frame: DataFrame) -> int:
        return frame.where("_offset = 0").count()

    rest = pieces.select(F.col(row).alias("_row"), F.col("length").cast("long").alias("_length"))
    last, level = packed(rest, pieces.count(), 0), 0
    done = [last.where("_full")]
    left = last.where("NOT _full")
    while level != levels and (before := used(left)) > 1:
        level += 1
        again = packed(left, left.count(), level)
        if used(again) >= before:
            break
        done.append(again.where("_full"))
        left = again.where("NOT _full")
    places = reduce(DataFrame.unionByName, [*done, left]).select(F.col("_row").alias(row), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))
    return pieces.join(places, row).select(*names, "sequence_id", "offset")


def pack_documents(documents: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """Cut and pack: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(cut_pieces(documents, path, end_id, capacity, id_column, text_column, ids), capacity, block)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the token ids of every sequence, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
