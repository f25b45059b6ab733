"""Collocations: phrases of two to five words that occur together more often than their parts would by chance.

Phrases are mined level by level from vertical lists. Within a block of documents (a slice of an Arrow batch) every word
has its posting list, the ascending places where it stands; places skip one between pieces, so neighbours in a piece are
one apart. The list of a phrase of k words is joined with the postings, laid out by place, of the words one place on, and
what meets falls apart into the lists of the phrases of k + 1 words. A list's length is the phrase's frequency in the block, and
the sums over all blocks are exact. Phrases never cross documents, so lists never leave their block: only (phrase,
length) is shuffled, summed before and after.

Only phrases whose first and last k words are frequent themselves are extended. Which are, tasks learn from a bitmap of
hashes, of a bounded size whatever the corpus: it lets all frequent phrases through, and what else passes by a
collision falls to the exact threshold after the sum. Lists are made anew from the texts at every level instead of being
stored: four scans, no positions on disk, and a lost task starts again from its texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import dictionary, slices, utf8
from .scratch import table

BLOCK_BYTES = 8 << 20
#: Bits of the bitmap of frequent phrases: 16 for each, up to 2^27 (16 MB), beyond which more gets through to the sums.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 27, 16
#: An odd multiplier (fixed): a phrase's hash is a polynomial in it over the hashes of its words.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: The sizes that a scan counts, and the longest phrase. Those of four words and five are few and share one.
PASSES, LONGEST = ((1,), (2,), (3,), (4, 5)), 5
#: The final pick of each language sorts at most `most` rows of each of these parts.
PARTS = 64

# What ends a piece, and what lies between the words of a piece.
BREAK, GAP = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP[[9, 32]] = True
CAPITALS = np.arange(256, dtype=np.uint8)
CAPITALS[65:91] += 32

Bitmap = tuple[np.ndarray, int]


def postings(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and places of all words, and the text each stands in."""
    cut, edge = BREAK[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    inside = ~(cut | GAP[data])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    breaks = np.flatnonzero(cut | edge[:-1])
    places = np.arange(len(starts)) + np.searchsorted(breaks, starts, "right")
    return starts, ends, places, np.searchsorted(at, starts, "right") - 1


def term_hashes(words: list[bytes], langs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, zlib.crc32(lang.encode())) for w, lang in zip(words, langs, strict=True)), np.uint64, len(words))


def frequent_in(bitmap: Bitmap, hashes: np.ndarray) -> np.ndarray:
    cells, bits = bitmap
    place = hashes >> np.uint64(64 - bits)
    return (cells[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class Terms:
    """The distinct (language, word) of a block: their hashes, and at every place the term that stands there (-1: none)."""

    def __init__(self, term: np.ndarray, places: np.ndarray, hashes: np.ndarray):
        self.hashes = hashes
        self.at = np.full(int(places[-1]) + 2 + LONGEST, -1, np.int32)
        self.at[places] = term

    def keep(self, kept: np.ndarray) -> None:
        """Takes all other terms off their places."""
        self.at[~np.append(kept, False)[self.at]] = -1


class Lists:
    """Occurrence lists: phrase i, of the terms words[i], has lengths[i] places; `start` has all lists, each ascending, one after the other."""

    def __init__(self, phrase: np.ndarray, start: np.ndarray, words: np.ndarray):
        pairs = phrase.astype(np.int64) << 32 | start
        pairs.sort()
        self.phrase, self.start, self.words = pairs >> 32, pairs & 0xFFFFFFFF, words
        self.lengths = np.bincount(phrase, minlength=len(words))

    def hashes(self, terms: Terms, last: int) -> np.ndarray:
        """Of the last words of each phrase."""
        return reduce(lambda h, k: h * STEP + terms.hashes[self.words[:, k]], range(self.words.shape[1] - last, self.words.shape[1]), np.zeros(len(self.words), np.uint64))

    def only(self, keep: np.ndarray) -> Lists:
        """The lists of some phrases, numbered anew."""
        there = keep[self.phrase]
        return Lists((np.cumsum(keep) - 1)[self.phrase[there]], self.start[there], self.words[keep])

    def extended(self, terms: Terms) -> Lists:
        """The lists of all phrases one word longer: each place meets the posting one place behind the phrase's end."""
        word = terms.at[self.start + self.words.shape[1]]
        met = np.flatnonzero(word >= 0)
        phrase, keys = pd.factorize(self.phrase[met] * len(terms.hashes) + word[met])
        before, last = np.divmod(keys, len(terms.hashes))
        return Lists(phrase, self.start[met], np.concatenate([self.words[before], last[:, None]], 1))


def mined(batches: Iterator[pa.RecordBatch], sizes: Sequence[int], bitmaps: list[Bitmap]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n of each block's phrases of the sizes; at size 1 also the number of words (phrase null)."""
    for part in slices(batches, most=BLOCK_BYTES):
        data, at = utf8(part.column("text"))
        data = CAPITALS[data]
        starts, ends, places, text = postings(data, at)
        if not len(starts):
            continue
        codes, distinct = dictionary(data, starts, ends)
        langs = part.column("lang").dictionary_encode()
        names = langs.dictionary.to_pylist()
        phrase, term = pd.factorize(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] * len(distinct) + codes)
        lang, word = np.divmod(term, len(distinct))
        spelled = distinct.take(pa.array(word))

        def shown(words: np.ndarray, lengths: np.ndarray, spelled=spelled, langs=langs, lang=lang) -> pa.RecordBatch:
            parts = [spelled.take(pa.array(words[:, j])) for j in range(words.shape[1])]
            joined = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, b" ")
            return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[words[:, 0]])), joined.cast(pa.string()), pa.array(lengths, pa.int64())], ["lang", "phrase", "n"])

        single = np.arange(len(term))[:, None]
        if 1 in sizes:
            lengths = np.bincount(phrase, minlength=len(term))
            yield shown(single, lengths)
            each = np.bincount(lang, lengths, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([langs.dictionary, pa.nulls(len(names), pa.string()), pa.array(each)], ["lang", "phrase", "n"])
        if not bitmaps:
            continue
        terms = Terms(phrase, places, term_hashes(spelled.to_pylist(), [names[i] for i in lang]))
        kept = frequent_in(bitmaps[0], terms.hashes)
        terms.keep(kept)
        there = kept[phrase]
        found = Lists(phrase[there], places[there], single)
        for size in range(2, max(sizes) + 1):
            found = found.extended(terms)
            # All but the last words of a phrase have been looked up before; where its own size has no bitmap yet, the longest end that has one.
            if known := min(size, len(bitmaps)) if size > 2 or len(bitmaps) > 1 else 0:
                found = found.only(frequent_in(bitmaps[known - 1], found.hashes(terms, known)))
            if size in sizes and len(found.words):
                yield shown(found.words, found.lengths)


def bitmap_of(phrases: DataFrame) -> Bitmap:
    """The bitmap of the hashes of all phrases (lang, phrase): cells are or-ed by Spark, at most 2^(MOST_BITS - 6) reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (phrases.count() * BITS_EACH).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            split = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            hashes = np.zeros(len(split), np.uint64)
            for k in range(max(map(len, split), default=0)):
                hashes = hashes * STEP + term_hashes([p[k] for p in split], langs)
            place = hashes >> np.uint64(64 - bits)
            cell = np.left_shift(np.uint64(1), place & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(cell)], ["cell", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(1 << (bits - 6), np.int64)
    cells[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return cells.view(np.uint64), bits


def frequent_phrases(documents: DataFrame, least: int, longest: int, text_column: str, lang_column: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to `longest` words with f >= least, and (lang, n), the number of words."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    levels: list[DataFrame] = []
    shared = []
    for sizes in PASSES:
        if not (now := [x for x in sizes if x <= longest]):
            break

        def run(batches: Iterator[pa.RecordBatch], now: Sequence[int] = now, before: tuple = tuple(shared)) -> Iterator[pa.RecordBatch]:
            return mined(batches, now, [b.value for b in before])

        sums = texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found = table(sums.where(F.col("phrase").isNull() | (F.col("f") >= least)).withColumn("size", F.size(F.split("phrase", " "))))
        if not shared:
            words = found.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
            found = found.where("phrase IS NOT NULL")
        levels.append(found)
        if found.isEmpty() or max(now) >= longest:
            break
        shared.append(spark.sparkContext.broadcast(bitmap_of(found)))
    return reduce(DataFrame.unionByName, levels), words


def collocations(documents: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases by score, then a, then phrase.

    a is the phrase's frequency, n the language's number of words, l and r the frequencies of the two parts at the cut
    that gives the least score floor(1000 * a * n / (l * r)), the first such cut. Phrases that stand inside a longer one of
    the same frequency are dropped. Ties in all of score and a go by the phrase's bytes, so ranks are always the same.
    Null language is `und`, null text empty. Repeated rows count as often as they stand there. No documents, or no phrase
    that is frequent, give no rows. Other columns, whatever their names, are ignored.
    """
    frequent, words = frequent_phrases(documents, least, longest, text_column, lang_column)
    found = frequent.where("size >= 2")
    parts = F.split("phrase", " ")

    def some(first: int | F.Column, size: F.Column) -> F.Column:
        return F.array_join(F.slice(parts, first, size), " ")

    # A longer phrase of the same frequency implies one that is longer by one word only.
    inside = [found.where("size >= 3").select("lang", some(F.lit(i), F.col("size") - 1).alias("phrase"), F.col("f").alias("longer")) for i in (1, 2)]
    marked = found.select("lang", "phrase", "size", "f", F.lit(None).cast("long").alias("longer"))
    for one in inside:
        marked = marked.unionByName(one.select("lang", "phrase", F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("f"), "longer"))
    left = marked.groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.max("f").alias("a"), F.max("longer").alias("longer")).where("longer IS NULL OR longer < a")

    k = F.col("k")
    cuts = left.select("lang", "phrase", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", some(F.lit(1), k).alias("head"), some(k + 1, F.col("size") - k).alias("tail"))
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(words, "lang")
    wide = "decimal(19, 0)"
    score = F.expr(f"(CAST(a AS {wide}) * CAST(n AS {wide}) * CAST(1000 AS decimal(4, 0))) div (CAST(l AS {wide}) * CAST(r AS {wide}))")
    cuts = cuts.withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
