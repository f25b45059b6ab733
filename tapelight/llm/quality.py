"""Document quality: counted rules and gradient-boosted trees over the same statistics.

Statistics are computed for all documents of an Arrow slice at once. The trees are trained on the driver from a
bounded sample of labelled documents (`most` rows, by a hash of the id, a documented parameter), with monotone
constraints: more repeated words, repeated lines or symbols never raise a document's score. The forest, a few
kilobytes, goes to the tasks. No shuffle when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import dictionary, slices, utf8, words
from .boosting import Forest, train

SYMBOLS = b"#*$%&|<>"  # fixed values
#: Statistics with the direction in which they may move the score (0: any).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "letter_share": 0, "capital_share": 0,
    "digit_share": 0, "mark_share": 0, "words_per_line": 0, "doubled_share": -1, "plain_word_share": 0, "bang_per_word": 0, "worst_symbols": -1, "worst_capitals": 0, "worst_doubled": -1, "worst_bars": -1,
}
SAMPLE = 20_000
WINDOW = 64
SLICE = 1 << 20  # a statistic takes some eight bytes for each byte of text


def tables() -> dict[str, np.ndarray]:
    """Which bytes are letters, capitals, digits, marks and symbols; bytes over 127 count as letters."""
    byte = np.arange(256)
    letter = (byte >= 65) & (byte <= 90) | (byte >= 97) & (byte <= 122) | (byte >= 128)
    digit = (byte >= 48) & (byte <= 57)
    return {
        "start": (byte & 0xC0) != 0x80, "letter": letter, "capital": (byte >= 65) & (byte <= 90), "digit": digit, "mark": (byte > 32) & (byte < 127) & ~letter & ~digit,
        "symbol": np.isin(byte, list(SYMBOLS)), "bang": byte == 33, "bar": byte == 124,
    }


TABLES = tables()


def repeated(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: does its key occur at least twice in its document; is there an equal one before it?"""
    order = np.lexsort((keys, doc))
    same = np.zeros(len(keys), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    after = same.copy()
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    out[order], later[order] = twice, after
    return out, later


def statistics(data: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the rules (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the rows of FEATURES."""
    n = len(at) - 1
    sums = {name: np.append(0, np.cumsum(table[data], dtype=np.int64)) for name, table in TABLES.items()}
    total = {name: s[at[1:]] - s[at[:-1]] for name, s in sums.items()}
    starts, ends, first = words(data, at)
    doc = np.repeat(np.arange(n), np.diff(first))
    n_words = np.diff(first)

    def by_doc(flags: np.ndarray, of: np.ndarray = doc) -> np.ndarray:
        return np.bincount(of, flags, n).astype(np.int64) if len(of) else np.zeros(n, np.int64)

    def of_words(name: str) -> np.ndarray:
        return sums[name][ends] - sums[name][starts]

    codes, _ = dictionary(data, starts, ends)
    codes = codes.astype(np.uint64)
    chars = of_words("start")
    # three-word windows inside one document; a word counts if any window that holds it is repeated
    repeat = np.zeros(len(codes), bool)
    if len(codes) > 2:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        span = np.uint64(int(codes.max()) + 1)
        if int(span) ** 3 < 1 << 64:
            keys = (codes[inside] * span + codes[inside + 1]) * span + codes[inside + 2]
        else:
            pairs = np.unique(codes[inside] * span + codes[inside + 1], return_inverse=True)[1].astype(np.uint64)
            keys = np.unique(pairs * span + codes[inside + 2], return_inverse=True)[1]
        twice = inside[repeated(doc[inside], keys)[0]]
        for k in range(3):
            repeat[twice + k] = True
    # lines
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1])) if len(data) else np.zeros(0, np.int64)
    line_starts = line_starts[line_starts < len(data)]
    line_doc = np.searchsorted(at, line_starts, "right") - 1
    line_ends = np.append(line_starts[1:], len(data))
    has_break = (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    content = line_ends - has_break
    line_codes, _ = dictionary(data, line_starts, content)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    dup = np.zeros(len(line_starts), bool)
    if has_word.any():
        dup[has_word] = repeated(line_doc[has_word], line_codes[has_word])[1]
    counts = {"n_words": n_words, "word_chars": by_doc(chars), "n_symbols": total["symbol"], "n_dup_lines": by_doc(dup, line_doc), "n_repeat_words": by_doc(repeat)}
    new = np.zeros(len(codes), bool)
    if len(codes):
        new = ~repeated(doc, codes)[1]
    doubled = np.zeros(len(codes), bool)
    doubled[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    letters = of_words("letter")
    symbol, bar, capital = of_words("symbol") > 0, of_words("bar") > 0, (of_words("capital") > 0) & (of_words("bang") > 0)
    plain = letters >= ends - starts - 1

    def worst(flags: np.ndarray) -> np.ndarray:
        """The largest share of flagged words in any run of WINDOW words (the whole document if it has fewer)."""
        run = np.append(0, np.cumsum(flags))
        out = np.zeros(n)
        if len(doc):
            to = np.minimum(np.arange(len(doc)) + WINDOW, first[1:][doc])
            begin = np.maximum(np.minimum(np.arange(len(doc)), to - np.minimum(WINDOW, n_words[doc])), 0)
            share = (run[to] - run[begin]) / np.maximum(to - begin, 1)
            some = n_words > 0
            out[some] = np.maximum.reduceat(share, first[:-1][some])
        return out

    many, size = np.maximum(n_words, 1), np.maximum(total["start"], 1)
    lines = np.maximum(by_doc(has_word, line_doc), 1)
    columns = [
        np.log1p(n_words), counts["word_chars"] / many, total["symbol"] / many, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / many, by_doc(new) / many, total["letter"] / np.maximum(np.diff(at), 1), total["capital"] / size,
        total["digit"] / size, total["mark"] / size, n_words / lines, by_doc(doubled) / many, by_doc(plain) / many, total["bang"] / many, worst(symbol), worst(capital), worst(doubled), worst(bar),
    ]
    return counts, np.stack(columns, 1).astype(float)


def _columns(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.selectExpr(f"`{id_column}` AS doc_id", f"coalesce(`{text_column}`, '') AS text")


def labelled_features(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most `most` labelled documents, those with the smallest hashes of their ids.

    Of several labels of one id the lowest counts, of several texts the least.
    """
    chosen = labels.where(F.col(label).isin(0, 1)).select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = _columns(documents, id_column, text_column).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            x = statistics(*utf8(batch.column("text")))[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = documents.schema[id_column].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, label int, x array<double>").toPandas().sort_values("doc_id")
    return np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["label"].to_numpy(int)


def train_quality(documents: DataFrame, labels: DataFrame, most: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Forest:
    """The forest; without labelled documents of both kinds, one that keeps everything."""
    x, y = labelled_features(documents, labels, most=most, id_column=id_column, text_column=text_column)
    if len(set(y.tolist())) < 2:
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 1.0)
    return train(x, y, np.array(list(FEATURES.values())))


def keep_quality(documents: DataFrame, forest: Forest, text_column: str = "text") -> DataFrame:
    """The documents that rules and trees keep, all columns as they were, whatever their names. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices([batch], text_column, SLICE):
                counts, x = statistics(*utf8(part.column(batch.schema.get_field_index(text_column))))
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                yield batch.slice(at, part.num_rows).filter(pa.array(~failed & (forest.score(x) >= 0)))
                at += part.num_rows

    return documents.mapInArrow(run, documents.schema)


def score_quality(documents: DataFrame, forest: Forest, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for every row.

    A document is kept if the trees' log odds, the score, aren't against it (even ones, as without labels, aren't).
    Null text counts as empty: no words, base_failed. Lines are split at \\n and compared whole; only lines with a word
    count. Repeated rows give repeated results; no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            counts, x = statistics(*utf8(batch.column("text")))
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            score = forest.score(x)
            arrays = [batch.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in counts.values()), pa.array(failed), pa.array(~failed & (score >= 0)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *counts, "base_failed", "kept", "score"])

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return _columns(documents, id_column, text_column).mapInArrow(run, schema)
