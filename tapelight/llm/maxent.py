"""A hashed maximum-entropy language model, trained by distributed gradient updates, that scores whole texts.

A text's tokens are its words and one end. The most frequent TOP outcomes stand in classes of WIDE, by frequency; all
other words are in RARE classes by their ending. The probability of a token is that of its class given what precedes,
times its own within the class: for a frequent word given what precedes again, for the others in proportion to their
count and one more, with one share left in each class for words never seen. So all outcomes add up to 1.

Both softmaxes are log-linear in the token's features: the word before, the two before, and the words two and three places
back (skips). A feature is a row of ROWS hashed rows of weights, one weight an outcome, so memory is fixed whatever the
corpus. Biases are the logarithms of counts; weights start at 0, where the model is the unigram one.

Training goes once over all training texts, in ROUNDS of disjoint shares. In each, every task takes gradient steps
(AdaGrad, batches of tokens) on its texts from the round's common weights; what its weights have moved by, in proportion
to its tokens and as whole numbers, is summed by row in Spark, with partial sums before the shuffle, and added to the
common weights. The sums don't depend on their order. Counts of words cover all training texts and are a table; the at most
KNOWN most frequent words go to all tasks, the others meet their counts in a join, summed by text and word before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import dictionary, slices, utf8, words
from .collocations import CAPITALS
from .scratch import table

TOP, WIDE, RARE = 1024, 32, 32
CLASSES = TOP // WIDE + RARE
#: Hashed rows of the weights of classes and of words, as a power of two; 16 at most.
ROW_BITS = 13
ROWS = 1 << ROW_BITS
#: The most words whose counts are sent to all tasks.
KNOWN = 1 << 18
#: Of the remainders of an id's hash divided by their number, how many belong to each round.
ROUNDS = (1, 2, 5)
BATCH, RATE, FEW = 2048, 1.0, 8
#: A weight moved by 1 over 65,536 tokens is sent as this number.
FIXED, SHARE = 1 << 14, 1 << 16
NEVER = np.float32(-1e9)
#: Odd multipliers (fixed) that spread the hashes of features over rows.
SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]
NOTHING = np.uint64(0x51ED270B7A2C1F3D)


def remainder(id_column: str, by: int) -> Column:
    """crc32 of the id as text modulo a number; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).cast("binary")) % by


def spellings(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long


def hashed(spelled: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, spelled), np.uint64, len(spelled))


def rare_classes(words: pa.Array) -> np.ndarray:
    """Of words (binary): by the last two bytes, punctuation aside, and whether there is some."""
    bare = pc.utf8_rtrim(words.cast(pa.string()), characters=".,;:!?\"')").cast(pa.binary())
    sizes = pc.binary_length(bare).to_numpy(zero_copy_only=False)
    endings = pc.binary_slice(bare, -2, 1 << 30).dictionary_encode()
    of = np.array([zlib.crc32(e) % (RARE // 2) * 2 for e in endings.dictionary.to_pylist()] + [0])
    return of[endings.indices.to_numpy(zero_copy_only=False)] + (sizes < pc.binary_length(words).to_numpy(zero_copy_only=False))


@dataclass
class Vocabulary:
    """Counts of the known words (the most frequent first), of the end, and what scoring needs to know of the others."""

    words: pa.Array
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    #: The logarithm of all (count + 1) of a rare class and of its share for the unseen, and the counts alone.
    log_rare: np.ndarray
    of_rare: np.ndarray

    def __post_init__(self) -> None:
        hashes = hashed(spellings(self.words))
        #: The hashes of the known words in rising order, and whose they are.
        self.by_hash = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.by_hash]
        self.alone = bool((self.hashes[1:] != self.hashes[:-1]).all())
        top = min(TOP - 1, len(self.words))
        self.top = top
        #: The number of the outcome of each known word; -1 for those in rare classes. The end is the last outcome.
        self.outcome = np.where(np.arange(len(self.words)) < top, np.arange(len(self.words)), -1)
        of = np.zeros(TOP)
        of[:top] = self.counts[:top]
        there = np.arange(TOP) < top
        of[-1], there[-1] = self.ends, True
        of += 0.5 * there
        with np.errstate(divide="ignore"):
            grouped = of.reshape(-1, WIDE)
            classes = np.concatenate([grouped.sum(1), self.of_rare + 0.5])
            self.class_bias = np.maximum(np.log(classes / classes.sum()), NEVER).astype(np.float32)
            self.word_bias = np.maximum(np.log(grouped / np.maximum(grouped.sum(1, keepdims=True), 1e-300)), NEVER).astype(np.float32)

    def places(self, distinct: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The number of each word (with its hash) among the known ones, -1 for the others. Hashes find it, spellings decide."""
        if not len(self.words) or not self.alone:  # two known words of one hash
            return pc.index_in(distinct.cast(self.words.type), value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        own = np.flatnonzero(self.hashes[at] == hashes)
        place = self.by_hash[at[own]].astype(np.int64)
        same = pc.equal(distinct.take(pa.array(own)).cast(self.words.type), self.words.take(pa.array(place))).to_numpy(zero_copy_only=False)
        known = np.full(len(hashes), -1)
        known[own[same]] = place[same]
        return known


@dataclass
class Tokens:
    """The tokens of a slice: words of all texts, each text followed by its end."""

    text: np.ndarray
    known: np.ndarray
    outcome: np.ndarray
    classes: np.ndarray
    features: np.ndarray
    code: np.ndarray
    distinct: pa.Array


def tokens(texts: pa.Array, vocabulary: Vocabulary) -> Tokens:
    data, at = utf8(texts)
    data = CAPITALS[data]
    starts, ends, first = words(data, at)
    codes, distinct = dictionary(data, starts, ends)
    # The end is one more distinct token; its hash is never used, since nothing follows it.
    hashes = hashed(spellings(distinct))
    known = vocabulary.places(distinct, hashes)
    outcome = np.append(np.where(known >= 0, vocabulary.outcome[known] if len(vocabulary.outcome) else -1, -1), TOP - 1)
    classes = np.where(outcome >= 0, outcome // WIDE, TOP // WIDE + np.append(rare_classes(distinct), 0))

    counts = np.diff(first) + 1
    text = np.repeat(np.arange(len(counts)), counts)
    code = np.full(len(text), len(distinct))
    last = np.cumsum(counts) - 1
    inside = np.ones(len(text), bool)
    inside[last] = False
    code[inside] = codes
    place = np.arange(len(text)) - np.repeat(last + 1 - counts, counts)
    own = np.append(hashes, NOTHING)[code]
    before = []
    for k in (1, 2, 3):
        back = np.full(len(text), NOTHING)
        back[k:] = own[:-k] if len(own) > k else own[:0]
        back[place < k] = NOTHING + np.uint64(k)
        before.append(back)
    one, two, three = before
    features = np.stack([one * SPREAD[0], (one * SPREAD[1] + two) * SPREAD[2], two * SPREAD[3], three * SPREAD[4]], 1)
    features ^= features >> np.uint64(29)
    return Tokens(text, np.append(known, -2)[code], outcome[code], classes[code], features * SPREAD[5], code, distinct)


class Model:
    """Weights of classes (ROWS x CLASSES) and of words within a class (ROWS x WIDE) over the biases of counts."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.vocabulary = vocabulary
        self.of_class, self.of_word = weights[: ROWS * CLASSES].reshape(ROWS, CLASSES), weights[ROWS * CLASSES :].reshape(ROWS, WIDE)
        self.weights = weights
        self.logged = np.log(vocabulary.counts + 1.0)

    SIZE = ROWS * (CLASSES + WIDE)

    @staticmethod
    def rows(features: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        if classes is not None:
            features = (features + classes[:, None].astype(np.uint64) * SPREAD[1]) * SPREAD[3]
        return (features >> np.uint64(64 - ROW_BITS)).astype(np.int64)

    @staticmethod
    def sums(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """What the softmax is over, less the largest, for each token and outcome."""
        out = np.take(weights, rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            out += np.take(weights, rows[:, k], axis=0)
        out += bias
        out -= out.max(1, keepdims=True)
        return out

    @classmethod
    def logs(cls, weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """The logarithm of the probability of each token's outcome."""
        sums = cls.sums(weights, rows, bias)
        own = sums[np.arange(len(sums)), outcome].astype(float)
        return own - np.log(np.exp(sums, out=sums) @ np.ones(sums.shape[1], np.float32))

    @classmethod
    def errors(cls, weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """The probabilities of all outcomes, less 1 for the one that came: the gradient of each token's rows."""
        sums = cls.sums(weights, rows, bias)
        np.exp(sums, out=sums)
        sums /= (sums @ np.ones(sums.shape[1], np.float32))[:, None]
        sums[np.arange(len(sums)), outcome] -= 1
        return sums

    def score(self, found: Tokens) -> np.ndarray:
        """log10 of each token's probability, without the share of a rare word in its class that only a join knows."""
        v = self.vocabulary
        out = np.zeros(len(found.text))
        share = np.append(self.logged, [0.0, 0.0])  # of tokens -2 (the end) and -1 (unknown so far)
        for a in range(0, len(out), BATCH):
            part = slice(a, a + BATCH)
            classes, outcome = found.classes[part], found.outcome[part]
            own = self.logs(self.of_class, self.rows(found.features[part]), v.class_bias, classes)
            top = np.flatnonzero(outcome >= 0)
            own[top] += self.logs(self.of_word, self.rows(found.features[part][top], classes[top]), v.word_bias[classes[top]], outcome[top] % WIDE)
            rare = np.flatnonzero(outcome < 0)
            own[rare] += share[found.known[part][rare]] - v.log_rare[classes[rare] - TOP // WIDE]
            out[part] = own
        return out / np.log(10)

    def learn(self, found: Tokens, squares: list[np.ndarray], rate: float) -> None:
        """Gradient steps over all tokens, a batch at a time; squares are the sums of squares of each row's gradients."""
        v = self.vocabulary
        for a in range(0, len(found.text), BATCH):
            part = slice(a, a + BATCH)
            classes, outcome, features = found.classes[part], found.outcome[part], found.features[part]
            rows = self.rows(features)
            self.step(self.of_class, squares[0], rows, self.errors(self.of_class, rows, v.class_bias, classes), rate)
            top = np.flatnonzero(outcome >= 0)
            if len(top):
                rows = self.rows(features[top], classes[top])
                self.step(self.of_word, squares[1], rows, self.errors(self.of_word, rows, v.word_bias[classes[top]], outcome[top] % WIDE), rate)

    @staticmethod
    def step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, error: np.ndarray, rate: float) -> None:
        """Adds up the errors of each row's tokens and moves the row by them.

        Rows stand by how many tokens they have, and every turn takes one more token of each that has so many: few turns
        of long additions, and the few rows with more tokens than FEW others do one by one.
        """
        order = np.argsort(rows.astype(np.uint16), axis=None, kind="stable")  # numbers of 16 bits are sorted by radix
        flat, token = rows.ravel()[order], order // rows.shape[1]
        starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        counts = np.diff(np.append(starts, len(flat)))
        by = np.argsort(-counts.astype(np.int16), kind="stable")
        starts, counts = starts[by], counts[by]
        gradient, left, turn, falling = np.take(error, token[starts], axis=0), len(starts), 1, -counts
        while (left := int(np.searchsorted(falling[:left], -turn))) >= FEW:
            gradient[:left] += np.take(error, token[starts[:left] + turn], axis=0)
            turn += 1
        for i in range(left):
            gradient[i] += np.take(error, token[starts[i] + turn : starts[i] + counts[i]], axis=0).sum(0)
        at = flat[starts]
        squares[at] += np.einsum("ij,ij->i", gradient, gradient)
        gradient *= (rate / np.sqrt(squares[at]))[:, None]
        np.subtract(np.take(weights, at, axis=0), gradient, out=gradient)
        whole = np.dtype((np.void, gradient.itemsize * gradient.shape[1]))  # rows are copied faster as one item each
        weights.view(whole).ravel()[at] = gradient.view(whole).ravel()


def count_words(texts: DataFrame) -> DataFrame:
    """word, c of all texts; the row of the null word counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, at = utf8(part.column("text"))
            data = CAPITALS[data]
            starts, ends, _ = words(data, at)
            codes, distinct = dictionary(data, starts, ends)
            spelled = pa.concat_arrays([distinct.cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([spelled, pa.array(np.append(np.bincount(codes, minlength=len(distinct)), part.num_rows).astype(np.int64))], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def vocabulary_of(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the counts of the words that it doesn't hold. At most KNOWN words and a row a bin or class reach the driver."""
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 8).cast("int"))
    by_bin = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("distinct"), F.sum("c").alias("tokens"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).orderBy(F.desc("bin")).collect()
    least, held = 1 << 30, 0
    for row in by_bin:
        if (held := held + row.distinct) > KNOWN + 1:  # the end is not a word
            break
        least = row.bin
    known = binned.where((F.col("bin") >= least) & F.col("word").isNotNull()).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    others = binned.where((F.col("bin") < least) & F.col("word").isNotNull()).select("word", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = rare_classes(batch.column("word").cast(pa.binary()))
            sums = np.zeros((RARE, 2), np.int64)
            np.add.at(sums, of, np.stack([batch.column("c").to_numpy(), np.ones(batch.num_rows, np.int64)], 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["class", "c", "words"])

    sums = np.zeros((RARE, 2))
    for row in others.mapInArrow(run, "class long, c long, words long").groupBy("class").agg(F.sum("c").alias("c"), F.sum("words").alias("words")).collect():
        sums[row["class"]] += row.c, row.words
    spelled, c = known.column("word").cast(pa.binary()).combine_chunks(), known.column("c").to_numpy()
    np.add.at(sums, rare_classes(spelled[TOP - 1 :]), np.stack([c[TOP - 1 :], np.ones(len(c[TOP - 1 :]))], 1))
    totals = [sum(row[x] or 0 for row in by_bin) for x in ("ends", "tokens", "distinct")]
    return Vocabulary(spelled, c, *totals, np.log(sums.sum(1) + 1), sums[:, 0]), others


def train(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The weights after all rounds over texts (text, share: a whole number by which a round chooses)."""
    context = texts.sparkSession.sparkContext
    weights = np.zeros(Model.SIZE, np.float32)
    wide, done = CLASSES, 0
    shared_words = context.broadcast(vocabulary)
    schema = "row int, tokens long, " + ", ".join(f"w{i} long" for i in range(wide))
    for turn, shares in enumerate(ROUNDS):
        own = texts.where(F.pmod("share", F.lit(sum(ROUNDS))).between(done, done + shares - 1)).select("text")
        done += shares
        shared, rate = context.broadcast(weights), RATE / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate: float = rate) -> Iterator[pa.RecordBatch]:
            model = Model(shared_words.value, shared.value.copy())
            squares, n = [np.full(ROWS, 1.0, np.float32), np.full(ROWS, 1.0, np.float32)], 0
            for part in slices(batches):
                found = tokens(part.column("text"), model.vocabulary)
                model.learn(found, squares, rate)
                n += len(found.text)
            if n:
                moved = np.rint((model.weights - shared.value).astype(float) * (FIXED * n / SHARE)).astype(np.int64).reshape(-1, wide)
                rows = np.flatnonzero(moved.any(1))
                columns = [pa.array(np.append(rows, -1).astype(np.int32)), pa.array(np.append(np.zeros(len(rows), np.int64), n))]
                columns += [pa.array(np.append(moved[rows, i], 0)) for i in range(wide)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "tokens", *(f"w{i}" for i in range(wide))])

        sums = own.mapInArrow(run, schema).groupBy("row").agg(F.sum("tokens").alias("tokens"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(wide))).toArrow()
        n = sum(sums.column("tokens").to_pylist())
        if n:
            row, moved = sums.column("row").to_numpy(), np.stack([sums.column(f"w{i}").to_numpy() for i in range(wide)], 1)
            step = np.zeros((Model.SIZE // wide, wide))
            step[row[row >= 0]] = moved[row >= 0] / (FIXED * n / SHARE)
            weights = (weights + step.ravel()).astype(np.float32)
    return weights


def score_texts(documents: DataFrame, folds: int = 7, held: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose crc32 of the id, as text, leaves the remainder `held` are scored without having been learnt from; a null id is
    the empty text. score is log10 of the model's probability of the whole text, base_score that of the unigram model with one
    added to all counts. Null and empty texts are one token, the end. Repeated rows are learnt from and scored one by
    one. With no rows to learn from every count is 0 and the scores are those of the biases; no documents give no rows.
    Other columns, whatever their names, are ignored.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_column].dataType.simpleString()
    hashed = remainder(id_column, 1 << 32)
    rows = documents.select(F.col(f"`{id_column}`").alias("doc_id"), (hashed % folds == held).alias("held_out"), F.floor(hashed / folds).alias("share"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    learnt = rows.where(~F.col("held_out"))
    vocabulary, others = vocabulary_of(table(count_words(learnt)))
    weights = spark.sparkContext.broadcast(train(learnt, vocabulary))
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        model = Model(v, weights.value)
        out_of = np.log10(v.tokens + v.distinct + 1)
        held_counts = np.append(v.counts, [v.ends, 0])  # known is -2 for the end and -1 for words whose count isn't known here
        logged = np.log10(held_counts + 1.0) - out_of
        for part in slices(batches):
            found = tokens(part.column("text"), v)
            n = part.num_rows
            base = logged[found.known]
            sure = held_counts[found.known] > 0
            rare = found.known == -1
            keys, counts = np.unique(found.text[rare] * (len(found.distinct) + 1) + found.code[rare], return_counts=True)
            text, code = np.divmod(keys, len(found.distinct) + 1)
            bounds = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
            sums = [np.bincount(found.text, x, n) for x in (base, model.score(found))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(np.bincount(found.text, minlength=n).astype(np.int64)), pa.array(np.bincount(found.text[sure], minlength=n).astype(np.int64)), *map(pa.array, sums),
                 pa.ListArray.from_arrays(bounds, found.distinct.take(pa.array(code)).cast(pa.string())), pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int64)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "counts"],
            )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<string>, counts array<long>"
    scored = table(rows.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    more = rare.join(others, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("met"))
    nothing = F.coalesce("more", F.lit(0.0))
    return scored.drop("words", "counts").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + nothing).alias("base_score"), (F.col("score") + nothing).alias("score"),
    )
