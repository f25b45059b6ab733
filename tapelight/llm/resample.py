"""Resampling by importance: documents drawn towards a target distribution of hashed n-grams, without replacement.

A document's features are all runs of one to three of its words. Each falls in one of BUCKETS buckets by the crc32 of
its bytes. A bucket's gain is 1000 times the logarithm of how much more often the target's features fall in it than
the corpus's, and a document's weight is the sum of the gains of its features. Gumbel noise, hashed from the id, is
added; the documents of the highest scores are a sample without replacement in proportion to exp(weight / 1000).

Higher-order functions make each document's array of buckets. The gains, of a fixed number, stand in the plan as one
literal array, and the weight is an aggregate over `element_at` of it: scoring needs no row for each feature, no join and
no shuffle. The counts of buckets are summed before they are shuffled, so only totals are. Ranks come from a sort by
ranges: a place within its range and the sizes of the ranges before, so no task holds more than a range.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

BUCKETS = 10_000
#: Whatever is not an ASCII digit or small letter or beyond ASCII lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def bucket_arrays(documents: DataFrame, text_column: str, *keep: Column) -> DataFrame:
    """`keep`, n_words and buckets: a bucket for each run of one to three consecutive words; null text has none."""
    lowered = F.translate(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    names = [f"keep{i}" for i in range(len(keep))]
    worded = documents.select(*(c.alias(n) for c, n in zip(keep, names, strict=True)), F.array_remove(F.split(lowered, BETWEEN), "").alias("words"))
    space, n = F.lit(" "), F.size("words")

    def from_word(first: int, runs: int) -> Column:
        return F.slice("words", F.lit(first), F.greatest(n - runs + 1, F.lit(0)))

    paired = worded.select(*names, "words", F.zip_with(from_word(1, 2), from_word(2, 2), lambda a, b: F.concat(a, space, b)).alias("pairs"))
    triples = F.zip_with(F.slice("pairs", F.lit(1), F.greatest(n - 2, F.lit(0))), from_word(3, 3), lambda a, b: bucket(F.concat(a, space, b)))
    found = F.concat(F.transform("words", bucket), F.transform("pairs", bucket), triples)
    return paired.select(*names, n.alias("n_words"), found.alias("buckets"))


def totals(documents: DataFrame, text_column: str) -> list[int]:
    """How many features fall in each bucket: at most BUCKETS rows come to the driver.

    The outer explode gives documents without features a row, left out here; for the inner one Spark would make the
    arrays once more to filter by their size.
    """
    counts = bucket_arrays(documents, text_column).select(F.explode_outer("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    out = [0] * BUCKETS
    for row in counts.collect():
        if row.bucket is not None:
            out[row.bucket] = row.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """The gain of each bucket, with one feature more in every bucket of either side."""
    of_corpus, of_target = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1) * of_corpus / ((s + 1) * of_target))) for s, t in zip(corpus, target, strict=True)]


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank numbers the floor(percent * N / 100) rows drawn, N of at least `least_words` words.

    Null and empty texts have no features and weight 0 (they are scored, and drawn only if `least_words` is 0). A null id
    is hashed as an empty one and is the smallest in ties. Repeated rows are rows of their own: they count in N, have the
    same score and come one after the other. An empty target makes all gains those of the corpus against none; no
    documents give no rows. Other columns, whatever their names, are ignored.
    """
    spark = documents.sparkSession
    chosen = F.split(F.lit(",".join(map(str, gains(totals(documents, text_column), totals(target, text_column))))), ",").cast("array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(chosen, b + 1))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform))).cast("long")
    weighed = bucket_arrays(documents, text_column, F.col(f"`{id_column}`")).select(F.col("keep0").alias("doc_id"), "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    scored = table(weighed.select("doc_id", (F.col("n_words") >= least_words).alias("long_enough"), "n_features", "weight", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")))
    drawn = scored.where("long_enough").count() * percent // 100

    order = [F.col("long_enough").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = table(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # one row a range
    at = F.col("before") + F.col("place") - F.shiftleft("part", 33) + 1
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return numbered.select("doc_id", "n_features", "weight", "score", F.when(F.col("long_enough") & (at <= drawn), at).alias("rank"))
