"""Connected groups from an index of keys, without expanding the pairs of a group. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import table

#: Keys of an id are taken up in this many turns: see `turn_of`.
TURNS = 3
FEW = 16


def turn_of(place: int) -> int:
    """The turn in which the key at a place of an id's list of keys is taken up: the first, the next four, the rest."""
    return 0 if place == 0 else 1 if place < 5 else 2


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of `keys` whose key has more than one row: the others lead nowhere. One shuffle, of slim rows."""
    return keys.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("members > 1").drop("members")


def link(index: DataFrame, fits: Callable[[Column, Column], Column], confirm: Callable[[DataFrame], DataFrame], dense: Callable[[DataFrame], DataFrame] | None = None, turns: int = TURNS) -> DataFrame:
    """id, component of all ids that some confirmed pair links.

    index: key, id, n, turn; fits(n, m) is a cheap test of a pair; confirm(pairs) keeps the pairs (a, b) that are linked.
    In each turn every id under one of the turn's keys is compared with one id only, its key's hub, unless both are in
    one component already; the hub is of the key's largest component so far, so that what is linked already costs
    nothing. Then whatever pairs of any key still lie in different components are all compared, so every link
    between different components is found. If `dense` is given, it does this for keys with more than FEW ids left
    (key, id, n, component), and returns links (a, b), without a row for each pair.
    """
    links: list[DataFrame] = []
    labels: DataFrame | None = None
    for turn in range(turns + 1):
        now = index.where(F.col("turn") == turn) if turn < turns else index
        if labels is None:
            now = now.select("key", "id", "n", F.col("id").alias("component"), F.lit(1).cast("long").alias("size"))
        else:
            sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
            now = now.join(labels.join(sizes, "component"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
            mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
            now = now.join(mixed, "key")
        if turn < turns:
            hubs = now.groupBy("key").agg(F.max_by(F.struct("id", "n", "component"), F.struct("size", F.xxhash64("component"), F.xxhash64("id"), "id")).alias("hub"))
            met = now.join(hubs, "key").where((F.col("component") != F.col("hub.component")) & fits(F.col("n"), F.col("hub.n")))
            pairs = met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
        else:
            if dense is not None:
                now = table(now.join(now.groupBy("key").agg(F.count(F.lit(1)).alias("ids")), "key"))
                links.append(table(dense(now.where(F.col("ids") > FEW))))
                now = now.where(F.col("ids") <= FEW)
            other = now.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
            met = now.join(other, "key").where((F.col("id") < F.col("b")) & (F.col("component") != F.col("other")) & fits(F.col("n"), F.col("m")))
            pairs = met.select(F.col("id").alias("a"), "b")
        links.append(table(confirm(pairs.distinct())))
        new = links[-2:] if turn == turns and dense is not None else links[-1:]
        if labels is None or not all(found.isEmpty() for found in new):
            labels = components(reduce(DataFrame.unionByName, links))
    return labels
