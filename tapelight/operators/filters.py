"""Tick filters and transforms: DataFrame to DataFrame, all pushed down as far as the scan where they can be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, prior_rows, ratio


def price_range(ticks: DataFrame, low: float, high: float) -> DataFrame:
    return ticks.where(F.col("price").between(low, high))


def min_quantity(ticks: DataFrame, least: float) -> DataFrame:
    return ticks.where(F.col("quantity") >= least)


def symbols(ticks: DataFrame, names: list[str]) -> DataFrame:
    """Case doesn't matter."""
    return ticks.where(F.upper("symbol").isin([n.upper() for n in names]))


def not_stale(ticks: DataFrame, reference_ms: int, most_ms: int) -> DataFrame:
    return ticks.where(F.greatest(F.lit(reference_ms) - F.col("ts_ms"), F.lit(0)) <= most_ms)


def time_range(ticks: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return ticks.where(F.col("ts_ms").between(start_ms, end_ms))


def not_repeated(ticks: DataFrame) -> DataFrame:
    """Without ticks whose price and quantity equal those of the symbol's tick just before."""
    before = F.lag(F.struct("price", "quantity")).over(ordered())
    return ticks.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.struct("price", "quantity"))).drop("before")


def not_outlier(ticks: DataFrame, window: int, most: float) -> DataFrame:
    """Without prices over `most` sample deviations from the mean of the `window` prices before; earlier ticks pass, and those after a flat window."""
    frame = prior_rows(window)
    z = ratio(F.abs(F.col("price") - F.avg("price").over(frame)), F.stddev_samp("price").over(frame))
    return ticks.withColumn("z", F.when(F.count(F.lit(1)).over(frame) >= window, z)).where("z IS NULL OR z <= " + str(float(most))).drop("z")


def chain(ticks: DataFrame, *steps) -> DataFrame:
    """Steps one after the other, each on the survivors of the one before."""
    return reduce(lambda frame, step: step(frame), steps, ticks)


def rounded(column: str, decimals: int) -> Column:
    """Half to even."""
    return F.bround(column, decimals)


def aligned(column: str, grain_ms: int) -> Column:
    """The nearest multiple of the grain, halves up; a grain of 0 changes nothing."""
    if not grain_ms:
        return F.col(column)
    return F.floor((F.col(column) + grain_ms // 2) / grain_ms) * grain_ms


def processed(ticks: DataFrame) -> DataFrame:
    """Positive prices and sizes only, symbol in upper case, and a sequence number per symbol."""
    return ticks.where("price > 0 AND quantity > 0").withColumn("symbol", F.upper("symbol")).withColumn("sequence", F.row_number().over(ordered()) - 1)


def windowed_duplicates(ticks: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """is_duplicate: the same keys came at most window_ms before, in the row just before with these keys."""
    before = F.lag("ts_ms").over(Window.partitionBy(*keys).orderBy("ts_ms", "trade_id"))
    return ticks.withColumn("is_duplicate", F.coalesce(F.col("ts_ms") - before <= window_ms, F.lit(False)))
