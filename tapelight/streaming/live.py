"""Structured Streaming twins of the batch operators. Input: symbol, price, quantity, trade_id and an event time `ts`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, period: str, late: str) -> DataFrame:
    """A bar of each period once the watermark has passed it; ticks later than `late` are dropped."""
    order = F.struct("ts", "trade_id")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", period).alias("w"))
    out = grouped.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trade_count"))
    return out.select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "trade_count")


def deduplicated(ticks: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The first of rows with equal keys whose event times are within the watermark's delay."""
    return ticks.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def health(beats: DataFrame, period: str, late: str) -> DataFrame:
    """Beats of each feed in each period (feed_id, ts); a period without a row had none."""
    return beats.withWatermark("ts", late).groupBy("feed_id", F.window("ts", period).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).select("feed_id", F.col("w.start").alias("period_start"), "n", "last")
