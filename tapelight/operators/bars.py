"""Bars from ticks. Time bars are one grouped aggregation; their partial sums combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio, so_far


def ohlcv(order: Column) -> list[Column]:
    return [
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trade_count"), F.sum(F.col("price") * F.col("quantity")).alias("turnover"),
    ]


def time_bars(ticks: DataFrame, period_ms: int) -> DataFrame:
    """symbol, bar_start_ms (aligned to the epoch), open, high, low, close, volume, trade_count, turnover, vwap (null without volume)."""
    start = (F.floor(F.col("ts_ms") / period_ms) * period_ms).alias("bar_start_ms")
    bars = ticks.groupBy("symbol", start).agg(*ohlcv(F.struct("ts_ms", "trade_id")))
    return bars.withColumn("vwap", ratio("turnover", "volume"))


def multi_time_bars(ticks: DataFrame, periods_ms: list[int]) -> DataFrame:
    """Bars of several periods from one scan."""
    each = ticks.withColumn("period_ms", F.explode(F.array(*map(F.lit, periods_ms))))
    start = (F.floor(F.col("ts_ms") / F.col("period_ms")) * F.col("period_ms")).alias("bar_start_ms")
    return each.groupBy("symbol", "period_ms", start).agg(*ohlcv(F.struct("ts_ms", "trade_id")))


def tick_bars(ticks: DataFrame, size: int) -> DataFrame:
    """A bar for every `size` ticks of a symbol, the last one possibly shorter."""
    numbered = ticks.withColumn("bar", F.floor((F.row_number().over(ordered()) - 1) / size))
    return numbered.groupBy("symbol", "bar").agg(*ohlcv(F.struct("ts_ms", "trade_id")), F.min("ts_ms").alias("start_ms"))


def split_volume_bars(ticks: DataFrame, size: float) -> DataFrame:
    """Bars of equal volume, a tick's quantity split over the bars it spans: symbol, bar, buy, sell, volume."""
    before = F.sum("quantity").over(so_far()) - F.col("quantity")
    spans = ticks.where("quantity > 0").withColumn("begin", before).withColumn("end", F.col("begin") + F.col("quantity"))
    last = F.ceil(F.col("end") / size) - 1
    each = spans.withColumn("bar", F.explode(F.sequence(F.floor(F.col("begin") / size), last)))
    part = F.least("end", (F.col("bar") + 1) * size) - F.greatest("begin", F.col("bar") * size)
    each = each.withColumn("part", part)
    return each.groupBy("symbol", "bar").agg(F.sum(F.when(F.col("side") > 0, F.col("part")).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("side") < 0, F.col("part")).otherwise(0.0)).alias("sell"), F.sum("part").alias("volume"))


def vpin(ticks: DataFrame, size: float, window: int) -> DataFrame:
    """Mean absolute imbalance of the last `window` complete volume bars, null until there are as many."""
    full = split_volume_bars(ticks, size).where(F.round("volume", 6) >= size)
    frame = Window.partitionBy("symbol").orderBy("bar").rowsBetween(1 - window, 0)
    value = F.avg(F.abs(F.col("buy") - F.col("sell")) / size).over(frame)
    return full.select("symbol", "bar", F.when(F.count(F.lit(1)).over(frame) >= window, value).alias("vpin"))


def gap_fill(bars: DataFrame, period_ms: int) -> DataFrame:
    """Adds bars without volume at the last close wherever a symbol has none; is_gap_fill marks them."""
    following = F.lead("bar_start_ms").over(Window.partitionBy("symbol").orderBy("bar_start_ms"))
    empty = bars.withColumn("next_ms", following).where(F.col("next_ms") > F.col("bar_start_ms") + period_ms)
    filled = empty.select("symbol", F.explode(F.sequence(F.col("bar_start_ms") + period_ms, F.col("next_ms") - period_ms, F.lit(period_ms))).alias("bar_start_ms"), *(F.col("close").alias(c) for c in ("open", "high", "low", "close")), F.lit(0.0).alias("volume"), F.lit(0).cast("long").alias("trade_count"))
    return bars.select(*filled.columns).withColumn("is_gap_fill", F.lit(False)).unionByName(filled.withColumn("is_gap_fill", F.lit(True)))


def twap(ticks: DataFrame, period_ms: int) -> DataFrame:
    """Time-weighted price of each period: every price holds until the symbol's next tick in the period; a lone tick is its price."""
    bucket = F.floor(F.col("ts_ms") / period_ms) * period_ms
    by = Window.partitionBy("symbol", "bar_start_ms").orderBy("ts_ms", "trade_id")
    held = ticks.withColumn("bar_start_ms", bucket).withColumn("held", F.coalesce(F.lead("ts_ms").over(by) - F.col("ts_ms"), F.lit(0)))
    return held.groupBy("symbol", "bar_start_ms").agg(F.coalesce(ratio(F.sum(F.col("price") * F.col("held")), F.sum("held")), F.max_by("price", F.struct("ts_ms", "trade_id"))).alias("twap"))


def cumulative_vwap(ticks: DataFrame, interval_ms: int) -> DataFrame:
    """Running VWAP that starts anew each interval, counted from the symbol's first trade."""
    first = F.min("ts_ms").over(Window.partitionBy("symbol"))
    period = F.floor((F.col("ts_ms") - first) / interval_ms)
    frame = Window.partitionBy("symbol", "period").orderBy("ts_ms", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumn("period", period).withColumn("vwap", ratio(F.sum(F.col("price") * F.col("quantity")).over(frame), F.sum("quantity").over(frame)))
