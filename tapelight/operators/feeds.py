"""One stream from several feeds of the same symbols, by time compensated for each feed's delay."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio


def compensated(delays_ms: Mapping[str, int]) -> Column:
    """The time less the delay of the tick's exchange, 0 at least; exchanges without an entry have none."""
    delay = F.coalesce(*(F.when(F.col("exchange") == name, F.lit(ms)) for name, ms in delays_ms.items()), F.lit(0))
    return F.greatest(F.col("ts_ms") - delay, F.lit(0))


def failover(ticks: DataFrame, primary: str, threshold_ms: int, delays_ms: Mapping[str, int]) -> DataFrame:
    """The primary's ticks, and the others' while it is stale: columns of ticks, compensated_ms, is_fallback.

    At a tick the primary is stale for the symbol if its last tick, by compensated time, is more than threshold_ms ago or
    there is none. Ticks of equal time: the primary's come first, then by trade_id.
    """
    own = F.col("exchange") == primary
    timed = ticks.where("ts_ms IS NOT NULL").withColumn("compensated_ms", compensated(delays_ms))
    by = Window.partitionBy("symbol").orderBy("compensated_ms", F.when(own, 0).otherwise(1), "trade_id")
    last = F.last(F.when(own, F.col("compensated_ms")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    stale = last.isNull() | (F.col("compensated_ms") - last > threshold_ms)
    marked = timed.withColumn("stale", stale).withColumn("is_fallback", ~F.coalesce(own, F.lit(False)))
    return marked.where("NOT is_fallback OR stale").drop("stale")


def vwap_merged(ticks: DataFrame, n: int, delays_ms: Mapping[str, int]) -> DataFrame:
    """symbol, compensated_ms, trade_id, price, quantity, anchor_ms: for each tick, the VWAP of it and the next n - 1 of all feeds.

    quantity is their sum and anchor_ms the latest time of them. Where no quantity is traded the price is the latest
    tick's. The last ticks of a symbol have fewer to go with.
    """
    timed = ticks.where("ts_ms IS NOT NULL AND price IS NOT NULL AND quantity IS NOT NULL").withColumn("compensated_ms", compensated(delays_ms))
    ahead = ordered(order=("compensated_ms", "trade_id")).rowsBetween(0, n - 1)
    traded, turnover = F.sum("quantity").over(ahead), F.sum(F.col("price") * F.col("quantity")).over(ahead)
    price = F.coalesce(ratio(turnover, traded), F.last("price").over(ahead))
    return timed.select("symbol", "compensated_ms", "trade_id", price.alias("price"), traded.alias("quantity"), F.max("compensated_ms").over(ahead).alias("anchor_ms"))
