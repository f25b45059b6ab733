"""As-of, latest-per-key and pair joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """Each left row with the `columns` of the last right row of its key at or before its time; null if there is none.

    One union, one shuffle and one window: no pair of rows is made that isn't in the result.
    """
    marked = F.struct(*columns)
    rows = left.select(*left.columns, F.lit(1).alias("_from"), F.lit(None).cast(right.select(marked).schema[0].dataType).alias("_right"))
    others = right.select(*(F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias("_from"), marked.alias("_right"))
    by = Window.partitionBy(key).orderBy(time, "_from", *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.unionByName(others).withColumn("_last", F.last("_right", ignorenulls=True).over(by)).where("_from = 1")
    return joined.select(*left.columns, *(F.col(f"_last.{c}").alias(c) for c in columns))


def lee_ready(trades: DataFrame) -> DataFrame:
    """buy or sell by the prevailing mid; at the mid, by the change from the trade before (null if unchanged)."""
    by = Window.partitionBy("symbol").orderBy("ts_ms", "trade_id")
    mid = (F.col("bid") + F.col("ask")) / 2
    before = F.lag("price").over(by)
    sign = F.when(F.col("price") > mid, 1).when(F.col("price") < mid, -1).when(F.col("price") > before, 1).when(F.col("price") < before, -1)
    return trades.withColumn("aggressor", sign)


def nbbo(ticks: DataFrame, exchanges: tuple[str, ...]) -> DataFrame:
    """After each tick: best bid and ask as the highest and lowest of the last prices of all exchanges so far."""
    by = Window.partitionBy("symbol").orderBy("ts_ms", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("exchange") == e, F.col("price")), ignorenulls=True).over(by) for e in exchanges]
    return ticks.select("symbol", "trade_id", F.greatest(*last).alias("best_bid"), F.least(*last).alias("best_ask"))


def latest(ticks: DataFrame, *keys: str) -> DataFrame:
    """The last tick of each key."""
    return ticks.groupBy(*keys).agg(F.max_by(F.struct("price", "quantity", "ts_ms", "trade_id"), F.struct("ts_ms", "trade_id")).alias("x")).select(*keys, "x.*")


def arbitrage(latest_ticks: DataFrame, least_bps: float) -> DataFrame:
    """Ordered pairs of exchanges of a symbol whose last prices differ by more than `least_bps` of the lower one."""
    buy = latest_ticks.select("symbol", F.col("exchange").alias("buy"), F.col("price").alias("buy_price"))
    sell = latest_ticks.select("symbol", F.col("exchange").alias("sell"), F.col("price").alias("sell_price"))
    bps = ratio(F.col("sell_price") - F.col("buy_price"), "buy_price") * 1e4
    return buy.join(sell, "symbol").where("buy != sell AND sell_price > buy_price").withColumn("bps", bps).where(F.col("bps") > least_bps)


def correlations(bars: DataFrame, column: str = "close") -> DataFrame:
    """Pearson correlation of the bar returns of every two symbols, over bars they both have: a < b, corr, n."""
    by = Window.partitionBy("symbol").orderBy("bar_start_ms")
    returns = bars.select("symbol", "bar_start_ms", F.log(ratio(column, F.lag(column).over(by))).alias("ret")).where("ret IS NOT NULL")
    other = returns.select(F.col("symbol").alias("other"), "bar_start_ms", F.col("ret").alias("other_ret"))
    correlation = ratio(F.covar_pop("ret", "other_ret"), F.stddev_pop("ret") * F.stddev_pop("other_ret"))  # null where a side is flat
    return returns.join(other, "bar_start_ms").where("symbol < other").groupBy(F.col("symbol").alias("a"), F.col("other").alias("b")).agg(correlation.alias("corr"), F.count(F.lit(1)).alias("n"))


def basket(prices: DataFrame, components: DataFrame) -> DataFrame:
    """Sum of weight * price of each basket; null if any component has no price."""
    joined = components.join(prices, "symbol", "left")
    return joined.groupBy("basket").agg(F.when(F.count("price") == F.count(F.lit(1)), F.sum(F.col("weight") * F.col("price"))).alias("value"))
