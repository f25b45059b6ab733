"""Grouped reports: statistics, data quality, seasonality, execution, portfolio and feed health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio


def tick_stats(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("volume"), ratio(F.sum(F.col("price") * F.col("quantity")), F.sum("quantity")).alias("vwap"), F.min("price").alias("low"), F.max("price").alias("high"), F.max_by("price", F.struct("ts_ms", "trade_id")).alias("last"))


def feed_quality(ticks: DataFrame, gap_ms: int) -> DataFrame:
    """Per symbol: share of gaps over gap_ms and of repeated (price, quantity), p99 of the time between ticks, and a score.

    score = 100 * (1 - gaps) * (1 - repeats) * exp(-p99 / 1000 s); the p99 is a nearest rank.
    """
    by = ordered()
    d = ticks.withColumn("wait", F.col("ts_ms") - F.lag("ts_ms").over(by)).withColumn("same", (F.lag("price").over(by) == F.col("price")) & (F.lag("quantity").over(by) == F.col("quantity")))
    rows = Window.partitionBy("symbol")
    ranked = d.where("wait IS NOT NULL").withColumn("rank", F.row_number().over(rows.orderBy("wait")) - 1).withColumn("n", F.count(F.lit(1)).over(rows))
    report = ranked.groupBy("symbol").agg(F.avg((F.col("wait") > gap_ms).cast("double")).alias("gap_rate"), F.avg(F.col("same").cast("double")).alias("repeat_rate"), F.max(F.when(F.col("rank") == F.round(0.99 * (F.col("n") - 1)), F.col("wait"))).alias("p99_ms"))
    return report.withColumn("score", 100 * (1 - F.col("gap_rate")) * (1 - F.col("repeat_rate")) * F.exp(-F.col("p99_ms") / 1e6))


def intraday_profile(ticks: DataFrame) -> DataFrame:
    """Mean price and volume of every hour of the UTC day."""
    hour = F.floor(F.col("ts_ms") / 3_600_000) % 24
    return ticks.groupBy("symbol", hour.alias("hour")).agg(F.avg("price").alias("price"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("n"))


def weekday_effect(bars: DataFrame) -> DataFrame:
    """Mean return from open to close of each weekday (0 is Monday)."""
    day = (F.floor(F.col("bar_start_ms") / 86_400_000) + 3) % 7
    return bars.groupBy("symbol", day.alias("weekday")).agg(F.avg(ratio("close", "open") - 1).alias("ret"), F.count(F.lit(1)).alias("n"))


def best_hours(profile: DataFrame, share: float) -> DataFrame:
    """Hours whose volume is at least `share` of the symbol's largest."""
    return profile.withColumn("most", F.max("volume").over(Window.partitionBy("symbol"))).where(F.col("volume") >= share * F.col("most")).drop("most")


def latency_histogram(ticks: DataFrame) -> DataFrame:
    """Counts of the time between ticks in logarithmic buckets, four to a doubling."""
    wait = ticks.select("symbol", (F.col("ts_ms") - F.lag("ts_ms").over(ordered())).alias("wait")).where("wait > 0")
    exponent = F.floor(F.log2("wait"))
    part = F.floor((F.col("wait") / F.pow(F.lit(2.0), exponent) - 1) * 4)
    return wait.groupBy("symbol", (exponent * 4 + part).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def risk(bars: DataFrame, level: float = 0.95) -> DataFrame:
    """Per symbol: annual volatility (sample, 252), historical VaR and expected shortfall, Sharpe ratio, worst drawdown."""
    by = Window.partitionBy("symbol").orderBy("bar_start_ms")
    returns = bars.withColumn("ret", F.log(ratio("close", F.lag("close").over(by)))).withColumn("lost", 1 - ratio("close", F.max("close").over(by)))
    rows = Window.partitionBy("symbol")
    ranked = returns.withColumn("n", F.count("ret").over(rows)).withColumn("rank", F.row_number().over(rows.orderBy(F.col("ret").asc_nulls_last())) - 1)
    at = F.floor((1 - level) * F.col("n"))
    return ranked.groupBy("symbol").agg(
        (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), (-F.max(F.when(F.col("rank") == at, F.col("ret")))).alias("var"), (-F.avg(F.when(F.col("rank") <= at, F.col("ret")))).alias("shortfall"),
        (ratio(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.max("lost").alias("max_drawdown"),
    )


def execution_quality(fills: DataFrame) -> DataFrame:
    """Per symbol: mean slippage in basis points ((executed - arrival) / arrival * side), share without slippage, mean shortfall against the benchmark."""
    slip = ratio(F.col("executed_price") - F.col("arrival_price"), "arrival_price") * 1e4 * F.col("side")
    short = ratio(F.col("executed_price") - F.col("benchmark_price"), "benchmark_price") * 1e4 * F.col("side")
    return fills.withColumn("slip", slip).groupBy("symbol").agg(F.avg("slip").alias("slippage_bps"), F.avg((F.col("slip") <= 0).cast("double")).alias("fill_rate"), F.avg(short).alias("shortfall_bps"), F.count(F.lit(1)).alias("n"))


def exposure(positions: DataFrame) -> DataFrame:
    """Gross, net, long and short value, the largest share and the Herfindahl index of each account."""
    value = F.col("value")
    own = positions.withColumn("gross", F.sum(F.abs("value")).over(Window.partitionBy("account")))
    share = ratio(F.abs(value), F.col("gross"))
    return own.groupBy("account").agg(F.sum(F.abs(value)).alias("gross"), F.sum(value).alias("net"), F.sum(F.greatest(value, F.lit(0.0))).alias("long"), F.sum(F.greatest(-value, F.lit(0.0))).alias("short"), F.max(share).alias("largest"), F.sum(share * share).alias("hhi"))


def feed_health(beats: DataFrame, as_of_ms: int, stale_ms: int) -> DataFrame:
    """Per feed: last beat, age at as_of_ms and whether it is stale."""
    return beats.where(F.col("ts_ms") <= as_of_ms).groupBy("feed_id").agg(F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n")).withColumn("age_ms", as_of_ms - F.col("last_ms")).withColumn("is_stale", F.col("age_ms") > stale_ms)


def brinson(sectors: DataFrame) -> DataFrame:
    """Allocation, selection and interaction of each sector (weights pw, bw; returns pr, br) against the benchmark's total."""
    total = F.sum(F.col("bw") * F.col("br")).over(Window.partitionBy("period"))
    active = F.col("pw") - F.col("bw")
    return sectors.select("period", "sector", (active * (F.col("br") - total)).alias("allocation"), (F.col("bw") * (F.col("pr") - F.col("br"))).alias("selection"), (active * (F.col("pr") - F.col("br"))).alias("interaction"))


def quantiles(rows: DataFrame, key: str, column: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles of each key: the value at round(share * (n - 1)) of the sorted ones; nulls don't count.

    Equal values are counted first, so a key costs a row for each distinct value.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("rows"))
    by = Window.partitionBy(key)
    upto = counted.withColumn("n", F.sum("rows").over(by)).withColumn("upto", F.sum("rows").over(by.orderBy(column)))
    at = {name: F.round(F.lit(share) * (F.col("n") - 1)) for name, share in shares.items()}
    return upto.groupBy(key).agg(*(F.min(F.when(F.col("upto") > place, F.col(column))).alias(name) for name, place in at.items()))
