"""Estimators over series of prices and signals: lags, moments and aggregates, never a loop over rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio

BAR = ("bar_start_ms",)


def roll_spread(ticks: DataFrame) -> DataFrame:
    """Roll's implied spread per symbol: 2 * sqrt(-covariance of successive price changes); null unless that is negative."""
    by = ordered()
    change = ticks.select("symbol", "ts_ms", "trade_id", (F.col("price") - F.lag("price").over(by)).alias("change"))
    both = change.withColumn("before", F.lag("change").over(by)).where("before IS NOT NULL")
    moved = F.covar_pop("change", "before")
    return both.groupBy("symbol").agg(F.when(moved < 0, 2 * F.sqrt(-moved)).alias("spread"), F.count(F.lit(1)).alias("n"))


def high_low_spread(bars: DataFrame) -> DataFrame:
    """Corwin and Schultz's spread per symbol from successive bars' highs and lows; null if a low isn't above 0 or above its high."""
    by = ordered(order=BAR)
    own = bars.select("symbol", "high", "low", F.lag("high").over(by).alias("h"), F.lag("low").over(by).alias("l"))
    good = (F.col("low") > 0) & (F.col("high") >= F.col("low"))
    one, before = F.ln(ratio("high", "low")), F.ln(ratio("h", "l"))
    two = F.ln(ratio(F.greatest("high", "h"), F.least("low", "l")))
    parts = own.select("symbol", good.alias("good"), F.when(F.col("h").isNotNull(), one * one + before * before).alias("beta"), F.when(F.col("h").isNotNull(), two * two).alias("gamma"))
    out = parts.groupBy("symbol").agg(F.every("good").alias("good"), F.avg("beta").alias("beta"), F.avg("gamma").alias("gamma"))
    k = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(2 * F.col("beta")) - F.sqrt("beta")) / k - F.sqrt(F.col("gamma") / k)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return out.select("symbol", F.when(F.col("good"), F.greatest(spread, F.lit(0.0))).alias("spread"))


def mean_reversion(series: DataFrame, *keys: str, order=BAR) -> DataFrame:
    """Least squares of a series' changes on its values before (columns keys, value): slope, its t statistic, half-life.

    The half-life is null where the slope isn't below 0; the statistic is null on a flat series.
    """
    by = ordered(keys, order)
    own = series.select(*keys, *order, "value", F.lag("value").over(by).alias("before")).where("before IS NOT NULL")
    own = own.withColumn("change", F.col("value") - F.col("before"))
    out = own.groupBy(*keys).agg(F.covar_pop("change", "before").alias("xy"), F.var_pop("before").alias("xx"), F.var_pop("change").alias("yy"), F.count(F.lit(1)).alias("n"))
    slope = ratio("xy", "xx")
    left = F.greatest(F.col("yy") - slope * F.col("xy"), F.lit(0.0))
    error = F.sqrt(ratio(left * F.col("n") / F.greatest(F.col("n") - 2, F.lit(1)), F.col("xx") * F.col("n")))
    half = F.when(slope < 0, ratio(F.lit(-math.log(2)), slope))
    return out.select(*keys, slope.alias("slope"), ratio(slope, error).alias("t"), half.alias("half_life"), "n")


def hurst(bars: DataFrame) -> DataFrame:
    """Rescaled range of each symbol's log returns on the scale of the whole series: ln(R / S) / ln(n) within 0 to 1; null below 4 returns."""
    by = ordered(order=BAR)
    ret = bars.select("symbol", *BAR, F.ln(ratio("close", F.lag("close").over(by))).alias("ret")).where("ret IS NOT NULL")
    means = ret.groupBy("symbol").agg(F.avg("ret").alias("mean"))
    off = ret.join(means, "symbol").withColumn("off", F.sum(F.col("ret") - F.col("mean")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = off.groupBy("symbol").agg((F.max("off") - F.min("off")).alias("span"), F.stddev_pop("ret").alias("s"), F.count(F.lit(1)).alias("n"))
    h = F.ln(ratio("span", "s")) / F.ln("n")
    return out.select("symbol", F.when((F.col("n") >= 4) & (F.col("s") >= 1e-15) & (F.col("span") > 0), F.greatest(F.least(h, F.lit(1.0)), F.lit(0.0))).alias("hurst"), "n")


def informed_trading(buys: DataFrame) -> DataFrame:
    """Probability of informed trading per symbol, by moments of the periods' bought and sold volume (symbol, bought, sold)."""
    means = buys.groupBy("symbol").agg(F.avg("bought").alias("b"), F.avg("sold").alias("s"))
    mu = F.abs(F.col("b") - F.col("s"))
    alpha = F.coalesce(ratio(mu, F.col("b") + F.col("s") + mu), F.lit(0.0))
    pin = F.coalesce(ratio(alpha * mu, alpha * mu + F.col("b") + F.col("s")), F.lit(0.0))
    delta = F.when(F.col("b") > F.col("s"), 0.5 + 0.5 * alpha).otherwise(0.5 - 0.5 * alpha)
    return means.select("symbol", pin.alias("pin"), alpha.alias("alpha"), delta.alias("delta"), mu.alias("mu"))


def sandwiches(ticks: DataFrame, n: int, threshold: float) -> DataFrame:
    """Ticks before a rise to the next price and a fall from it, each of `threshold` or more; the fall within n ticks after the rise.

    symbol, trade_id, peak, after: the price of the first of those ticks that is low enough.
    """
    by = ordered()
    peak = F.lead("price").over(by)
    later = F.collect_list("price").over(by.rowsBetween(2, n + 1))  # n prices at most
    rows = ticks.select("symbol", "trade_id", "price", peak.alias("peak"), later.alias("later"))
    rose = ratio(F.col("peak") - F.col("price"), F.col("price")) >= threshold
    low = F.filter("later", lambda p: ratio(F.col("peak") - p, F.col("peak")) >= threshold)
    return rows.withColumn("after", F.try_element_at(low, F.lit(1))).where(rose & F.col("after").isNotNull()).select("symbol", "trade_id", "peak", "after")


def front_runs(ticks: DataFrame, nearness: float, times: float) -> DataFrame:
    """Ticks followed at nearly the same price by one of `times` their quantity or more: symbol, trade_id, share, confidence."""
    by = ordered()
    rows = ticks.select("symbol", "trade_id", "price", "quantity", F.lead("price").over(by).alias("p"), F.lead("quantity").over(by).alias("q"))
    near = (F.col("price") != 0) & (ratio(F.abs(F.col("price") - F.col("p")), F.col("p")) <= nearness)
    large = (F.col("quantity") != 0) & (F.col("q") >= times * F.col("quantity"))
    share = ratio("q", "quantity")
    confidence = F.greatest(F.least(F.least(share, F.lit(20.0)) / 20, F.lit(0.9)), F.lit(0.1))
    return rows.where(near & large).select("symbol", "trade_id", share.alias("share"), confidence.alias("confidence"))


def cross_section(bars: DataFrame, later: int) -> DataFrame:
    """Each bar's momentum, its z-score among the symbols of the bar (0 where all are alike), and the return `later` bars on."""
    by = ordered(order=BAR)
    own = bars.select("symbol", *BAR, (ratio("close", F.lag("close").over(by)) - 1).alias("signal"), (ratio(F.lead("close", later).over(by), F.col("close")) - 1).alias("forward")).where("signal IS NOT NULL")
    same = Window.partitionBy(*BAR)
    deviation = F.stddev_pop("signal").over(same)
    return own.withColumn("z", F.when(deviation < 1e-12, 0.0).otherwise((F.col("signal") - F.avg("signal").over(same)) / deviation))


def information_coefficient(signals: DataFrame) -> DataFrame:
    """Correlation of z-scores and later returns per symbol, the share of equal signs, and the number of pairs."""
    both = signals.where("forward IS NOT NULL")
    hit = (F.signum("z") == F.signum("forward")).cast("double")
    flat = (F.var_pop("z") > 0) & (F.var_pop("forward") > 0)
    return both.groupBy("symbol").agg(F.when(flat, F.corr("z", "forward")).alias("ic"), F.avg(hit).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


#: Coefficients of the linear, square-root and permanent impact.
ETA, GAMMA = 0.1, 0.1


def slippage(quantity: Column, daily: Column, volatility: Column, spread_bps: Column, risk: float) -> dict[str, Column]:
    """Impact in basis points of an order by four models, half the spread, and the days to spread it over at a risk aversion."""
    share = F.abs(quantity) / F.greatest(daily, F.lit(1.0))
    return {
        "participation": share, "spread_cost": spread_bps / 2, "linear": ETA * share * volatility * 1e4, "square_root": ETA * F.sqrt(share) * volatility * 1e4, "invariant": volatility * F.sqrt(share) * 1e4, "permanent": (GAMMA + ETA) * share * 1e4,
        "horizon": F.sqrt(share * abs(risk) / GAMMA),
    }


def equal_slices(orders: DataFrame, n: int) -> DataFrame:
    """Each order (order_id, quantity) cut in n equal slices, numbered from 0."""
    return orders.select("order_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"), (F.col("quantity") / n).alias("quantity"))


def profile_slices(orders: DataFrame, profile: list[float]) -> DataFrame:
    """Each order cut in proportion to a volume profile; in equal parts if it adds up to 0."""
    total = sum(profile)
    shares = [p / total if total > 0 else 1 / len(profile) for p in profile]
    return orders.select("order_id", "quantity", F.posexplode(F.array(*map(F.lit, shares))).alias("slice", "share")).select("order_id", "slice", (F.col("quantity") * F.col("share")).alias("quantity"))


def stops(positions: DataFrame, loss: float, gain: float) -> DataFrame:
    """Positions (net, cost, mark, ..) with profit per cent and whether a stop at `loss` or a target at `gain` of the cost is reached."""
    side = F.signum("net")
    moved = ratio(side * (F.col("mark") - F.col("cost")), F.col("cost"))
    return positions.withColumns({"pnl_pct": moved * 100, "is_stopped_out": F.coalesce(moved <= -loss, F.lit(False)), "is_take_profit": F.coalesce(moved >= gain, F.lit(False))})


def health_summary(feeds: DataFrame) -> DataFrame:
    """One row over feeds (feed_id, last_ms, n, age_ms, is_stale): counts, shares, ages, and the feeds at the ends."""
    known, stale = F.col("last_ms").isNotNull(), F.col("last_ms").isNotNull() & F.col("is_stale")
    healthy = known & ~F.col("is_stale")
    oldest = F.struct(F.coalesce("last_ms", F.lit(-1)), "feed_id")
    return feeds.agg(
        F.count_if(healthy).alias("healthy"), F.count_if(stale).alias("stale"), F.count_if(~known).alias("unknown"), ratio(F.count_if(stale), F.count_if(known)).alias("stale_ratio_known"), ratio(F.count_if(healthy), F.count(F.lit(1))).alias("healthy_ratio"),
        F.avg("age_ms").alias("mean_age_ms"), F.max("age_ms").alias("oldest_age_ms"), F.min(F.when(healthy, F.col("age_ms"))).alias("least_healthy_age_ms"), F.min_by("feed_id", oldest).alias("most_stale"), F.min_by("feed_id", F.when(stale, oldest)).alias("oldest_stale"),
        F.max_by("feed_id", F.struct("n", "feed_id")).alias("most_ticks"), F.max_by("feed_id", F.when(known, F.struct("last_ms", "feed_id"))).alias("last_updated"), ((F.count_if(healthy) > 0) & (F.count_if(healthy) < F.count(F.lit(1)))).alias("is_degraded"),
    )
