"""Spreads, impact, risk, execution and portfolio measures over ticks and bars: aggregates and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import last_rows, ordered, ratio, so_far
from .rolling import trailing

BAR = ("bar_start_ms",)


def returns(bars: DataFrame) -> DataFrame:
    """Bars with `ret`, the logarithmic return of the close; null on a symbol's first bar and beside a zero."""
    return bars.withColumn("ret", F.log(ratio("close", F.lag("close").over(ordered(order=BAR)))))


def momentum(bars: DataFrame, n: int) -> DataFrame:
    """Change over n bars, the same by the deviation of the returns, and its rank among the symbols of the bar."""
    frame = last_rows(n, order=BAR)
    out = returns(bars).select("symbol", *BAR, (ratio("close", F.lag("close", n).over(ordered(order=BAR))) - 1).alias("momentum"), F.stddev_pop("ret").over(frame).alias("vol"))
    out = out.where("momentum IS NOT NULL").withColumn("adjusted", ratio("momentum", "vol"))
    return out.withColumn("place", F.rank().over(Window.partitionBy(*BAR).orderBy(F.desc("momentum"), "symbol")))


def vol_of_vol(bars: DataFrame, n: int) -> DataFrame:
    """Deviation, over n bars, of the deviation of returns over n bars."""
    frame = last_rows(n, order=BAR)
    out = returns(bars).withColumn("vol", F.stddev_pop("ret").over(frame))
    return out.select("symbol", *BAR, "vol", F.stddev_pop("vol").over(frame).alias("vol_of_vol"))


def variance_ratio(bars: DataFrame, q: int) -> DataFrame:
    """Variance of q-bar returns over q times that of one-bar returns: above 1 trends, below 1 reverts."""
    long = F.log(ratio("close", F.lag("close", q).over(ordered(order=BAR))))
    out = returns(bars).withColumn("long", long)
    return out.groupBy("symbol").agg(ratio(F.var_pop("long"), q * F.var_pop("ret")).alias("ratio"), F.count("long").alias("n"))


def hedge(bars: DataFrame) -> DataFrame:
    """Least squares of the close of b on that of a, over bars of both: slope, intercept, r2 and the mean squared residual."""
    a = bars.select(*BAR, F.col("symbol").alias("a"), F.col("close").alias("x"))
    b = bars.select(*BAR, F.col("symbol").alias("b"), F.col("close").alias("y"))
    both = a.join(b, BAR[0]).where("a < b").groupBy("a", "b")
    out = both.agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n"))
    slope = ratio("xy", "xx")
    return out.select("a", "b", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), ratio(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy")).alias("r2"), (F.col("yy") - slope * F.col("xy")).alias("residual"), "n")


def spreads(ticks: DataFrame, half: float, later: int) -> DataFrame:
    """Effective spread against the mean of the last two prices, realised spread and impact against the price `later` ticks on."""
    by = ordered()
    mid = (F.col("price") + F.lag("price").over(by)) / 2
    after = F.lead("price", later).over(by)
    out = ticks.select("symbol", "trade_id", (2 * F.abs(F.col("price") - mid)).alias("effective"), (2 * F.col("side") * (F.col("price") - after)).alias("realised"), (2 * F.col("side") * (after - mid)).alias("impact"))
    return out.withColumn("is_wide", F.col("effective") > 2 * half)


def micro_price(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """The mid weighted by the size on the other side; null without sizes."""
    return ratio(bid * ask_size + ask * bid_size, bid_size + ask_size)


def toxicity(ticks: DataFrame, volume: float, n: int) -> DataFrame:
    """Volume buckets of `volume`: share of the imbalance of buys and sells in each, and its mean over n buckets."""
    upto = F.sum("quantity").over(so_far())
    dealt = ticks.withColumn("bucket", F.floor((upto - F.col("quantity")) / volume))
    own = dealt.groupBy("symbol", "bucket").agg(F.sum(F.col("side") * F.col("quantity")).alias("net"), F.sum("quantity").alias("total"))
    own = own.withColumn("share", ratio(F.abs("net"), F.col("total")))
    return own.select("symbol", "bucket", "share", F.avg("share").over(last_rows(n, order=("bucket",))).alias("toxicity"))


def levels(ticks: DataFrame, step: float, wall: float) -> DataFrame:
    """Quantity at each price level and side, and whether it is a wall: over `wall` times the side's mean level."""
    level = F.floor(F.col("price") / step)
    own = ticks.groupBy("symbol", "side", level.alias("level")).agg(F.sum("quantity").alias("depth"), F.count(F.lit(1)).alias("n"))
    return own.withColumn("is_wall", F.col("depth") > wall * F.avg("depth").over(Window.partitionBy("symbol", "side")))


def depth_within(ticks: DataFrame, share: float) -> DataFrame:
    """Per symbol and side: quantity at prices within `share` of the symbol's last price, and beyond."""
    last = ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts_ms", "trade_id")).alias("last"))
    near = F.abs(F.col("price") - F.col("last")) <= share * F.col("last")
    quantity = F.col("quantity")
    return ticks.join(last, "symbol").groupBy("symbol", "side").agg(F.sum(F.when(near, quantity).otherwise(0.0)).alias("within"), F.sum(F.when(~near, quantity).otherwise(0.0)).alias("beyond"))


def open_positions(ticks: DataFrame, *keys: str) -> DataFrame:
    """Bought less sold, mean price of the buys, and the profit not yet realised at the last price."""
    buy = F.col("side") > 0
    out = ticks.groupBy(*keys).agg(F.sum(F.col("side") * F.col("quantity")).alias("net"), ratio(F.sum(F.when(buy, F.col("price") * F.col("quantity"))), F.sum(F.when(buy, F.col("quantity")))).alias("cost"), F.max_by("price", F.struct("ts_ms", "trade_id")).alias("mark"))
    return out.withColumn("unrealised", F.col("net") * (F.col("mark") - F.col("cost")))


def volume_schedule(ticks: DataFrame, quantity: float) -> DataFrame:
    """An order of `quantity` cut by the volume of each hour of the day, with what is done by its end."""
    hour = F.floor(F.col("ts_ms") / 3_600_000) % 24
    own = ticks.groupBy("symbol", hour.alias("hour")).agg(F.sum("quantity").alias("volume"))
    out = own.withColumn("slice", ratio(quantity * F.col("volume"), F.sum("volume").over(Window.partitionBy("symbol"))))
    return out.select("symbol", "hour", "slice", F.sum("slice").over(so_far(order=("hour",))).alias("done"))


def participation(ticks: DataFrame, ms: int) -> DataFrame:
    """Share of each tick's quantity in the volume of the trailing interval, and the change of price over it."""
    of = {"volume": ("sum", "quantity"), "n": ("count", "quantity"), "top": ("max", "price"), "bottom": ("min", "price")}
    out = trailing(ticks.select("symbol", "trade_id", "ts_ms", "price", "quantity"), ms, of)
    return out.select("symbol", "trade_id", ratio("quantity", "volume").alias("share"), (F.col("top") - F.col("bottom")).alias("span"), ratio("volume", "n").alias("mean_quantity"))


def venues(ticks: DataFrame) -> DataFrame:
    """Per symbol and exchange: mean price, volume, its share of the symbol's, and the rank by volume."""
    own = ticks.groupBy("symbol", "exchange").agg(F.avg("price").alias("price"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("symbol")
    return own.withColumn("share", ratio("volume", F.sum("volume").over(by))).withColumn("place", F.rank().over(by.orderBy(F.desc("volume"), "exchange")))


def triangles(prices: DataFrame, fee: float) -> DataFrame:
    """Cycles of three of the symbols (symbol, price, other): what is left of one unit after three conversions, each less a fee.

    prices: rate of `symbol` in `other`; a cycle begins at its least symbol.
    """
    first, second, third = (prices.select(F.col("symbol").alias(x), F.col("other").alias(y), F.col("price").alias(p)) for x, y, p in (("a", "b", "p"), ("b", "c", "q"), ("c", "a", "r")))
    left = F.col("p") * F.col("q") * F.col("r") * (1 - fee) ** 3
    return first.join(second, "b").join(third, ["c", "a"]).where("a < b AND a < c AND b != c").select("a", "b", "c", left.alias("left"), (left > 1).alias("is_gain"))


def portfolio_variance(bars: DataFrame, weights: DataFrame, z: float) -> DataFrame:
    """One row: variance of the returns weighted by weights (symbol, weight), over bars of both of a pair, and the parametric value at risk."""
    own = returns(bars).where("ret IS NOT NULL").join(weights, "symbol").select(*BAR, "symbol", "ret", F.col("weight").alias("w"))
    other = own.select(*BAR, F.col("symbol").alias("other"), F.col("ret").alias("ret2"), F.col("w").alias("w2"))
    pairs = own.join(other, BAR[0]).groupBy("symbol", "other").agg((F.max("w") * F.max("w2") * F.covar_pop("ret", "ret2")).alias("part"))
    return pairs.agg(F.sum("part").alias("variance"), (z * F.sqrt(F.greatest(F.sum("part"), F.lit(0.0)))).alias("value_at_risk"))


def funding(ticks: DataFrame, periods: int) -> DataFrame:
    """Rates (symbol, rate, ts_ms): mean, annual (periods a year), last, and whether the last is above the mean."""
    out = ticks.groupBy("symbol").agg(F.avg("rate").alias("mean"), F.max_by("rate", F.struct("ts_ms", "trade_id")).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("annual", F.col("mean") * periods).withColumn("is_rising", F.col("last") > F.col("mean"))


def sentiment(scores: DataFrame, day_ms: int = 86_400_000) -> DataFrame:
    """Scores (symbol, score, weight, ts_ms): the weighted mean of each day, its change, and the mean of three days."""
    day = F.floor(F.col("ts_ms") / day_ms)
    own = scores.groupBy("symbol", day.alias("day")).agg(ratio(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("mean"), F.count(F.lit(1)).alias("n"))
    by = ordered(order=("day",))
    return own.withColumns({"change": F.col("mean") - F.lag("mean").over(by), "three_days": F.avg("mean").over(last_rows(3, order=("day",)))})
