"""Rolling statistics and indicators over ticks or bars: frames of a fixed number of rows or of time.

Frames are partitioned by symbol. Unless an operator says otherwise, what is divided by zero, and the logarithm of what isn't positive, is null. State that can't be a frame (Wilder averages and the like) is in folds.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.frames import full, last_rows, ordered, prior_rows, quotient, ratio, so_far, zscore
from .carried import carried
from .framed import trade_statistics


def trailing(rows: DataFrame, ms: int, of: dict[str, tuple[str, str]], key=("symbol",), time: str = "ts_ms") -> DataFrame:
    """rows with aggregates over those of the interval [t - ms, t]; `of` maps a new column to (count, sum, min or max; column).

    Time is cut into periods of `ms`. An interval is what its own period has so far and the end of the period before, so
    each row stands in its own period and, moved by `ms`, in the next; running aggregates from both ends are joined. Hence
    the work doesn't grow with the rows of an interval, and a task needs a key's rows of two periods only. Rows without a
    time see each other.
    """
    both = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_own")).where(F.col("is_own") | F.col(time).isNotNull())
    both = both.withColumn("at", F.when(F.col("is_own"), F.col(time)).otherwise(F.col(time) + ms)).withColumn("period", F.col("at") - F.pmod("at", F.lit(ms)))
    both = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "period")  # a given number isn't coalesced by size; these rows are small until they are sorted
    by = Window.partitionBy(*key, "period")
    since, until = by.orderBy("at"), by.orderBy(F.desc("at"))  # frames with all rows of the same time
    join = {"count": lambda a, b: a + b, "sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    made = {name: join[kind](getattr(F, kind)(F.when(F.col("is_own"), F.col(x))).over(since), getattr(F, kind)(F.when(~F.col("is_own"), F.col(x))).over(until)) for name, (kind, x) in of.items()}
    return both.withColumns(made).where("is_own").drop("at", "is_own", "period")


def sma(x: str, frame: WindowSpec, n: int) -> Column:
    return full(F.avg(x).over(frame), frame, n)


def min_max(x: str, frame: WindowSpec) -> Column:
    """(x - min) / (max - min) of the frame, 0 where it is flat."""
    low, high = F.min(x).over(frame), F.max(x).over(frame)
    return F.when(high == low, 0.0).otherwise(ratio(F.col(x) - low, high - low))


def bollinger(bars: DataFrame, n: int, width: float, order=("bar_start_ms",)) -> DataFrame:
    """middle, upper and lower band with the population deviation, null until n bars."""
    frame = last_rows(n, order=order)
    middle, deviation = F.avg("close").over(frame), F.stddev_pop("close").over(frame)
    return bars.select("symbol", *order, full(middle, frame, n).alias("middle"), full(middle + width * deviation, frame, n).alias("upper"), full(middle - width * deviation, frame, n).alias("lower"))


def stochastic(bars: DataFrame, n: int, smooth: int, order=("bar_start_ms",)) -> DataFrame:
    """%K (50 where flat) and %D, its mean of `smooth` values; null until the frames are full."""
    frame = last_rows(n, order=order)
    low, high = F.min("low").over(frame), F.max("high").over(frame)
    k = full(F.when(high == low, 50.0).otherwise(100 * ratio(F.col("close") - low, high - low)), frame, n)
    out = bars.withColumn("k", k)
    over = last_rows(smooth, order=order)
    return out.select("symbol", *order, "k", F.when(F.count("k").over(over) >= smooth, F.avg("k").over(over)).alias("d"))


def true_range(order=("bar_start_ms",)) -> Column:
    before = F.lag("close").over(ordered(order=order))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def candle_shapes(bars: DataFrame, doji: float = 0.1) -> DataFrame:
    """typical price, body share, doji, engulfing (1, -1 or 0, strict) and inside bar of each bar."""
    by = ordered(order=("bar_start_ms",))
    span = F.col("high") - F.col("low")
    body = F.when(span == 0, 0.0).otherwise(ratio(F.abs(F.col("close") - F.col("open")), span))
    o, c, h, low = (F.lag(x).over(by) for x in ("open", "close", "high", "low"))
    engulfing = F.when((F.col("close") > F.col("open")) & (c < o) & (F.col("open") < c) & (F.col("close") > o), 1).when((F.col("close") < F.col("open")) & (c > o) & (F.col("open") > c) & (F.col("close") < o), -1).otherwise(0)
    return bars.select("symbol", "bar_start_ms", ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("typical"), body.alias("body"), (body <= doji).alias("is_doji"), engulfing.alias("engulfing"), F.coalesce((F.col("high") < h) & (F.col("low") > low), F.lit(False)).alias("is_inside"))


def anomalies(ticks: DataFrame, window: int = 20, most_z: float = 3.0, most_volume: float = 5.0) -> DataFrame:
    """One row per anomaly: kind is sequence_gap, price_spike or volume_spike, value the gap, z or ratio.

    The window is the symbol's `window` ticks before the current one and needs two; deviations are of the population.
    """
    by, frame = ordered(), prior_rows(window)
    deviation = F.stddev_pop("price").over(frame)
    enough = F.count(F.lit(1)).over(frame) >= 2
    z = F.when(enough & (deviation > 0), ratio(F.abs(F.col("price") - F.avg("price").over(frame)), deviation))
    volume = F.when(enough, ratio("quantity", F.avg("quantity").over(frame)))
    gap = F.col("trade_id") - F.lag("trade_id").over(by) - 1
    checked = ticks.select("symbol", "trade_id", gap.cast("double").alias("sequence_gap"), z.alias("price_spike"), volume.alias("volume_spike"))
    limits = {"sequence_gap": 0.0, "price_spike": most_z, "volume_spike": most_volume}
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.lit(v).alias("limit")) for k, v in limits.items())), lambda x: x["value"] > x["limit"])
    return checked.select("symbol", "trade_id", F.explode(found).alias("x")).select("symbol", "trade_id", "x.kind", "x.value")


def alpha(bars: DataFrame, n: int, order=("bar_start_ms",)) -> DataFrame:
    """Momentum over n bars (0 until there are as many), z-score of the close, realised volatility (annual, 252) and its regime."""
    by, frame = ordered(order=order), last_rows(n, order=order)
    momentum = F.coalesce(ratio("close", F.lag("close", n).over(by)) - 1, F.lit(0.0))
    out = bars.withColumn("ret", F.log(ratio("close", F.lag("close").over(by))))
    vol = F.stddev_pop("ret").over(frame) * F.sqrt(F.lit(252.0))
    out = out.select("symbol", *order, momentum.alias("momentum"), zscore("close", frame).alias("z"), vol.alias("vol"))
    return out.withColumn("regime", F.when(F.col("vol") < 0.1, "low").when(F.col("vol") < 0.2, "normal").when(F.col("vol") < 0.4, "high").when(F.col("vol").isNotNull(), "extreme"))


def microstructure(ticks: DataFrame, n: int) -> DataFrame:
    """Roll spread, bid-ask bounce, Kyle's lambda and Amihud illiquidity over the last n ticks; null until n differences.

    A return to or from a price of 0 is infinite, and so is the illiquidity of its frames. Where prices don't move the
    bounce is 1, where the flow doesn't change lambda is NaN. Ticks without a quantity have no illiquidity. Sums are in
    DuckDB's order (framed.py), since a lambda may lie at a half of the digit it is rounded to.
    """
    flow = F.col("side") * F.col("quantity")
    known = {"has_price": F.col("price").isNotNull(), "has_flow": flow.isNotNull(), "has_quantity": F.coalesce(F.col("quantity") != 0, F.lit(False))}
    given = ticks.select("symbol", "trade_id", "ts_ms", "price", "quantity", flow.alias("flow"), *(has.alias(name) for name, has in known.items()))
    columns = ("moved", "flows", "illiquids", "covariance", "variance", "flow_covariance", "flow_variance", "amihud")
    d = carried(given, ", ".join(f"{c} double" for c in columns), trade_statistics(n), keep=("trade_id",))
    nan = F.lit(float("nan"))
    covariance, variance = (F.coalesce(c, nan) for c in ("covariance", "variance"))
    slope = F.when(F.col("flows") > 0, F.when(F.col("flow_variance") == 0, nan).otherwise(F.coalesce(F.try_divide("flow_covariance", "flow_variance"), nan)))
    ready = F.col("moved") >= n
    return d.select(
        "symbol", "trade_id",
        F.when(ready, 2 * F.sqrt(F.greatest(-covariance, F.lit(0.0)))).alias("roll_spread"),
        F.when(ready, F.least(F.greatest(-quotient(covariance, variance), F.lit(0.0)), F.lit(1.0))).alias("bounce"),
        F.when(ready, slope).alias("kyle_lambda"),
        F.when(ready & (F.col("illiquids") > 0), F.coalesce("amihud", nan)).alias("amihud"),
    )


def order_flow(ticks: DataFrame, n: int) -> DataFrame:
    """Rolling buy and sell volume, their imbalance, net flow, and the running volume delta."""
    frame = last_rows(n)
    buy, sell = (F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(0.0)).over(frame) for s in (1, -1))
    out = ticks.select("symbol", "trade_id", buy.alias("buy"), sell.alias("sell"), F.sum(F.col("side") * F.col("quantity")).over(so_far()).alias("delta"))
    return out.withColumn("net", F.col("buy") - F.col("sell")).withColumn("imbalance", F.coalesce(ratio(F.col("net"), F.col("buy") + F.col("sell")), F.lit(0.0)))


def patterns(ticks: DataFrame, threshold: float) -> DataFrame:
    """Back-runs: an up move of at least `threshold` and then a smaller move down, one or two ticks later.

    A move from a price of 0 is infinite, one from 0 to 0 is NaN, which counts as above any threshold.
    """
    by = ordered()
    move = lambda k: quotient(F.lead("price", k).over(by), F.lead("price", k - 1).over(by)) - 1 if k else quotient(F.col("price"), F.lag("price").over(by)) - 1
    m = ticks.select("symbol", "trade_id", move(0).alias("up"), move(1).alias("one"), move(2).alias("two"))
    down = F.when((F.col("one") < 0) & (-F.col("one") < F.col("up")), 1).when((F.col("two") < 0) & (-F.col("two") < F.col("up")), 2)
    return m.withColumn("after", down).where((F.col("up") >= threshold) & F.col("after").isNotNull()).select("symbol", "trade_id", "up", "after")


def drawdown(bars: DataFrame, order=("bar_start_ms",)) -> DataFrame:
    """Share of the highest close so far that is lost, and the worst so far."""
    frame = so_far(order=order)
    out = bars.withColumn("drawdown", 1 - ratio("close", F.max("close").over(frame)))
    return out.select("symbol", *order, "drawdown", F.max("drawdown").over(frame).alias("max_drawdown"))


def lorentz(bars: DataFrame, beta: float, time: str = "bar_start_ms", space: str = "close") -> DataFrame:
    """The Lorentz boost of (t, x): t' = gamma (t - beta x), x' = gamma (x - beta t), gamma = 1 / sqrt(1 - beta^2)."""
    if not -1 < beta < 1:
        raise ValueError("beta must lie between -1 and 1")
    gamma = (1 - beta**2) ** -0.5
    return bars.withColumn("t_boosted", gamma * (F.col(time) - beta * F.col(space))).withColumn("x_boosted", gamma * (F.col(space) - beta * F.col(time)))


