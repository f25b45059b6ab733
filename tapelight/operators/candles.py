"""Candle patterns of one, two and three bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio

# What share of the range a doji's and a star's body may be, how many bodies long a wick must be and the
# other may be, and the strengths of the patterns that have only one.
DOJI, STAR = 0.1, 0.3
HAMMER_WICK, PIN_WICK, OTHER_WICK = 2.0, 2.5, 0.5
INSIDE_STRENGTH, STAR_STRENGTH = 0.7, 0.85


def patterns(bars: DataFrame, order: str = "bar_start_ms") -> DataFrame:
    """symbol, bar, pattern, direction (1, -1, 0), strength: one row for each pattern that ends with the bar.

    doji: a body under a tenth of the range. hammer: a wick below of two bodies or more and one above of half a body at
    most. pin_bar: the longer wick of two and a half bodies or more, the other of half a body at most. inside_bar: strictly
    inside the last bar. bullish_engulfing, bearish_engulfing: a body that holds the last, opposite one. morning_star,
    evening_star: after a bar of the other direction and a small one, a close beyond the middle of the first body.
    A bar without all four prices has no pattern, and neither have the ones that need it.
    """
    by = ordered(order=(order,))
    seen = bars.select("symbol", order, *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")))
    back = seen.select("symbol", order, *("open", "high", "low", "close"), *(F.lag(c, k).over(by).alias(f"{c}{k}") for k in (1, 2) for c in ("open", "high", "low", "close")))

    def c(name: str, k: int) -> Column:
        return F.col(name if k == 0 else f"{name}{k}")

    def body(k: int = 0) -> Column:
        return F.abs(c("close", k) - c("open", k))

    def extent(k: int = 0) -> Column:
        return c("high", k) - c("low", k)

    def rises(k: int = 0) -> Column:
        return c("close", k) > c("open", k)

    def falls(k: int = 0) -> Column:
        return c("close", k) < c("open", k)

    below, above = F.least("open", "close") - F.col("low"), F.col("high") - F.greatest("open", "close")
    long, short = F.greatest(below, above), F.least(below, above)
    there = (body() > 0) & (extent() > 0)
    small = (extent(1) > 0) & (body(1) < STAR * extent(1))
    middle = (c("open", 2) + c("close", 2)) / 2
    engulfing = F.least(ratio(body(), body(1)), F.lit(1.0))

    def found(name: str, when: Column, direction: Column | int, strength: Column | float) -> Column:
        direction, strength = (x if isinstance(x, Column) else F.lit(x) for x in (direction, strength))
        return F.when(when, F.struct(F.lit(name).alias("pattern"), direction.cast("int").alias("direction"), strength.cast("double").alias("strength")))

    every = F.array(
        found("doji", (extent() > 0) & (body() < DOJI * extent()), 0, 1 - ratio(body(), extent())),
        found("hammer", there & (below >= HAMMER_WICK * body()) & (above <= OTHER_WICK * body()), 1, F.least(ratio(below, body()) / HAMMER_WICK, F.lit(1.0))),
        found("pin_bar", there & (long >= PIN_WICK * body()) & (short <= OTHER_WICK * body()), F.when(below > above, 1).otherwise(-1), F.least(ratio(long, body()) / PIN_WICK, F.lit(1.0))),
        found("inside_bar", (c("high", 0) < c("high", 1)) & (c("low", 0) > c("low", 1)), 0, INSIDE_STRENGTH),
        found("bullish_engulfing", falls(1) & rises() & (c("open", 0) <= c("close", 1)) & (c("close", 0) >= c("open", 1)), 1, engulfing),
        found("bearish_engulfing", rises(1) & falls() & (c("open", 0) >= c("close", 1)) & (c("close", 0) <= c("open", 1)), -1, engulfing),
        found("morning_star", falls(2) & small & rises() & (c("close", 0) > middle), 1, STAR_STRENGTH),
        found("evening_star", rises(2) & small & falls() & (c("close", 0) < middle), -1, STAR_STRENGTH),
    )
    return back.select("symbol", order, F.explode(F.array_compact(every)).alias("p")).select("symbol", order, "p.*")


def counts(found: DataFrame, order: str = "bar_start_ms") -> DataFrame:
    """symbol, pattern, n, last: how often each pattern was found and when last."""
    return found.groupBy("symbol", "pattern").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last"))
