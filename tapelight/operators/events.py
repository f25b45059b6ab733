"""Market events at ticks: breakouts, volume spikes, reversals and gaps. Window frames of a few rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER, ordered, prior_rows, ratio


def detect(ticks: DataFrame, lookback: int = 20, spike: float = 2.0, trend: int = 3, gap: float = 0.005, session_ms: int = 3_600_000) -> DataFrame:
    """symbol, trade_id, ts_ms, event, direction, value, level: one row for each event of a tick.

    breakout: the price leaves the range of the lookback - 1 prices before it (all must be there); level is the bound
    it left. volume_spike: the quantity is at least `spike` times the mean (level) of up to lookback - 1 before it; value is the
    ratio. reversal: the price moves against `trend` moves of one direction, which is `direction`; equal prices aren't moves.
    gap: more than session_ms after the last tick the price has changed by a share (value) of at least `gap` from it (level).
    Ticks without a price are left out; one without a quantity has no spike, and counts in no mean.
    """
    by, before = ordered(), prior_rows(lookback - 1)
    last = F.lag("price").over(by)
    there = ticks.where("price IS NOT NULL")
    seen = there.select(
        *KEY, *ORDER, "price", "quantity", last.alias("last"), F.lag("ts_ms").over(by).alias("last_ms"), F.sign(F.col("price") - last).cast("int").alias("move"),
        F.count("price").over(before).alias("n"), F.max("price").over(before).alias("top"), F.min("price").over(before).alias("bottom"), F.avg("quantity").over(before).alias("mean"),
    )
    up, down = (F.col("n") == lookback - 1) & (F.col("price") > F.col("top")), (F.col("n") == lookback - 1) & (F.col("price") < F.col("bottom"))
    times, change = ratio("quantity", "mean"), ratio(F.col("price") - F.col("last"), "last")
    late = F.col("ts_ms") > F.col("last_ms") + session_ms

    def event(name: str, when, direction, value, level):
        return F.when(when, F.struct(F.lit(name).alias("event"), direction.cast("int").alias("direction"), value.cast("double").alias("value"), level.cast("double").alias("level")))

    found = seen.select(*KEY, *ORDER, F.explode(F.array_compact(F.array(
        event("breakout", up | down, F.when(up, 1).otherwise(-1), F.col("price"), F.when(up, F.col("top")).otherwise(F.col("bottom"))),
        event("volume_spike", (F.col("mean") > 0) & (times >= spike), F.lit(None), times, F.col("mean")),
        event("gap", late & (F.abs(change) >= gap), F.sign(change), change, F.col("last")),
    ))).alias("e"))
    moves = seen.where("move != 0")
    recent = Window.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(-trend, -1)
    same = (F.count("move").over(recent) == trend) & (F.abs(F.sum("move").over(recent)) == trend)
    trends = moves.select(*KEY, *ORDER, "price", "move", F.when(same, F.sum("move").over(recent) / trend).cast("int").alias("prior"))
    turned = trends.where("prior = -move").select(*KEY, *ORDER, F.lit("reversal").alias("event"), F.col("prior").alias("direction"), F.col("price").cast("double").alias("value"), F.lit(None).cast("double").alias("level"))
    return found.select(*KEY, *ORDER, "e.*").unionByName(turned)
