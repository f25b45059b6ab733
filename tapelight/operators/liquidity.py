"""How liquid quotes are: spreads and their averages, depth, a score, the impact of a trade, and statistics by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER, last_rows, ratio
from .carried import Average, Run, Step, carried

#: A spread of so many basis points, or more, has no score (fixed).
WIDE = 50.0


def touch(quotes: DataFrame) -> DataFrame:
    """Quotes (bid, ask) with spread, mid and spread_bps, which is 0 where the mid isn't above 0."""
    out = quotes.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": (F.col("bid") + F.col("ask")) / 2})
    return out.withColumn("spread_bps", F.when(F.col("mid") > 1e-10, ratio("spread", "mid") * 10_000).otherwise(F.when(F.col("mid").isNotNull(), 0.0)))


def scores(quotes: DataFrame, alpha: float, history: int, size: float) -> DataFrame:
    """symbol, ts_ms, trade_id, spread, spread_bps, average_spread, widest, narrowest, imbalance, impact, score of each quote.

    average_spread moves by `alpha` of each difference from the first spread on; widest and narrowest are of the last
    `history` quotes. imbalance is the bid size less the ask size over both, 0 without either. impact is what a trade of
    `size` moves the price by, as a share: the average spread over the mid times the root of size over mid; 0 on a
    symbol's first quote. score is the mean of how far spread_bps is under WIDE and of how even the sizes are. Quotes
    without a side are left out, sizes that are null count as 0.
    """

    def begin() -> Step:
        average = Average(1, alpha)

        def step(run: Run) -> dict:
            first = average.seen == 0
            out = {"average_spread": average(run["spread"])}
            out["is_first"] = [first and i == 0 for i in range(len(run["spread"]))]
            return out

        return step

    whole = touch(quotes.where("bid IS NOT NULL AND ask IS NOT NULL"))
    sizes = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("bid_size", "ask_size")]
    total = sizes[0] + sizes[1]
    imbalance = F.when(total > 1e-10, ratio(sizes[0] - sizes[1], total)).otherwise(0.0)
    frame = last_rows(history)
    seen = whole.select(*KEY, *ORDER, "mid", F.col("spread").cast("double").alias("spread"), "spread_bps", imbalance.alias("imbalance"), F.max("spread").over(frame).alias("widest"), F.min("spread").over(frame).alias("narrowest"))
    out = carried(seen, "average_spread double, is_first boolean", begin, keep=[*ORDER, "mid", "spread", "spread_bps", "imbalance", "widest", "narrowest"])
    moved = (F.col("mid") >= 1e-10) & ~F.col("is_first")
    impact = F.when(moved, ratio("average_spread", "mid") * F.sqrt(F.greatest(ratio(F.lit(size), "mid"), F.lit(0.0)))).otherwise(0.0)
    score = (1 - F.least(F.col("spread_bps") / WIDE, F.lit(1.0)) + 1 - F.abs("imbalance")) / 2
    return out.select(*KEY, *ORDER, "spread", "spread_bps", "average_spread", "widest", "narrowest", "imbalance", impact.alias("impact"), score.alias("score"))


def statistics(quotes: DataFrame, period_ms: int, threshold_bps: float) -> DataFrame:
    """symbol, period_start_ms, n, mean, least, most, deviation, p95, alerts of spread_bps by period.

    deviation is the sample's, 0 with one quote. p95 is the value at the place 0.95 n, counted from 0 and rounded down. alerts are
    the quotes above the threshold. Quotes without a side are left out.
    """
    start = (F.floor(F.col("ts_ms") / period_ms) * period_ms).cast("long")
    by = Window.partitionBy("symbol", "period_start_ms")
    priced = touch(quotes.where("bid IS NOT NULL AND ask IS NOT NULL")).select("symbol", start.alias("period_start_ms"), "spread_bps")
    placed = priced.withColumns({"place": F.row_number().over(by.orderBy("spread_bps")), "rows": F.count(F.lit(1)).over(by)})
    wanted = F.least(F.floor(F.col("rows") * 0.95) + 1, F.col("rows"))
    return placed.groupBy("symbol", "period_start_ms").agg(
        F.count(F.lit(1)).alias("n"), F.avg("spread_bps").alias("mean"), F.min("spread_bps").alias("least"), F.max("spread_bps").alias("most"), F.coalesce(F.stddev_samp("spread_bps"), F.lit(0.0)).alias("deviation"),
        F.max(F.when(F.col("place") == wanted, F.col("spread_bps"))).alias("p95"), F.count(F.when(F.col("spread_bps") > threshold_bps, 1)).alias("alerts"),
    )


def decomposed(spread: Column, impact: Column, inventory_share: float) -> dict[str, Column]:
    """What a spread is made of: adverse selection (the impact), inventory cost (a share of it) and order processing (the rest)."""
    return {"adverse_selection": impact, "inventory_cost": spread * inventory_share, "order_processing": spread - impact - spread * inventory_share}
