"""Networks of correlations: edges above a threshold, who is central, when the whole moves, and how shocks spread."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio
from .carried import Average, Run, Step, carried

BAR = "bar_start_ms"


def correlations(bars: DataFrame, period_ms: int, periods: int | None = None) -> DataFrame:
    """date, a, b, correlation, n for a < b: of the logarithms of both closes in the last `periods` (None: all so far).

    A date is the end of a period with a bar of both. The correlation is null where one of the two is flat. Sums are
    taken once per period, the windows are over those. Closes that aren't above 0 are left out.
    """
    priced = bars.where("close > 0").select(BAR, "symbol", F.log("close").alias("x"))
    a, b = priced.select(BAR, F.col("symbol").alias("a"), "x"), priced.select(BAR, F.col("symbol").alias("b"), F.col("x").alias("y"))
    products = {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y"), "n": F.lit(1)}
    period = F.floor(F.col(BAR) / period_ms).cast("long")
    sums = a.join(b, BAR).where("a < b").groupBy("a", "b", period.alias("period")).agg(*(F.sum(c).alias(name) for name, c in products.items()))
    frame = Window.partitionBy("a", "b").orderBy("period").rangeBetween(Window.unboundedPreceding if periods is None else 1 - periods, 0)
    x, y, xx, yy, xy, n = (F.sum(c).over(frame) for c in products)
    own = [F.when(v > 1e-12, v) for v in (xx / n - x / n * (x / n), yy / n - y / n * (y / n))]
    correlation = ratio(xy / n - x / n * (y / n), F.sqrt(own[0]) * F.sqrt(own[1]))
    return sums.select(((F.col("period") + 1) * period_ms).alias("date"), "a", "b", correlation.alias("correlation"), n.cast("long").alias("n"))


def edges(correlated: DataFrame, least: float) -> DataFrame:
    """The pairs whose correlation is `least` or more, either way."""
    return correlated.where(F.abs("correlation") >= least)


def centrality(correlated: DataFrame, least: float) -> DataFrame:
    """date, symbol, degree, strength, is_leader of each symbol that has a pair on the date.

    degree is the share of the others it has an edge to, strength the sum of its edges' absolute correlations. The
    strongest leads; of equals the first by name.
    """
    kept = F.when(F.abs("correlation") >= least, F.abs("correlation"))
    ends = correlated.select("date", F.explode(F.array("a", "b")).alias("symbol"), kept.alias("weight"))
    own = ends.groupBy("date", "symbol").agg(F.count("weight").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("strength"))
    by = Window.partitionBy("date")
    out = own.withColumn("degree", F.col("edges") / F.greatest(F.count(F.lit(1)).over(by) - 1, F.lit(1)))
    first = F.row_number().over(by.orderBy(F.desc("strength"), "symbol")) == 1
    return out.select("date", "symbol", "degree", "strength", first.alias("is_leader"))


def shifts(correlated: DataFrame, least: float, threshold: float, span: int) -> DataFrame:
    """date, mean_correlation, average, deviation, is_shift: how far the edges' mean absolute correlation is off its exponential average.

    The average takes the date's mean in before it is compared. Dates without an edge are left out. One row a date, all in
    one task: dates are few.
    """
    if threshold <= 0 or span < 2:
        raise ValueError("the threshold must be above 0, the span 2 at least")
    means = edges(correlated, least).groupBy("date").agg(F.avg(F.abs("correlation")).alias("mean_correlation")).withColumn("market", F.lit("all"))

    def begin() -> Step:
        average = Average(1, 2 / (span + 1))

        def step(run: Run) -> dict:
            return {"average": average(run["mean_correlation"])}

        return step

    out = carried(means, "average double", begin, keep=["date", "mean_correlation"], key=["market"], order=["date"])
    deviation = F.col("mean_correlation") - F.col("average")
    return out.select("date", "mean_correlation", "average", deviation.alias("deviation"), (F.abs(deviation) > threshold).alias("is_shift"))


def contagion(returns: DataFrame, correlated: DataFrame, shock: float, least: float, period_ms: int) -> DataFrame:
    """bar_start_ms, trigger, affected, mean_shock, score: groups of correlated symbols that are shocked in the same bar.

    A symbol is shocked if its return (ret) is `shock` or more, either way. In order of name, each that is in no group
    yet takes in all others that have an edge to it, by the correlations as of the last date up to the bar. A group of two
    or more is an event: its trigger has the largest return (of equals the first), the score is the mean size of its
    returns times the mean of the edges inside it. Shocked symbols of one bar are a group of rows of their own.
    """
    if shock <= 0 or least <= 0:
        raise ValueError("the shock and the least correlation must be above 0")
    shocked = returns.where(F.abs("ret") >= shock).select(BAR, "symbol", "ret")
    several = shocked.join(shocked.groupBy(BAR).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), BAR)
    one, two = several.select(BAR, F.col("symbol").alias("a")), several.select(BAR, F.col("symbol").alias("b"))
    # Where a pair has no bar in a period, its correlation stays as it was: each lasts until the pair's next.
    lasting = correlated.withColumn("until", F.lead("date").over(Window.partitionBy("a", "b").orderBy("date")))
    days = F.floor(F.col(BAR) / period_ms).cast("long") * period_ms
    pairs = one.join(two, BAR).where("a < b").withColumn("day", days)
    linked = pairs.join(edges(lasting, least), ["a", "b"]).where((F.col("date") <= F.col("day")) & (F.col("until").isNull() | (F.col("until") > F.col("day"))))
    rows = several.withColumn("other", F.lit(None).cast(returns.schema["symbol"].dataType)).withColumn("size", F.abs("ret")).select(BAR, "symbol", "other", "size")
    rows = rows.unionByName(linked.select(BAR, F.col("a").alias("symbol"), F.col("b").alias("other"), F.abs("correlation").alias("size")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["other"].isna()].set_index("symbol")["size"].sort_index()
        strength = {(a, b): c for a, b, c in group[group["other"].notna()][["symbol", "other", "size"]].itertuples(index=False)}
        free, out = list(own.index), []
        while free:
            first = free[0]
            members = [first, *(s for s in free[1:] if (first, s) in strength)]
            free = [s for s in free if s not in members]
            if len(members) > 1:
                inside = [c for (a, b), c in strength.items() if a in members and b in members]
                shocks = own[members]
                out.append((group[BAR].iloc[0], shocks.idxmax(), members, shocks.mean(), shocks.mean() * sum(inside) / len(inside)))
        return pd.DataFrame(out, columns=[BAR, "trigger", "affected", "mean_shock", "score"])

    kind = returns.schema["symbol"].dataType.simpleString()
    return rows.groupBy(BAR).applyInPandas(run, f"{BAR} long, trigger {kind}, affected array<{kind}>, mean_shock double, score double")
