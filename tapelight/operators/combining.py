"""Signals as columns: weights by how well they foretell, their combination, correlation and orthogonal parts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio

METHODS = ("equal", "absolute", "squared", "positive", "kelly")


def correlation(a: str, b: str) -> Column:
    """Of the rows where both are there; null where one of them is flat."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, ratio(F.covar_pop(a, b), spread))


def foretelling(rows: DataFrame, signals: Sequence[str], value: str, order: Sequence[str] = ("bar_start_ms",)) -> DataFrame:
    """symbol and one column for each signal: its correlation with the symbol's next `value`; null where one of them is flat."""
    later = rows.withColumn("later", F.lead(value).over(ordered(order=order)))
    return later.groupBy("symbol").agg(*(correlation(s, "later").alias(s) for s in signals))


def weights(skills: DataFrame, signals: Sequence[str], method: str) -> DataFrame:
    """Each signal's share by its skill (a correlation; null counts as 0); equal shares where no skill counts."""
    skill = {s: F.coalesce(F.col(s), F.lit(0.0)) for s in signals}
    raw = {
        "equal": lambda c: F.lit(1.0), "absolute": F.abs, "squared": lambda c: c * c,
        "positive": lambda c: F.greatest(c, F.lit(0.0)), "kelly": lambda c: F.greatest(c * (1 - c * c), F.lit(0.0)),
    }[method]
    total = sum((raw(c) for c in skill.values()), F.lit(0.0))
    return skills.select("symbol", *(F.when(total > 0, raw(c) / total).otherwise(1 / len(signals)).alias(s) for s, c in skill.items()))


def combined(rows: DataFrame, shares: DataFrame, signals: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """symbol, keep, combined: the signals of each row weighted by the symbol's shares; null where a signal is."""
    named = shares.select("symbol", *(F.col(s).alias(f"share_{s}") for s in signals))
    total = sum((F.col(s) * F.col(f"share_{s}") for s in signals), F.lit(0.0))
    return rows.join(named, "symbol").select("symbol", *keep, total.alias("combined"))


def diversification(rows: DataFrame, signals: Sequence[str]) -> DataFrame:
    """symbol, overlap: the mean absolute correlation of all pairs of signals, a pair with a flat one as 0; 0 with fewer than two."""
    pairs = [F.coalesce(F.abs(correlation(a, b)), F.lit(0.0)) for a, b in combinations(signals, 2)]
    return rows.groupBy("symbol").agg((sum(pairs, F.lit(0.0)) / max(1, len(pairs))).alias("overlap"))


def orthogonal(rows: DataFrame, signals: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """symbol, keep and the signals, each less its projections on the ones before it (Gram-Schmidt, per symbol).

    All inner products come from one aggregation of products, with partial sums; the coefficients follow from them alone
    and go back to the rows as one slim row a symbol. A signal that is 0 throughout takes nothing from the others. Rows with a
    null signal count in no product and give null.
    """
    whole = rows.dropna(subset=list(signals))
    names = list(signals)
    k = len(names)
    gram = whole.groupBy("symbol").agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)))
    # d{j}_{i}: the product of what is left of signal j with signal i; c{j}_{i}: how much of it i gives up.
    for j in range(k):
        products = {f"d{j}_{i}": sum((-F.col(f"c{m}_{j}") * F.col(f"d{m}_{i}") for m in range(j)), F.col(f"g{j}_{i}")) for i in range(j, k)}
        gram = gram.withColumns(products)
        gram = gram.withColumns({f"c{j}_{i}": F.when(F.col(f"d{j}_{j}") > 1e-12 * F.col(f"g{j}_{j}"), ratio(f"d{j}_{i}", f"d{j}_{j}")).otherwise(0.0) for i in range(j + 1, k)})
    slim = gram.select("symbol", *(f"c{j}_{i}" for j in range(k) for i in range(j + 1, k)))
    out, left = rows.join(slim, "symbol", "left"), {}
    for i, name in enumerate(names):
        out = out.withColumn(f"left{i}", sum((-F.col(f"c{j}_{i}") * F.col(f"left{j}") for j in range(i)), F.col(name).cast("double")))
        left[name] = f"left{i}"
    return out.select("symbol", *keep, *(F.col(c).alias(name) for name, c in left.items()))


def autocovariance(value: str, lag: int, by) -> dict[str, Column]:
    """The columns whose sums `kernel` needs of a lag."""
    back = F.lag(value, lag).over(by)
    return {f"p{lag}": F.col(value) * back, f"l{lag}": F.when(back.isNotNull(), F.col(value)), f"b{lag}": F.when(F.col(value).isNotNull(), back)}


def parzen(x: float) -> float:
    """The kernel's weight on [0, 1]."""
    return 1 - 6 * x * x + 6 * x**3 if x <= 0.5 else 2 * (1 - x) ** 3


def noise(ticks: DataFrame, period_ms: int, lags: int = 5) -> DataFrame:
    """symbol, period_start_ms, roll_spread, kernel_variance, noise_to_signal, n of each period's prices.

    Changes of the price within a period; autocovariances about their mean at all lags come from one aggregation. The
    kernel's variance is that at lag 0 and twice those at 1 to `lags`, Parzen weighted, 0 at least; null with fewer than
    2 * lags + 2 prices. roll_spread is twice the root of the negative covariance at lag 1, 0 where that is positive; null with
    fewer than 3 prices. noise_to_signal is roll_spread squared over four times the variance, 0 where that is 0.
    """
    start = (F.floor(F.col("ts_ms") / period_ms) * period_ms).cast("long")
    by = ordered(key=("symbol", "period_start_ms"))
    changed = ticks.where("price IS NOT NULL").withColumn("period_start_ms", start).withColumn("d", F.col("price") - F.lag("price").over(by))
    shifted = changed.withColumns({name: c for lag in range(1, lags + 1) for name, c in autocovariance("d", lag, by).items()})
    sums = [F.sum(f"{x}{lag}").alias(f"{x}{lag}") for lag in range(1, lags + 1) for x in "plb"]
    out = shifted.groupBy("symbol", "period_start_ms").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.sum(F.col("d") * F.col("d")).alias("dd"), *sums)
    m, n = F.col("m"), F.col("n") - 1  # of changes
    at = [ratio("dd", n) - m * m] + [ratio(F.col(f"p{h}") - m * (F.col(f"l{h}") + F.col(f"b{h}")) + (n - h) * m * m, n - h) for h in range(1, lags + 1)]
    variance = sum((2 * parzen(h / (lags + 1)) * at[h] for h in range(1, lags + 1)), at[0])
    out = out.select("symbol", "period_start_ms", "n", F.when(F.col("n") >= 3, 2 * F.sqrt(F.greatest(-at[1], F.lit(0.0)))).alias("roll_spread"), F.when(F.col("n") >= 2 * lags + 2, F.greatest(variance, F.lit(0.0))).alias("kernel_variance"))
    return out.withColumn("noise_to_signal", F.when(F.col("kernel_variance") > 1e-16, F.col("roll_spread") ** 2 / (4 * F.col("kernel_variance"))).when(F.col("kernel_variance").isNotNull(), 0.0))
