"""Portfolios rebalanced at regular dates: covariances by aggregation, weights by optimisation, all dates in parallel.

Sums over pairs of symbols are taken once per period and then over a trailing window of periods, so a return is read once
whatever the window. A date's matrix, symbols by symbols, is one small group of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio


def covariances(returns: DataFrame, period_ms: int, periods: int, order: str = "bar_start_ms") -> DataFrame:
    """date, a, b, covariance, mean_a, n for all pairs a <= b with two returns or more at bars of both in the last `periods`.

    A date is the end of a period that has such bars; covariances are the sample's.
    """
    there = returns.where("ret IS NOT NULL")
    a = there.select(order, F.col("symbol").alias("a"), F.col("ret").alias("x"))
    b = there.select(order, F.col("symbol").alias("b"), F.col("ret").alias("y"))
    period = F.floor(F.col(order) / period_ms).cast("long")
    sums = a.join(b, order).where("a <= b").groupBy("a", "b", period.alias("period")).agg(
        F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.count(F.lit(1)).alias("n")
    )
    frame = Window.partitionBy("a", "b").orderBy("period").rangeBetween(1 - periods, 0)
    x, y, xy, n = (F.sum(c).over(frame) for c in ("x", "y", "xy", "n"))
    covariance = F.when(n > 1, ratio(xy - x * y / n, n - 1))
    out = sums.select(((F.col("period") + 1) * period_ms).alias("date"), "a", "b", covariance.alias("covariance"), (x / n).alias("mean_a"), n.alias("n"))
    return out.where("covariance IS NOT NULL")


def project_simplex(w: np.ndarray) -> np.ndarray:
    """The nearest weights that aren't negative and add up to 1."""
    falling = np.sort(w)[::-1]
    excess = (np.cumsum(falling) - 1) / np.arange(1, len(w) + 1)
    return np.maximum(w - excess.max(), 0)


def risk_contributions(w: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Each holding's part of the deviation; they add up to it."""
    pull = covariance @ w
    return w * pull / np.sqrt(max(w @ pull, 1e-20))


def mean_variance(means: np.ndarray, covariance: np.ndarray, aversion: float, rate: float, steps: int) -> np.ndarray:
    """Long-only weights by projected gradient ascent on mean - aversion * variance, from equal ones."""
    w = np.full(len(means), 1 / len(means))
    for _ in range(steps):
        w = project_simplex(w + rate * (means - 2 * aversion * covariance @ w))
    return w


def risk_parity(covariance: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Long-only weights of equal contributions: one holding after the other is set to the best for the rest as they are.

    They minimise the variance less the sum of the logarithms of the weights, which has one minimum, so the result
    doesn't depend on the way there. (Scaling weights by how far contributions are off swings from side to side and
    needn't settle.) Ends once no holding moves by the tolerance, relatively, in a round.
    """
    n = len(covariance)
    x = 1 / np.sqrt(n * np.diag(covariance))
    for _ in range(steps):
        before = x.copy()
        for i in range(n):
            own, rest = covariance[i, i], covariance[i] @ x - covariance[i, i] * x[i]
            x[i] = (np.sqrt(rest * rest + 4 * own / n) - rest) / (2 * own)
        if np.abs(x / before - 1).max() < tolerance:
            break
    return x / x.sum()


def weights(covariances: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """date, symbol, weight, contribution: what `choose(means, covariance)` holds from each date on, of the symbols with a variance.

    A pair without bars in common has covariance 0. No covariances give no rows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["a"] == group["b"]].sort_values("a")
        place = {s: i for i, s in enumerate(own["a"])}
        matrix = np.zeros((len(place), len(place)))
        for a, b, c in zip(group["a"], group["b"], group["covariance"], strict=True):
            if a in place and b in place:
                matrix[place[a], place[b]] = matrix[place[b], place[a]] = c
        w = choose(own["mean_a"].to_numpy(), matrix)
        return pd.DataFrame({"date": group["date"].iloc[0], "symbol": own["a"], "weight": w, "contribution": risk_contributions(w, matrix)})

    return covariances.groupBy("date").applyInPandas(run, f"date long, symbol {covariances.schema['a'].dataType.simpleString()}, weight double, contribution double")


def mean_variance_weights(returns: DataFrame, period_ms: int, periods: int, aversion: float = 2.0, rate: float = 0.05, steps: int = 100) -> DataFrame:
    return weights(covariances(returns, period_ms, periods), lambda means, c: mean_variance(means, c, aversion, rate, steps))


def risk_parity_weights(returns: DataFrame, period_ms: int, periods: int, steps: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    return weights(covariances(returns, period_ms, periods).where("a != b OR covariance > 0"), lambda _, c: risk_parity(c, steps, tolerance))
