"""Volatility models fitted to each symbol's returns, and what they forecast."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carried import Run, Step, carried, folded

# The grid that is searched.
ALPHAS = tuple(0.05 + 0.05 * i for i in range(5))
BETAS = tuple(0.70 + 0.05 * i for i in range(5))
OMEGAS = tuple(0.000001 + 0.000001 * i for i in range(5))
#: The mean of the absolute value of a standard normal variable (fixed).
MEAN_ABSOLUTE = 0.7978845608


class Likelihoods:
    """Variances and log-likelihoods of all models of one alpha at once: the grid is an array, its rows of data come once."""

    def __init__(self, betas: np.ndarray, omegas: np.ndarray):
        self.betas, self.omegas = (x.ravel() for x in np.meshgrid(betas, omegas, indexing="ij"))
        self.sums = np.zeros(len(self.betas))
        self.variance: np.ndarray | None = None

    def add(self, run: Run) -> None:
        if self.variance is None:
            self.variance, self.alpha = np.full(len(self.betas), run["initial"][0]), run["alpha"][0]
        for r in run["ret"].tolist():
            self.sums -= 0.5 * (np.log(self.variance) + r * r / self.variance)
            self.before, self.last = self.variance, r
            self.variance = np.maximum(self.omegas + self.alpha * r * r + self.betas * self.variance, 1e-10)

    def rows(self) -> dict:
        allowed = np.round(self.alpha + self.betas, 9) < 1.0
        out = {"beta": self.betas, "omega": self.omegas, "likelihood": self.sums, "last_variance": self.before, "last_return": np.full(len(self.betas), self.last)}
        return {name: values[allowed] for name, values in out.items()}


def garch_fit(returns: DataFrame, alphas: Sequence[float] = ALPHAS, betas: Sequence[float] = BETAS, omegas: Sequence[float] = OMEGAS, order: str = "bar_start_ms") -> DataFrame:
    """symbol, alpha, beta, omega, likelihood, last_variance, last_return of the likeliest GARCH(1,1) of each symbol.

    Every model of the grid with alpha + beta < 1 (to nine digits, so that sums of 1 are out) goes over the symbol's returns (ret), from the mean of their squares.
    Each alpha is a key of its own, so a symbol's grid is spread over tasks; the others are arrays. Of equal
    likelihoods the largest alpha, beta and omega win. Symbols without a return, or with none but 0, give no row.
    """
    there = returns.where("ret IS NOT NULL").select("symbol", order, "ret")
    initial = there.groupBy("symbol").agg(F.avg(F.col("ret") * F.col("ret")).alias("initial")).where("initial > 0")
    tried = there.join(initial, "symbol").withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    models = folded(tried, "beta double, omega double, likelihood double, last_variance double, last_return double", lambda: Likelihoods(np.array(betas), np.array(omegas)), key=["symbol", "alpha"], order=[order])
    best = models.groupBy("symbol").agg(F.max(F.struct("likelihood", "alpha", "beta", "omega", "last_variance", "last_return")).alias("m"))
    return best.select("symbol", *(f"m.{c}" for c in ("alpha", "beta", "omega", "likelihood", "last_variance", "last_return")))


def garch_forecast(fits: DataFrame, steps: int) -> DataFrame:
    """The fits with step (1 to `steps`) and variance: the next bar's by the model, then ever nearer to omega / (1 - alpha - beta).

    What is left of the distance to it at step k is that of the step before, times (alpha + beta) ** (k - 1).
    """
    first = F.col("omega") + F.col("alpha") * F.col("last_return") * F.col("last_return") + F.col("beta") * F.col("last_variance")
    stays = F.col("alpha") + F.col("beta")
    far = F.col("omega") / (1 - stays)
    k = F.col("step")
    return fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("variance", far + F.pow(stays, k * (k - 1) / 2) * (first - far))


def egarch(returns: DataFrame, omega: float, alpha: float, gamma: float, beta: float, order: str = "bar_start_ms") -> DataFrame:
    """symbol, order, ret, variance: EGARCH, where the logarithm of the variance moves with the size and the sign of the last shock.

    A bar's variance is what the bars before it say; the first is the mean of all squared returns, 1e-10 at least. Bars
    without a return are left out.
    """

    def begin() -> Step:
        log_variance: float | None = None

        def step(run: Run) -> dict:
            nonlocal log_variance
            if log_variance is None:
                log_variance = float(np.log(max(run["initial"][0], 1e-10)))
            out = []
            for r in run["ret"].tolist():
                out.append(max(float(np.exp(log_variance)), 1e-20))
                shock = r / max(float(np.exp(log_variance)), 1e-10) ** 0.5
                log_variance = omega + alpha * (abs(shock) - MEAN_ABSOLUTE) + gamma * shock + beta * log_variance
            return {"variance": np.array(out)}

        return step

    there = returns.where("ret IS NOT NULL").select("symbol", order, "ret")
    initial = there.groupBy("symbol").agg(F.avg(F.col("ret") * F.col("ret")).alias("initial"))
    return carried(there.join(initial, "symbol"), "variance double", begin, keep=[order, "ret"], order=[order])
