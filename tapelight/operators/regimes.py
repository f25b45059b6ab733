"""Hidden states followed bar by bar: a Markov filter of market regimes and a Kalman filter of a pair's spread."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carried import Run, Step, carried


@dataclass(frozen=True)
class Regime:
    """A state's name, and the mean and deviation of a bar's return in it."""

    name: str
    mean: float
    deviation: float


# The five states, and the probabilities of going from each (rows) to each (columns).
REGIMES = (
    Regime("low_vol_bull", 0.0005, 0.008),
    Regime("high_vol_bull", 0.0010, 0.020),
    Regime("low_vol_bear", -0.0003, 0.007),
    Regime("high_vol_bear", -0.0010, 0.022),
    Regime("crisis", -0.0030, 0.040),
)
TRANSITIONS = (
    (0.92, 0.04, 0.02, 0.01, 0.01),
    (0.05, 0.88, 0.02, 0.04, 0.01),
    (0.03, 0.02, 0.90, 0.04, 0.01),
    (0.01, 0.03, 0.05, 0.86, 0.05),
    (0.01, 0.01, 0.02, 0.06, 0.90),
)
#: Decay by one bar of the weights of the volatility and of the trend, over at most REMEMBERED returns (fixed values).
VOLATILITY_DECAY, TREND_DECAY, REMEMBERED = 0.94, 0.9, 60


class Weighted:
    """Mean of at most n last values, weights falling by `decay` with each step back."""

    def __init__(self, decay: float, n: int):
        self.weights, self.held = decay ** np.arange(n), np.zeros(0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n, first = len(self.weights), len(self.held)
        seen = np.concatenate([self.held, x])
        sums = np.convolve(seen, self.weights)[first : len(seen)]
        totals = np.cumsum(self.weights)[np.minimum(np.arange(first, len(seen)), n - 1)]
        self.held = seen[max(0, len(seen) - n + 1) :]
        return sums / totals


def regimes(returns: DataFrame, states: Sequence[Regime] = REGIMES, transitions: Sequence[Sequence[float]] = TRANSITIONS, column: str = "ret", order: str = "bar_start_ms") -> DataFrame:
    """symbol, bar, regime, confidence, duration, volatility, trend, probabilities of every bar with a return.

    Bayes' rule: the last bar's probabilities go through the transitions and are weighted by the normal density of the
    return in each state. All states are as likely at first. The regime is the likeliest state (the last of equals) and
    duration the bars it has lasted; the first state counts one bar before any is seen. A return that no state allows
    makes all states as likely again. Bars without a return are left out.
    """
    mean, deviation = np.array([s.mean for s in states]), np.maximum(np.array([s.deviation for s in states]), 1e-10)
    moves, n = np.array(transitions), len(states)

    def begin() -> Step:
        p, now, lasted = np.full(n, 1 / n), 0, 1
        volatility, trend = Weighted(VOLATILITY_DECAY, REMEMBERED), Weighted(TREND_DECAY, REMEMBERED)

        def step(run: Run) -> dict:
            nonlocal p, now, lasted
            ret = run[column]
            likely = np.exp(-0.5 * ((ret[:, None] - mean) / deviation) ** 2) / deviation
            names, durations = [], []
            out = np.empty((len(ret), n))
            for i, own in enumerate(likely):
                after = p @ moves * own
                total = after.sum()
                p = after / total if total > 0 else np.full(n, 1 / n)
                best = n - 1 - int(p[::-1].argmax())
                now, lasted = best, lasted + 1 if best == now else 1
                out[i] = p
                names.append(states[best].name)
                durations.append(lasted)
            rows = np.empty(len(out), object)
            rows[:] = out.tolist()
            return {"regime": names, "confidence": out.max(1), "duration": durations, "volatility": np.sqrt(volatility(ret**2)), "trend": trend(ret), "probabilities": rows}

        return step

    columns = "regime string, confidence double, duration long, volatility double, trend double, probabilities array<double>"
    return carried(returns.where(F.col(column).isNotNull()), columns, begin, keep=[order], order=[order])


def spread_filter(pairs: DataFrame, beta: float = 1.0, threshold: float = 2.0, warm_up: int = 20, process_noise: float = 1e-5, noise: float = 1e-3, key: Sequence[str] = ("a", "b"), order: str = "bar_start_ms") -> DataFrame:
    """key, order, spread, mean, variance, deviation, zscore, expected_bps, confidence of each row of pairs (x, y: the two prices).

    spread is ln x - beta ln y. A Kalman filter follows its mean (a random walk of `process_noise`, seen through `noise`),
    an exponential average its squared surprises. zscore is how many of their deviations the spread is off the mean;
    it is null in the first `warm_up` - 1 rows. expected_bps and confidence, how far beyond the threshold it is, are
    null up to the threshold. Rows with a price that isn't above 0, or none, are left out.
    """
    if beta == 0 or threshold <= 0:
        raise ValueError("beta must not be 0, the threshold above 0")

    def begin() -> Step:
        mean, variance, deviation, seen = 0.0, 1.0, 1.0, 0
        alpha = 2 / (warm_up + 1)

        def step(run: Run) -> dict:
            nonlocal mean, variance, deviation, seen
            out = np.full((len(run["spread"]), 4), np.nan)
            for i, spread in enumerate(run["spread"].tolist()):
                before = variance + process_noise
                gain = before / (before + noise)
                surprise = spread - mean
                mean += gain * surprise
                variance = (1 - gain) * before
                deviation = (alpha * surprise * surprise + (1 - alpha) * deviation * deviation) ** 0.5
                seen += 1
                out[i, :3] = mean, variance, deviation
                if seen >= warm_up and deviation >= np.finfo(float).eps:
                    out[i, 3] = (spread - mean) / deviation
            return dict(zip(("mean", "variance", "deviation", "zscore"), out.T, strict=True))

        return step

    priced = pairs.where("x > 0 AND y > 0").select(*key, order, (F.log("x") - beta * F.log("y")).alias("spread"))
    out = carried(priced, "mean double, variance double, deviation double, zscore double", begin, keep=[order, "spread"], key=key, order=[order])
    beyond = F.when(F.abs("zscore") >= threshold, F.abs("zscore") - threshold)
    return out.withColumn("expected_bps", beyond * 50).withColumn("confidence", F.when(beyond.isNotNull(), F.least(beyond / threshold, F.lit(1.0))))
