"""Indicators whose state depends on all earlier rows: ordered folds over one symbol's bars, with little state (see `carried`)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .carried import Average, Lag, LogReturns, Run, Step, carried

BAR = "bar_start_ms"


def fold(bars: DataFrame, columns: str, begin: Callable[[], Step], key: str = "symbol", order: str = BAR) -> DataFrame:
    """Per key, in order: the key, the order column and `columns`. NaN becomes null."""
    return carried(bars, columns, begin, keep=[order], key=[key], order=[order])


def ema(n: int) -> Average:
    """Exponential average with k = 2 / (n + 1), from the mean of the first n values; NaN before."""
    return Average(n, 2 / (n + 1))


def wilder(n: int) -> Average:
    """Wilder's average, from the mean of the first n values; NaN before."""
    return Average(n, 1 / n)


def with_ema(bars: DataFrame, n: int) -> DataFrame:
    def begin() -> Step:
        average = ema(n)
        return lambda run: {"ema": average(run["close"])}

    return fold(bars, "ema double", begin)


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI: null for the first n bars, 100 without losses."""

    def begin() -> Step:
        lag, gains, losses = Lag(), wilder(n), wilder(n)

        def step(run: Run) -> dict:
            change = run["close"] - lag(run["close"])
            up, down = gains(np.maximum(change, 0)), losses(np.maximum(-change, 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
            return {"rsi": np.where(np.isnan(up), np.nan, value)}

        return step

    return fold(bars, "rsi double", begin)


def true_range(run: Run, before: np.ndarray) -> np.ndarray:
    """The largest of high - low and the distances of both from the last close; high - low on the first bar."""
    return np.fmax.reduce([run["high"] - run["low"], np.abs(run["high"] - before), np.abs(run["low"] - before)])


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's average true range; the first bar's range is high - low."""

    def begin() -> Step:
        lag, average = Lag(), wilder(n)
        return lambda run: {"atr": average(true_range(run, lag(run["close"])))}

    return fold(bars, "atr double", begin)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Line (fast less slow average), signal (average of the line) and histogram."""

    def begin() -> Step:
        quick, long, average = ema(fast), ema(slow), ema(signal)

        def step(run: Run) -> dict:
            line = quick(run["close"]) - long(run["close"])
            smoothed = average(line)
            return {"macd": line, "signal": smoothed, "histogram": line - smoothed}

        return step

    return fold(bars, "macd double, signal double, histogram double", begin)


def garch(bars: DataFrame, omega: float, alpha: float, beta: float) -> DataFrame:
    """GARCH(1,1) variance of each bar's log return, from the long-run variance omega / (1 - alpha - beta).

    A return beside a close that isn't above 0 is none: the variance stays as it is.
    """
    if alpha + beta >= 1:
        raise ValueError("alpha + beta must be under 1")

    def begin() -> Step:
        returns, lag, variance = LogReturns(), Lag(), omega / (1 - alpha - beta)

        def step(run: Run) -> dict:
            nonlocal variance
            out = []
            for r in lag(returns(run["close"])).tolist():
                if r == r:
                    variance = omega + alpha * r * r + beta * variance
                out.append(variance)
            return {"variance": np.array(out)}

        return step

    return fold(bars, "variance double", begin)


def ewma_volatility(bars: DataFrame, decay: float = 0.94) -> DataFrame:
    """Exponentially weighted variance of log returns, from the first squared return; null on bars without a return."""

    def begin() -> Step:
        returns, average = LogReturns(), Average(1, 1 - decay)
        return lambda run: {"variance": average(returns(run["close"]) ** 2)}

    return fold(bars, "variance double", begin)


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement index with Wilder sums that start at 0; null on the first bar."""

    def begin() -> Step:
        lags, sums, value = [Lag(), Lag(), Lag()], np.zeros(3), 0.0

        def step(run: Run) -> dict:
            nonlocal sums, value
            high, low, close = run["high"], run["low"], run["close"]
            before_high, before_low, before_close = (lag(x) for lag, x in zip(lags, (high, low, close), strict=True))
            ranges = true_range(run, before_close)
            up, down = high - before_high, before_low - low
            rises = np.where((up > down) & (up > 0), up, 0.0)
            falls = np.where((down > up) & (down > 0), down, 0.0)
            out = np.full(len(close), np.nan)
            for i in np.flatnonzero(~np.isnan(up)):
                sums = sums - sums / n + (rises[i], falls[i], ranges[i])
                total = sums[0] + sums[1]
                value = (value * (n - 1) + (100 * abs(sums[0] - sums[1]) / total if total > 0 and sums[2] > 0 else 0.0)) / n
                out[i] = value
            return {"adx": out}

        return step

    return fold(bars, "adx double", begin)
