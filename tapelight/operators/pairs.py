"""Pairs of symbols traded on the spread of their prices: a rolling regression, and positions that open and close with its z-score."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio
from .carried import Run, Step, carried

SIGNALS = ("hold", "enter_long", "enter_short", "exit_long", "exit_short")


def spreads(pairs: DataFrame, n: int, key: Sequence[str] = ("a", "b"), order: str = "bar_start_ms") -> DataFrame:
    """key, order, beta, spread, zscore of pairs (x, y): x on y by least squares over the last n rows that have both.

    spread is the last row's residual, zscore that over the residuals' sample deviation. All are null before n rows are there
    and where y is flat; zscore is 0 where there is no residual at all.
    """
    whole = pairs.where("x IS NOT NULL AND y IS NOT NULL").select(*key, order, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    frame = Window.partitionBy(*key).orderBy(order).rowsBetween(1 - n, 0)
    ready = F.count(F.lit(1)).over(frame) >= n
    sums = whole.select(*key, order, "x", "y", *(F.when(ready, f(c).over(frame)).alias(name) for name, f, c in (("mx", F.avg, "x"), ("my", F.avg, "y"), ("xx", F.var_pop, "x"), ("yy", F.var_pop, "y"))), F.when(ready, F.covar_pop("x", "y").over(frame)).alias("xy"))
    beta = F.when(F.col("yy") * n > 1e-14, ratio("xy", "yy"))
    fitted = sums.withColumn("beta", beta).withColumn("spread", F.col("x") - F.col("mx") - F.col("beta") * (F.col("y") - F.col("my")))
    deviation = F.sqrt(F.greatest(F.col("xx") - F.col("beta") * F.col("xy"), F.lit(0.0)) * n / (n - 1))
    zscore = F.when(deviation > 1e-9, ratio("spread", deviation)).when(deviation.isNotNull() & F.col("beta").isNotNull(), 0.0)
    return fitted.select(*key, order, "beta", "spread", zscore.alias("zscore"))


def traded(spreads_of: DataFrame, entry: float = 2.0, leave: float = 0.5, key: Sequence[str] = ("a", "b"), order: str = "bar_start_ms") -> DataFrame:
    """spreads with position (1: long x and short y, -1: the other way, 0: none), signal and state after each row.

    A position opens where the z-score is beyond `entry`, against it, and closes once it is back within `leave` of 0 or on
    the other side. A row without a z-score changes nothing. state says what the z-score alone means: long, short,
    exit (within `leave`) or neutral; null without one.
    """

    def begin() -> Step:
        position = 0

        def step(run: Run) -> dict:
            nonlocal position
            held, signals = np.zeros(len(run["zscore"]), np.int64), []
            for i, z in enumerate(run["zscore"].tolist()):
                signal = "hold"
                if position == 0 and abs(z) > entry:
                    position, signal = (1, "enter_long") if z < 0 else (-1, "enter_short")
                elif position == 1 and z > -leave:
                    position, signal = 0, "exit_long"
                elif position == -1 and z < leave:
                    position, signal = 0, "exit_short"
                held[i] = position
                signals.append(signal)
            return {"position": held, "signal": signals}

        return step

    out = carried(spreads_of, "position long, signal string", begin, keep=[order, "beta", "spread", "zscore"], key=key, order=[order])
    z = F.col("zscore")
    state = F.when(z < -entry, "long").when(z > entry, "short").when(F.abs(z) < leave, "exit").when(z.isNotNull(), "neutral")
    return out.withColumn("state", state)
