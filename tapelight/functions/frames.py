"""Window frames and small aggregates that the operators share. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY, ORDER = ("symbol",), ("ts_ms", "trade_id")


def ordered(key=KEY, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def last_rows(n: int, key=KEY, order=ORDER) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return ordered(key, order).rowsBetween(1 - n, 0)


def prior_rows(n: int, key=KEY, order=ORDER) -> WindowSpec:
    """The n rows before the current one."""
    return ordered(key, order).rowsBetween(-n, -1)


def so_far(key=KEY, order=ORDER) -> WindowSpec:
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, frame: WindowSpec, n: int) -> Column:
    """Null until the frame has n rows."""
    return F.when(F.count(F.lit(1)).over(frame) >= n, value)


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as in DuckDB and IEEE 754: an infinity where b is 0, NaN for 0 / 0."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def zscore(x: str | Column, frame: WindowSpec, sample: bool = False, flat: float = 1e-12) -> Column:
    """(x - mean) / deviation over the frame; 0 where the deviation is (nearly) 0."""
    x = F.col(x) if isinstance(x, str) else x
    deviation = (F.stddev_samp if sample else F.stddev_pop)(x).over(frame)
    return F.when(deviation < flat, 0.0).otherwise(ratio(x - F.avg(x).over(frame), deviation))
