"""State carried over sorted streams of Arrow batches: folds that need all earlier rows of a key, but never hold them.

Rows are shuffled by key, sorted within their partition by key and order, and stream through a task batch by batch. A
fresh step is made where a key begins and called with one run of its rows after the other; what the step keeps between
calls is all that is held, so memory doesn't grow with a key's rows. A key's rows stay in one task, which an ordered
fold can't avoid; Spark spills their sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The columns of a run of rows, as arrays; nulls are NaN (None in columns of strings).
Run = dict[str, np.ndarray]
Step = Callable[[Run], dict]


def edges(keys: list[pa.Array]) -> np.ndarray:
    """Where a run of equal keys begins in a batch, and its end. Nulls are a key of their own."""
    n = len(keys[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for key in keys:
        codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:n] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def carried(rows: DataFrame, columns: str, begin: Callable[[], Step], keep: Sequence[str] = (), key: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts_ms", "trade_id")) -> DataFrame:
    """key, keep and `columns` (as in a schema string) of every row: what the key's step returns for its rows, in order.

    Rows of equal order come in no certain order, so `order` should tell them apart. NaN becomes null.
    """
    kept = [*key, *(c for c in keep if c not in key)]
    schema = StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL(columns)])
    kinds = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = edges([batch.column(k) for k in key])
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            parts: list[dict] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                now = tuple(batch.column(k)[a].as_py() for k in key)
                if step is None or now != last:
                    last, step = now, begin()
                parts.append(step({c: v[a:b] for c, v in values.items()}))
            arrays = [batch.column(c) for c in kept]
            for kind in kinds:
                one = [np.asarray(p[kind.name], object) if pa.types.is_nested(kind.type) else p[kind.name] for p in parts]
                arrays.append(pa.array(np.concatenate(one), kind.type, from_pandas=True))
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *kinds.names])

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


class Fold(Protocol):
    """A key's state: `add` takes one run of rows after the other, `rows` gives the result's columns once all are in."""

    def add(self, run: Run) -> None: ...

    def rows(self) -> dict: ...


def folded(rows: DataFrame, columns: str, begin: Callable[[], Fold], key: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts_ms", "trade_id")) -> DataFrame:
    """key and `columns`: what is left of each key once all its rows have gone through in order. No rows give none."""
    schema = StructType([*(rows.schema[c] for c in key), *StructType.fromDDL(columns)])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def done() -> pa.RecordBatch:
            out = state.rows()
            n = len(next(iter(out.values())))
            return pa.RecordBatch.from_arrays([pa.array([last[key.index(k.name)]] * n if k.name in key else out[k.name], k.type, from_pandas=True) for k in kinds], kinds.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = edges([batch.column(k) for k in key])
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                now = tuple(batch.column(k)[a].as_py() for k in key)
                if state is None or now != last:
                    if state is not None:
                        yield done()
                    last, state = now, begin()
                state.add({c: v[a:b] for c, v in values.items()})
        if state is not None:
            yield done()

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


class Average:
    """An average that begins with the mean of n values and then moves by `weight` of each difference; NaN before, and passed over."""

    def __init__(self, n: int, weight: float):
        self.n, self.weight, self.seen, self.value = n, weight, 0, 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        for i, v in enumerate(x.tolist()):
            if v != v:
                continue
            self.seen += 1
            if self.seen < self.n:
                self.value += v
                continue
            self.value = (self.value + v) / self.n if self.seen == self.n else self.value + self.weight * (v - self.value)
            out[i] = self.value
        return out


class Lag:
    """The values one row earlier, over all runs; NaN first."""

    def __init__(self) -> None:
        self.last = np.nan

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.concatenate([[self.last], x[:-1]])
        self.last = x[-1]
        return out


class LogReturns:
    """Logarithmic returns; NaN on the first row and beside a value that isn't above 0."""

    def __init__(self) -> None:
        self.lag = Lag()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        before = self.lag(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((x > 0) & (before > 0), np.log(x / before), np.nan)


class Position:
    """What is held, at what average cost, and what has been realised."""

    def __init__(self, held: float = 0.0, cost: float = 0.0, realised: float = 0.0):
        self.held, self.cost, self.realised = held, cost, realised

    def __call__(self, run: Run) -> dict:
        out = np.zeros((len(run["price"]), 3))
        for i, (signed, price) in enumerate(zip((run["side"] * run["quantity"]).tolist(), run["price"].tolist(), strict=True)):
            if signed == signed and price == price:
                self.trade(signed, price)
            out[i] = self.held, self.cost, self.realised
        return {"position": out[:, 0], "average_cost": out[:, 1], "realised": out[:, 2]}

    def trade(self, signed: float, price: float) -> None:
        if self.held * signed >= 0:
            total = self.held + signed
            self.cost = (self.held * self.cost + signed * price) / total if total else 0.0
            self.held = total
            return
        closed = min(abs(self.held), abs(signed)) * (1 if self.held > 0 else -1)
        self.realised += closed * (price - self.cost)
        self.held += signed
        if self.held * closed < 0:
            self.cost = price
        elif self.held == 0:
            self.cost = 0.0


def positions(trades: DataFrame, order: str = "trade_id") -> DataFrame:
    """Position, average cost and realised P&L after each trade (side 1 or -1, quantity, price): opens, adds, reduces, turns.

    A trade with a null side, quantity or price changes nothing and shows the state as it is.
    """
    return carried(trades, "position double, average_cost double, realised double", Position, keep=[order], order=[order])


# Alerts -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """An alert: its name, condition and severity, the symbol it is for (None: every one), and how long it is quiet after it fired."""

    name: str
    fires: Callable[[Recent], np.ndarray]
    severity: str = "info"
    symbol: str | None = None
    cooldown_ms: int = 0


class Recent:
    """A run of ticks behind at most `most` - 1 earlier ones; row i of the run is row `first` + i."""

    def __init__(self, price: np.ndarray, quantity: np.ndarray, ts_ms: np.ndarray, first: int, most: int):
        self.price, self.quantity, self.ts_ms, self.first, self.most = price, quantity, ts_ms, first, most
        self.rows = np.arange(first, len(price))

    def since(self, window_ms: int) -> np.ndarray:
        """For each row of the run, the earliest row in the window that is still remembered."""
        return np.maximum(np.searchsorted(self.ts_ms, self.ts_ms[self.first :] - window_ms), self.rows - self.most + 1)

    def last(self, n: int, back: int = 0) -> np.ndarray:
        """For each row of the run the n prices that end `back` rows before it (rows x n); NaN where there are fewer."""
        padded = np.concatenate([np.full(n + back, np.nan), self.price])
        return np.lib.stride_tricks.sliding_window_view(padded, n)[self.rows + 1]


def price_above(level: float) -> Callable[[Recent], np.ndarray]:
    return lambda r: r.price[r.first :] > level


def price_below(level: float) -> Callable[[Recent], np.ndarray]:
    return lambda r: r.price[r.first :] < level


def price_change(percent: float, window_ms: int, direction: int = 0) -> Callable[[Recent], np.ndarray]:
    """The price has moved by at least `percent` from the earliest one in the window: up (1), down (-1) or either way (0)."""

    def fires(r: Recent) -> np.ndarray:
        base = r.price[r.since(window_ms)]
        with np.errstate(divide="ignore", invalid="ignore"):
            change = np.where(base != 0, (r.price[r.first :] - base) / base * 100, np.nan)
        return (np.abs(change) >= percent) & (change * direction >= 0) & ((direction == 0) | (change != 0))

    return fires


def volume_spike(multiple: float, window_ms: int) -> Callable[[Recent], np.ndarray]:
    """The quantity is above `multiple` times the mean of the window, itself included."""

    def fires(r: Recent) -> np.ndarray:
        total, begin = np.concatenate([[0.0], np.cumsum(r.quantity)]), r.since(window_ms)
        mean = (total[r.rows + 1] - total[begin]) / (r.rows + 1 - begin)
        return (mean > 0) & (r.quantity[r.first :] > mean * multiple)

    return fires


def band_breakout(deviations: float, n: int) -> Callable[[Recent], np.ndarray]:
    """The price is outside the mean of the last n by so many sample deviations; n of at least 2."""

    def fires(r: Recent) -> np.ndarray:
        seen = r.last(n)
        return np.abs(seen[:, -1] - seen.mean(1)) > deviations * seen.std(1, ddof=1)

    return fires


def averages_cross(fast: int, slow: int) -> Callable[[Recent], np.ndarray]:
    """The mean of the last `fast` prices has crossed that of the last `slow`, either way."""

    def fires(r: Recent) -> np.ndarray:
        now, before = ([r.last(n, back).mean(1) for n in (fast, slow)] for back in (0, 1))
        return (before[0] <= before[1]) & (now[0] > now[1]) | (before[0] >= before[1]) & (now[0] < now[1])

    return fires


class Watch:
    """A symbol's last ticks and how long each rule is quiet."""

    def __init__(self, rules: Sequence[Rule], most: int, held: Sequence[np.ndarray] | None = None, quiet_until: dict[str, int] | None = None):
        self.rules, self.most = rules, most
        self.held = list(held) if held is not None else [np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
        self.quiet_until = dict(quiet_until or {})

    def __call__(self, run: Run) -> dict:
        """The names of the rules that fire at each tick."""
        first = len(self.held[0])
        seen = [np.concatenate([h, run[c]]) for h, c in zip(self.held, ("price", "quantity", "ts_ms"), strict=True)]
        recent = Recent(*seen, first, self.most)
        fired: list[list[str]] = [[] for _ in recent.rows]
        symbol = run["symbol"][0]
        for rule in self.rules:
            if rule.symbol is None or rule.symbol == symbol:
                until = self.quiet_until.get(rule.name)
                for i in np.flatnonzero(rule.fires(recent)).tolist():
                    now = int(run["ts_ms"][i])
                    if until is None or now >= until:
                        fired[i].append(rule.name)
                        until = now + rule.cooldown_ms
                if until is not None:
                    self.quiet_until[rule.name] = until
        self.held = [x[max(0, len(x) - self.most + 1) :] for x in seen]
        out = np.empty(len(fired), object)
        out[:] = fired
        return {"fired": out}


def whole_ticks(ticks: DataFrame) -> DataFrame:
    """What alerts look at, without ticks that have no price, quantity or time."""
    number = [F.col(c).cast("double").alias(c) for c in ("price", "quantity")]
    return ticks.select("symbol", "trade_id", "ts_ms", *number).dropna(subset=["price", "quantity", "ts_ms"])


def severity(rules: Sequence[Rule]) -> Column:
    return F.coalesce(*(F.when(F.col("rule") == r.name, F.lit(r.severity)) for r in rules), F.lit(None).cast("string"))


def alerts(ticks: DataFrame, rules: Sequence[Rule], most: int = 1000) -> DataFrame:
    """symbol, trade_id, ts_ms, rule, severity: one row for each rule that fires at a tick.

    Conditions see the tick and at most `most` - 1 before it. A rule is quiet until `cooldown_ms` after it fired for the
    symbol. Ticks without price, quantity or time are left out; no ticks, or no rules, give no rows.
    """
    fired = carried(whole_ticks(ticks), "fired array<string>", lambda: Watch(rules, most), keep=["trade_id", "ts_ms"])
    return fired.select("symbol", "trade_id", "ts_ms", F.explode("fired").alias("rule")).withColumn("severity", severity(rules))
