"""Streaming twins of operators with carried state: the same state, kept by Spark between micro-batches.

Rows of a micro-batch are put in order within each symbol; one that comes in a later micro-batch is taken as later, whatever
its time. The state of a symbol is what its batch twin carries: a few numbers, or at most `most` - 1 ticks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.carried import Position, Rule, Watch, severity, whole_ticks


def ordered(chunks: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(chunks).sort_values(list(order), kind="stable").reset_index(drop=True)


def stateful(rows: DataFrame, columns: str, state: str, step: Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]], order: Sequence[str]) -> DataFrame:
    """`columns` of every symbol's rows: `step` takes them, in order, with the symbol's last state and returns the next."""

    def run(_: tuple, chunks: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        out, after = step(ordered(chunks, order), kept.get if kept.exists else None)
        kept.update(after)
        yield out

    return rows.groupBy("symbol").applyInPandasWithState(run, columns, state, "append", GroupStateTimeout.NoTimeout)


def live_positions(trades: DataFrame) -> DataFrame:
    """symbol, trade_id, position, average_cost, realised after each trade (see `carried.positions`)."""

    def step(group: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        position = Position(*(before or ()))
        out = pd.DataFrame({"symbol": group["symbol"], "trade_id": group["trade_id"], **position({c: group[c].to_numpy(float) for c in ("side", "quantity", "price")})})
        return out, (float(position.held), float(position.cost), float(position.realised))

    slim = trades.select("symbol", "trade_id", "side", "quantity", "price")
    return stateful(slim, "symbol string, trade_id long, position double, average_cost double, realised double", "held double, cost double, realised double", step, ["trade_id"])


def live_alerts(ticks: DataFrame, rules: Sequence[Rule], most: int = 1000) -> DataFrame:
    """symbol, trade_id, ts_ms, rule, severity for each rule that fires (see `carried.alerts`)."""

    def step(group: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        held = quiet = None
        if before is not None:
            held, quiet = [np.frombuffer(x, kind) for x, kind in zip(before[:3], (float, float, np.int64), strict=True)], json.loads(before[3])
        watch = Watch(rules, most, held, quiet)
        fired = watch({c: group[c].to_numpy() for c in ("symbol", "price", "quantity", "ts_ms")})["fired"]
        out = group[["symbol", "trade_id", "ts_ms"]].assign(rule=list(fired)).explode("rule").dropna(subset=["rule"])
        return out, (*(np.ascontiguousarray(x).tobytes() for x in watch.held), json.dumps(watch.quiet_until))

    state = "price binary, quantity binary, ts_ms binary, quiet string"
    found = stateful(whole_ticks(ticks), "symbol string, trade_id long, ts_ms long, rule string", state, step, ["ts_ms", "trade_id"])
    return found.withColumn("severity", severity(rules)).select("symbol", "trade_id", "ts_ms", F.col("rule"), "severity")
