"""Liquidity of quotes against plain loops."""

import math
import random

import numpy as np
import pytest

from tapelight.operators import liquidity

QUOTES = "symbol string, trade_id long, ts_ms long, bid double, ask double, bid_size double, ask_size double"


def quote_rows():
    rng = random.Random(1)
    rows = [("s", i, i * 1000, 100 + rng.gauss(0, 1), 100.5 + rng.gauss(0, 1), rng.choice([None, 0.0, 5.0, 9.0]), rng.choice([0.0, 3.0, None])) for i in range(60)]
    return [*rows, ("flat", 0, 0, 0.0, 0.0, 1.0, 1.0), ("flat", 1, 1, 2.0, 2.0, 1.0, 1.0), ("s", 100, 5, None, 1.0, 1.0, 1.0), (None, 101, 5, 1.0, None, 1.0, 1.0)]


def test_scores_against_a_plain_loop(spark):
    rows = quote_rows()
    found = {(r.symbol, r.trade_id): r for r in liquidity.scores(spark.createDataFrame(rows, QUOTES).repartition(3), 0.2, 5, 10.0).collect()}
    assert len(found) == 62
    spreads, average = [], None
    for _, i, _, bid, ask, bid_size, ask_size in rows[:60]:
        spreads.append(ask - bid)
        average = spreads[-1] if average is None else 0.2 * spreads[-1] + 0.8 * average
        mid, b, a = (bid + ask) / 2, bid_size or 0.0, ask_size or 0.0
        bps, uneven = (ask - bid) / mid * 1e4, (b - a) / (b + a) if b + a else 0.0
        r = found["s", i]
        assert (r.spread, r.spread_bps, r.average_spread, r.widest, r.narrowest, r.imbalance) == pytest.approx((ask - bid, bps, average, max(spreads[-5:]), min(spreads[-5:]), uneven))
        assert r.impact == pytest.approx(average / mid * math.sqrt(10 / mid) if i else 0.0) and r.score == pytest.approx((1 - min(bps / 50, 1) + 1 - abs(uneven)) / 2)
    assert (found["flat", 0].spread_bps, found["flat", 0].impact, found["flat", 1].impact, found["flat", 1].score) == (0, 0, 0, 1)


def test_statistics(spark):
    rows = quote_rows()
    found = {(r.symbol, r.period_start_ms): r for r in liquidity.statistics(spark.createDataFrame(rows, QUOTES), 50_000, 60.0).collect()}
    for start, own in ((0, rows[:50]), (50_000, rows[50:60])):
        bps = [(a - b) / ((a + b) / 2) * 1e4 for _, _, _, b, a, *_ in own]
        r = found["s", start]
        assert (r.n, r.alerts) == (len(bps), sum(x > 60 for x in bps))
        assert (r.mean, r.least, r.most, r.deviation, r.p95) == pytest.approx((np.mean(bps), min(bps), max(bps), np.std(bps, ddof=1), sorted(bps)[min(int(len(bps) * 0.95), len(bps) - 1)]))
    assert len(found) == 3 and (found["flat", 0].n, found["flat", 0].deviation) == (2, 0)
    none = spark.createDataFrame([], QUOTES)
    assert liquidity.statistics(none, 1000, 1.0).count() == 0 and liquidity.scores(none, 0.1, 5, 1.0).count() == 0
