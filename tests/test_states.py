"""Operators with carried state, fitted models, optimisers and events, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelight.operators import carried, events, folds, pairs, portfolio, regimes, volatility

HOUR = 3_600_000


@pytest.fixture(autouse=True)
def small_batches(spark):
    """Batches of seven rows, so that every state crosses batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def tick_rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(s, i, i * 60_000 + rng.randint(0, 50_000), rng.choice([rng.uniform(1, 200), 50.0]), rng.uniform(0.5, 20), rng.choice([1, -1])) for i in range(n) for s in ("a", "b", None)[: 1 + (i % 3 == 0) + (i % 50 == 0)]]


TICKS = "symbol string, trade_id long, ts_ms long, price double, quantity double, side int"


def by_symbol(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_state_crosses_batches_and_not_keys(spark):
    rows = tick_rows()

    def begin():
        seen = 0

        def step(run):
            nonlocal seen
            out = np.arange(seen, seen + len(run["price"]))
            seen = out[-1] + 1
            assert len(out) <= 7  # no more than a batch at once
            return {"place": out}

        return step

    found = carried.carried(spark.createDataFrame(rows, TICKS).repartition(5), "place long", begin, keep=["trade_id"]).collect()
    want = {(s, r[1]): i for s, own in by_symbol(rows).items() for i, r in enumerate(own)}
    assert {(r.symbol, r.trade_id): r.place for r in found} == want and len(found) == len(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], TICKS)
    bars = spark.createDataFrame([], "symbol string, bar_start_ms long, close double, high double, low double, ret double")
    assert carried.positions(none).count() == 0
    assert carried.alerts(none, [carried.Rule("x", carried.price_above(1))]).count() == 0
    assert carried.alerts(spark.createDataFrame(tick_rows(), TICKS), []).count() == 0
    assert events.detect(none).count() == 0
    assert regimes.regimes(bars).count() == 0
    assert volatility.garch_fit(bars).count() == 0 and volatility.egarch(bars, 0, 0, 0, 0).count() == 0
    assert portfolio.mean_variance_weights(bars, HOUR, 3).count() == 0 and portfolio.risk_parity_weights(bars, HOUR, 3).count() == 0
    assert all(f(bars).count() == 0 for f in (folds.rsi, folds.atr, folds.macd, folds.adx, folds.ewma_volatility))


def test_positions_pass_over_nulls(spark):
    trades = [("a", 1, 0, 100.0, 10.0, 1), ("a", 2, 0, None, 5.0, 1), ("a", 3, 0, 110.0, None, 1), ("a", 4, 0, 110.0, 10.0, 1), ("a", 5, 0, 120.0, 5.0, -1), ("a", 6, 0, 90.0, 20.0, -1), ("a", 7, 0, 80.0, 5.0, None)]
    found = [(r.position, r.average_cost, r.realised) for r in carried.positions(spark.createDataFrame(trades, TICKS)).orderBy("trade_id").collect()]
    assert found == [(10, 100, 0), (10, 100, 0), (10, 100, 0), (20, 105, 0), (15, 105, 75), (-5, 90, -150), (-5, 90, -150)]


def test_returns_beside_zero_are_none(spark):
    closes = [10.0, 11.0, 0.0, 12.0, 13.0, None, 12.0, 11.0]
    bars = spark.createDataFrame([("a", i, c) for i, c in enumerate(closes)], "symbol string, bar_start_ms long, close double")
    variance = [r.variance for r in folds.garch(bars, 1e-4, 0.1, 0.8).orderBy("bar_start_ms").collect()]
    first, second = math.log(1.1), math.log(13 / 12)
    assert variance[:3] == pytest.approx([1e-3, 1e-3, 1e-4 + 0.1 * first**2 + 0.8e-3]) and variance[3] == variance[4] == variance[2]
    assert variance[5] == pytest.approx(1e-4 + 0.1 * second**2 + 0.8 * variance[2]) and variance[7] == variance[5]
    ewma = [r.variance for r in folds.ewma_volatility(bars).orderBy("bar_start_ms").collect()]
    assert [v is None for v in ewma] == [True, False, True, True, False, True, True, False] and all(map(math.isfinite, filter(None, ewma)))


RULES = [
    carried.Rule("above", carried.price_above(150), "critical", cooldown_ms=600_000),
    carried.Rule("below", carried.price_below(30), symbol="b"),
    carried.Rule("up", carried.price_change(50, 300_000, 1), "warning", cooldown_ms=300_000),
    carried.Rule("any", carried.price_change(80, 300_000)),
    carried.Rule("spike", carried.volume_spike(1.8, 600_000)),
    carried.Rule("band", carried.band_breakout(1.5, 10)),
    carried.Rule("cross", carried.averages_cross(3, 8), cooldown_ms=120_000),
]


def plain_alerts(rows, most):
    out = set()
    for symbol, own in by_symbol(r for r in rows if None not in r[2:5]).items():
        quiet = {}
        for i, (_, trade, ts, price, quantity, _) in enumerate(own):
            seen = own[max(0, i - most + 1) : i + 1]
            prices = [r[3] for r in seen]

            def window(ms, seen=seen, ts=ts):
                return [r for r in seen if r[2] >= ts - ms]

            change = (price - window(300_000)[0][3]) / window(300_000)[0][3] * 100
            busy = window(600_000)
            last = np.array(prices[-10:])
            now, old = (np.mean(prices[-3:]), np.mean(prices[-8:])), (np.mean(prices[-4:-1]), np.mean(prices[-9:-1])) if len(prices) > 8 else None
            fires = {
                "above": price > 150, "below": price < 30 and symbol == "b", "up": change >= 50, "any": abs(change) >= 80, "spike": quantity > 1.8 * sum(r[4] for r in busy) / len(busy),
                "band": len(last) == 10 and abs(price - last.mean()) > 1.5 * last.std(ddof=1), "cross": old is not None and (old[0] <= old[1] and now[0] > now[1] or old[0] >= old[1] and now[0] < now[1]),
            }
            for rule in RULES:
                if fires[rule.name] and ts >= quiet.get(rule.name, 0):
                    out.add((symbol, trade, rule.name, rule.severity))
                    quiet[rule.name] = ts + rule.cooldown_ms
    return out


@pytest.mark.parametrize("most", [1000, 12])
def test_alerts_against_plain_loops(spark, most):
    rows = [*tick_rows(), ("a", 10_001, 5_000_000, None, 1.0, 1), ("a", 10_002, 5_000_001, 1.0, None, 1), ("b", 10_003, None, 1.0, 1.0, 1)]
    found = carried.alerts(spark.createDataFrame(rows, TICKS).repartition(4), RULES, most).collect()
    got = {(r.symbol, r.trade_id, r.rule, r.severity) for r in found}
    assert got == plain_alerts(rows, most) and len(got) == len(found) and {r.rule for r in found} == {r.name for r in RULES}


def plain_events(rows, lookback, spike, trend, gap):
    out = set()
    for symbol, own in by_symbol(r for r in rows if r[3] is not None).items():
        moves = []
        for i, (_, trade, ts, price, quantity, _) in enumerate(own):
            before = own[max(0, i - lookback + 1) : i]
            if len(before) == lookback - 1:
                if price > max(r[3] for r in before):
                    out.add((symbol, trade, "breakout", 1))
                elif price < min(r[3] for r in before):
                    out.add((symbol, trade, "breakout", -1))
            volumes = [r[4] for r in before if r[4] is not None]
            if volumes and quantity is not None and quantity / (sum(volumes) / len(volumes)) >= spike:
                out.add((symbol, trade, "volume_spike", None))
            if i:
                last = own[i - 1]
                change = (price - last[3]) / last[3]
                if ts > last[2] + 3_600_000 and abs(change) >= gap:
                    out.add((symbol, trade, "gap", int(np.sign(change))))
                if price != last[3]:
                    move = 1 if price > last[3] else -1
                    if len(moves) >= trend and set(moves[-trend:]) == {-move}:
                        out.add((symbol, trade, "reversal", -move))
                    moves.append(move)
    return out


def test_events_against_plain_loops(spark):
    rng = random.Random(2)
    rows = [(s, i, i * 700_000 + i // 9 * 4_000_000, float(rng.randint(90, 110)), rng.choice([None, rng.uniform(1, 30)]), 1) for i in range(300) for s in ("a", None)] + [("a", 999, 10, None, 1.0, 1)]
    found = events.detect(spark.createDataFrame(rows, TICKS), 5, 1.5, 2, 0.01).collect()
    got = [(r.symbol, r.trade_id, r.event, r.direction) for r in found]
    assert set(got) == plain_events(rows, 5, 1.5, 2, 0.01) and len(set(got)) == len(got) and {r.event for r in found} == {"breakout", "volume_spike", "gap", "reversal"}


def return_rows(n=150, seed=3):
    rng = random.Random(seed)
    return [(s, i * HOUR, rng.gauss(0, 0.01 if i % 40 < 25 else 0.05)) for s in ("a", "b", "c") for i in range(n)]


RETURNS = "symbol string, bar_start_ms long, ret double"


def test_regimes_against_plain_loops(spark):
    rows = [*return_rows(), ("a", -HOUR, None), ("d", 0, 1e9)]
    found = {(r.symbol, r.bar_start_ms): r for r in regimes.regimes(spark.createDataFrame(rows, RETURNS)).collect()}
    assert len(found) == len(rows) - 1
    for symbol in "abc":
        p, now, lasted, seen = [0.2] * 5, 0, 1, []
        for s, ts, ret in rows[:-2]:
            if s != symbol:
                continue
            after = [sum(p[i] * regimes.TRANSITIONS[i][j] for i in range(5)) * math.exp(-0.5 * ((ret - x.mean) / x.deviation) ** 2) / x.deviation for j, x in enumerate(regimes.REGIMES)]
            p = [v / sum(after) for v in after]
            best = p.index(max(p))
            now, lasted = best, lasted + 1 if best == now else 1
            seen = [ret, *seen][:60]
            r = found[symbol, ts]
            assert (r.regime, r.duration) == (regimes.REGIMES[best].name, lasted) and list(r.probabilities) == pytest.approx(p)
            assert r.volatility == pytest.approx(math.sqrt(sum(0.94**k * x * x for k, x in enumerate(seen)) / sum(0.94**k for k in range(len(seen)))))
            assert r.trend == pytest.approx(sum(0.9**k * x for k, x in enumerate(seen)) / sum(0.9**k for k in range(len(seen))))
    impossible = found["d", 0]
    assert list(impossible.probabilities) == [0.2] * 5 and impossible.regime == "crisis"


def test_spread_filter(spark):
    """It follows a spread that moves to a new level, and says so while it is off."""
    rng = random.Random(4)
    rows = [("x", "y", i, math.exp((0.0 if i < 120 else 0.5) + rng.gauss(0, 0.01)), 1.0) for i in range(200)] + [("x", "y", 500, 0.0, 1.0), ("x", "y", 501, None, 1.0)]
    found = regimes.spread_filter(spark.createDataFrame(rows, "a string, b string, bar_start_ms long, x double, y double"), warm_up=20).orderBy("bar_start_ms").collect()
    assert len(found) == 200 and all(r.zscore is None for r in found[:19]) and all(r.zscore is not None for r in found[19:])
    assert abs(found[119].mean) < 0.02 and found[199].mean > 0.4 and found[120].zscore > 2 and found[120].confidence > 0
    assert all((r.expected_bps is None) == (r.confidence is None) == (r.zscore is None or abs(r.zscore) < 2) for r in found)
    with pytest.raises(ValueError):
        regimes.spread_filter(spark.createDataFrame(rows, "a string, b string, bar_start_ms long, x double, y double"), beta=0)


def test_garch_fit_is_the_best_of_the_grid(spark):
    rows = [*return_rows(80), ("flat", 0, 0.0), ("flat", HOUR, 0.0), ("none", 0, None)]
    found = {r.symbol: r for r in volatility.garch_fit(spark.createDataFrame(rows, RETURNS)).collect()}
    assert set(found) == {"a", "b", "c"}
    for symbol, fit in found.items():
        own = [r for s, _, r in rows if s == symbol]
        best = (-math.inf,)
        for alpha in volatility.ALPHAS:
            for beta in volatility.BETAS:
                for omega in volatility.OMEGAS:
                    if round(alpha + beta, 9) < 1:
                        v, total = sum(r * r for r in own) / len(own), 0.0
                        for r in own:
                            total, before, v = total - 0.5 * (math.log(v) + r * r / v), v, max(omega + alpha * r * r + beta * v, 1e-10)
                        best = max(best, (total, alpha, beta, omega, before, own[-1]))
        assert (fit.likelihood, fit.alpha, fit.beta, fit.omega, fit.last_variance, fit.last_return) == pytest.approx(best)
    steps = volatility.garch_forecast(spark.createDataFrame([("a", 0.1, 0.8, 1e-5, 0.0, 4e-4, 0.03)], "symbol string, alpha double, beta double, omega double, likelihood double, last_variance double, last_return double"), 3).orderBy("step").collect()
    first = 1e-5 + 0.1 * 9e-4 + 0.8 * 4e-4
    assert [r.variance for r in steps] == pytest.approx([first, 1e-4 + 0.9 * (first - 1e-4), 1e-4 + 0.9**3 * (first - 1e-4)])


def test_egarch_falls_move_it_more(spark):
    rows = [("up", 0, 0.02), ("up", 1, 0.02), ("up", 2, 0.0), ("down", 0, -0.02), ("down", 1, -0.02), ("down", 2, 0.0), ("down", 3, None)]
    found = {(r.symbol, r.bar_start_ms): r.variance for r in volatility.egarch(spark.createDataFrame(rows, RETURNS), -0.1, 0.2, -0.1, 0.95).collect()}
    assert len(found) == 6 and found["up", 0] == found["down", 0] == pytest.approx(8e-4 / 3) and found["down", 2] > found["up", 2]


def test_simplex_projection():
    rng = np.random.default_rng(5)
    grid = np.array([(x, y, 1 - x - y) for x in np.linspace(0, 1, 101) for y in np.linspace(0, 1, 101) if x + y <= 1 + 1e-9])
    for w in [*rng.normal(0, 1, (30, 3)), np.array([2.0, 0, 0]), np.array([-1.0, -1, -1])]:
        found = portfolio.project_simplex(w)
        assert found.min() >= 0 and found.sum() == pytest.approx(1)
        assert np.linalg.norm(found - w) <= np.linalg.norm(grid - w, axis=1).min() + 1e-9


def test_weights(spark):
    rows = return_rows(120, seed=6)
    frame = spark.createDataFrame([*rows, ("flat", 0, 0.0), ("flat", HOUR, 0.0), ("flat", 2 * HOUR, None)], RETURNS)
    matrices = {}
    for r in portfolio.covariances(frame, 24 * HOUR, 2).collect():
        matrices[r.date, r.a, r.b] = r
    for date in {d for d, *_ in matrices}:
        own = {s: [x for y, ts, x in rows if y == s and date - 48 * HOUR <= ts < date] for s in "abc"}
        for a in "abc":
            for b in "abc":
                if a <= b:
                    assert matrices[date, a, b].covariance == pytest.approx(np.cov(own[a], own[b])[0, 1]) and matrices[date, a, b].n == len(own[a])
    for r in portfolio.risk_parity_weights(frame, 24 * HOUR, 2).groupBy("date").agg(F.min("contribution").alias("low"), F.max("contribution").alias("high"), F.sum("weight").alias("total"), F.min("weight").alias("least")).collect():
        assert r.low == pytest.approx(r.high, rel=1e-5) and r.total == pytest.approx(1) and r.least > 0
    for r in portfolio.mean_variance_weights(frame, 24 * HOUR, 2, rate=20.0, steps=3000).groupBy("date").agg(F.sort_array(F.collect_list(F.struct("symbol", "weight"))).alias("w")).collect():
        names, w = [x.symbol for x in r.w], np.array([x.weight for x in r.w])
        c = np.array([[matrices[r.date, min(a, b), max(a, b)].covariance if (r.date, min(a, b), max(a, b)) in matrices else 0.0 for b in names] for a in names])
        mu = np.array([matrices[r.date, a, a].mean_a for a in names])
        slope = mu - 4 * c @ w
        assert w.sum() == pytest.approx(1) and (slope[w > 1e-6].max() - slope[w > 1e-6].min() < 1e-3 or w.max() > 0.999) and slope[w > 1e-6].min() > slope.max() - 1e-3


def test_pairs_against_plain_loops(spark):
    rng = random.Random(8)
    at, rows = 0.0, []
    for i in range(300):
        at = 0.8 * at + rng.gauss(0, 1)
        y = 50 + 10 * math.sin(i / 30) + rng.gauss(0, 0.5)
        rows.append(("p", "q", i, 3 + 1.5 * y + at, y))
    extra = [("p", "q", 1000, None, 1.0), ("flat", "q", 0, 1.0, 2.0), ("flat", "q", 1, 2.0, 2.0), *(("flat", "q", i, float(i), 2.0) for i in range(2, 40)), *(("line", "q", i, 2.0 * i, 1.0 * i) for i in range(40))]
    frame = spark.createDataFrame(rows + extra, "a string, b string, bar_start_ms long, x double, y double")
    found = {(r.a, r.bar_start_ms): r for r in pairs.traded(pairs.spreads(frame, 20)).collect()}
    assert len(found) == 300 + 40 + 40
    position, signals = 0, set()
    for i in range(300):
        r = found["p", i]
        z = None
        if i >= 19:
            x, y = (np.array([row[k] for row in rows[i - 19 : i + 1]]) for k in (3, 4))
            beta = np.cov(x, y)[0, 1] / y.var(ddof=1)
            left = x - x.mean() - beta * (y - y.mean())
            z = left[-1] / left.std(ddof=1)
            assert (r.beta, r.spread, r.zscore) == pytest.approx((beta, left[-1], z), abs=1e-6)
        else:
            assert r.beta is None and r.zscore is None
        before = position
        if z is not None:
            if position == 0 and abs(z) > 2:
                position = 1 if z < 0 else -1
            elif position == 1 and z > -0.5 or position == -1 and z < 0.5:
                position = 0
        signal = "hold" if before == position else {1: "enter_long", -1: "enter_short", 0: "exit_long" if before == 1 else "exit_short"}[position]
        signals.add(signal)
        assert (r.position, r.signal) == (position, signal)
        assert r.state == (None if z is None else "long" if z < -2 else "short" if z > 2 else "exit" if abs(z) < 0.5 else "neutral")
    assert signals == set(pairs.SIGNALS)
    assert all(r.zscore is None and r.position == 0 for (a, _), r in found.items() if a == "flat") and found["line", 39].zscore == 0 and found["line", 39].state == "exit"
    assert pairs.traded(pairs.spreads(frame.where("false"), 20)).count() == 0
