"""Correlation networks, combined signals, noise and merged feeds, against plain loops."""

import math
import random

import numpy as np
import pytest

from tapelight.operators import combining, feeds, networks

HOUR, DAY = 3_600_000, 86_400_000
BARS = "symbol string, bar_start_ms long, close double, ret double"


def bar_rows(n=96, seed=1):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.gauss(0, 0.02)
        for j, s in enumerate("abcd"):
            if (i + j) % 11:
                rows.append((s, i * HOUR, math.exp(at * (1, 1, -1, 0)[j] + rng.gauss(0, 0.01)), rng.gauss(0, 0.05)))
    return rows + [("flat", i * HOUR, 5.0, 0.0) for i in range(n)] + [("a", 10_000 * HOUR, 0.0, None), ("b", 10_000 * HOUR, None, None)]


def plain_correlations(rows, periods):
    x = {}
    for s, ts, close, _ in rows:
        if close and close > 0:
            x.setdefault(s, {})[ts] = math.log(close)
    out = {}
    for a in x:
        for b in x:
            if a < b:
                both = sorted(set(x[a]) & set(x[b]))
                for p in {t // DAY for t in both}:
                    own = [t for t in both if t // DAY <= p and (periods is None or t // DAY > p - periods)]
                    u, v = np.array([x[a][t] for t in own]), np.array([x[b][t] for t in own])
                    flat = u.var() < 1e-12 or v.var() < 1e-12
                    out[(p + 1) * DAY, a, b] = (None if flat else np.corrcoef(u, v)[0, 1], len(own))
    return out


@pytest.mark.parametrize("periods", [2, None])
def test_correlations_and_centrality(spark, periods):
    rows = bar_rows()
    correlated = networks.correlations(spark.createDataFrame(rows, BARS), DAY, periods)
    found = {(r.date, r.a, r.b): (r.correlation, r.n) for r in correlated.collect()}
    want = plain_correlations(rows, periods)
    assert set(found) == set(want)
    for key, (c, n) in want.items():
        assert found[key][1] == n and (found[key][0] is None if c is None else found[key][0] == pytest.approx(c, abs=1e-9))
    for date in {d for d, *_ in want}:
        strength = {s: sum(abs(c) for (d, a, b), (c, _) in want.items() if d == date and s in (a, b) and c is not None and abs(c) >= 0.5) for s in ("a", "b", "c", "d", "flat")}
        degree = {s: sum(1 for (d, a, b), (c, _) in want.items() if d == date and s in (a, b) and c is not None and abs(c) >= 0.5) / 4 for s in strength}
        got = {r.symbol: r for r in networks.centrality(correlated.where(f"date = {date}"), 0.5).collect()}
        assert {s: r.degree for s, r in got.items()} == degree and all(r.strength == pytest.approx(strength[s]) for s, r in got.items())
        assert [s for s, r in got.items() if r.is_leader] == [min(strength, key=lambda s: (-round(strength[s], 9), s))]


def test_shifts(spark):
    rows = [(d, a, b, c, 10) for d in range(1, 9) for a, b, c in (("a", "b", 0.2 if d < 6 else 0.9), ("a", "c", -0.4), ("b", "c", None), ("c", "d", 0.01))]
    correlated = spark.createDataFrame(rows, "date long, a string, b string, correlation double, n long")
    found = networks.shifts(correlated, 0.1, 0.1, 3).orderBy("date").collect()
    average, want = None, []
    for d in range(1, 9):
        mean = (0.2 if d < 6 else 0.9) / 2 + 0.2
        average = mean if average is None else average + 0.5 * (mean - average)
        want.append((d, pytest.approx(mean), pytest.approx(average), pytest.approx(mean - average), abs(mean - average) > 0.1))
    assert [tuple(r) for r in found] == want and any(r.is_shift for r in found) and not all(r.is_shift for r in found)
    with pytest.raises(ValueError):
        networks.shifts(correlated, 0.1, 0, 3)


def test_contagion_against_plain_loops(spark):
    rows = bar_rows(seed=3)
    frame = spark.createDataFrame(rows, BARS)
    correlated = networks.correlations(frame, DAY, 2)
    lasting = {}
    for (date, a, b), (c, _) in sorted(plain_correlations(rows, 2).items(), key=lambda x: x[0]):
        lasting.setdefault((a, b), []).append((date, c))
    want = set()
    for ts in {r[1] for r in rows}:
        shocked = {s: abs(ret) for s, t, _, ret in rows if t == ts and ret is not None and abs(ret) >= 0.04}

        def edge(a, b, ts=ts):
            known = [c for d, c in lasting.get((min(a, b), max(a, b)), []) if d <= ts // DAY * DAY]
            return known[-1] if known and known[-1] is not None and abs(known[-1]) >= 0.3 else None

        free = sorted(shocked)
        while free:
            members = [free[0], *(s for s in free[1:] if edge(free[0], s) is not None)]
            free = [s for s in free if s not in members]
            if len(members) > 1:
                inside = [abs(edge(a, b)) for a in members for b in members if a < b and edge(a, b) is not None]
                mean = sum(shocked[s] for s in members) / len(members)
                want.add((ts, max(members, key=lambda s: shocked[s]), tuple(members), round(mean, 9), round(mean * sum(inside) / len(inside), 9)))
    found = {(r.bar_start_ms, r.trigger, tuple(r.affected), round(r.mean_shock, 9), round(r.score, 9)) for r in networks.contagion(frame, correlated, 0.04, 0.3, DAY).collect()}
    assert found == want and len(want) > 5


def signal_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    x[:, 1] += 0.7 * x[:, 0]
    rows = [("s", i, *map(float, v), float(rng.normal())) for i, v in enumerate(x)]
    rows += [("zero", i, 0.0, float(i), float(i * i), 1.0) for i in range(5)] + [("s", 100, None, 1.0, 2.0, None)]
    return x, rows


SIGNALS = "symbol string, bar_start_ms long, p double, q double, r double, value double"


def test_orthogonal(spark):
    x, rows = signal_rows()
    found = combining.orthogonal(spark.createDataFrame(rows, SIGNALS), ["p", "q", "r"], ["bar_start_ms"]).collect()
    own = np.array([(r.p, r.q, r.r) for r in sorted(found, key=lambda r: r.bar_start_ms) if r.symbol == "s" and r.bar_start_ms < 100])
    gram = own.T @ own
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-9 and own[:, 0] == pytest.approx(x[:, 0])
    assert np.linalg.matrix_rank(np.hstack([own, x])) == 3
    zero = np.array([(r.p, r.q, r.r) for r in sorted(found, key=lambda r: r.bar_start_ms) if r.symbol == "zero"])
    assert (zero[:, 0] == 0).all() and (zero[:, 1] == range(5)).all() and abs(zero[:, 1] @ zero[:, 2]) < 1e-9
    assert [(r.p, r.q, r.r) for r in found if r.bar_start_ms == 100] == [(None, None, None)] or len(found) == len(rows)


def test_combined_and_overlap(spark):
    x, rows = signal_rows()
    frame = spark.createDataFrame(rows, SIGNALS)
    names = ["p", "q", "r"]
    skills = combining.foretelling(frame, names, "value")
    own = {r.symbol: r for r in skills.collect()}
    later = [r[5] for r in rows[1:60]]
    want = [np.corrcoef(x[:59, k], later)[0, 1] for k in range(3)]
    assert [own["s"][s] for s in names] == pytest.approx(want) and own["zero"].p is None
    shapes = {"equal": lambda c: 1.0, "absolute": abs, "squared": lambda c: c * c, "positive": lambda c: max(c, 0), "kelly": lambda c: max(c * (1 - c * c), 0)}
    assert set(shapes) == set(combining.METHODS)
    for method, shape in shapes.items():
        shares = {r.symbol: [r[s] for s in names] for r in combining.weights(skills, names, method).collect()}
        raw = [shape(c) for c in want]
        assert shares["s"] == pytest.approx([v / sum(raw) for v in raw] if sum(raw) else [1 / 3] * 3) and shares["zero"] == pytest.approx([1 / 3] * 3)
    done = {(r.symbol, r.bar_start_ms): r.combined for r in combining.combined(frame, combining.weights(skills, names, "equal"), names, ["bar_start_ms"]).collect()}
    assert done["s", 7] == pytest.approx(x[7].mean()) and done["s", 100] is None
    overlap = {r.symbol: r.overlap for r in combining.diversification(frame.where("p IS NOT NULL"), names).collect()}
    c = np.abs(np.corrcoef(x.T))
    assert overlap["s"] == pytest.approx((c[0, 1] + c[0, 2] + c[1, 2]) / 3) and overlap["zero"] == pytest.approx(np.corrcoef(range(5), [i * i for i in range(5)])[0, 1] / 3)


TICKS = "symbol string, trade_id long, ts_ms long, price double, quantity double, exchange string"


def test_noise_against_plain_loops(spark):
    rng = random.Random(5)
    rows = [("a", i, i * 20 * 60_000, 100 + rng.choice([0, 0.5]) + rng.gauss(0, 0.1), 1.0, "x") for i in range(200)] + [("few", i, i, 1.0, 1.0, "x") for i in range(4)] + [("flat", i, i, 2.0, 1.0, "x") for i in range(20)] + [("one", 0, 0, 2.0, 1.0, "x"), ("one", 1, 1, None, 1.0, "x")]
    found = {(r.symbol, r.period_start_ms): r for r in combining.noise(spark.createDataFrame(rows, TICKS), DAY, 3).collect()}
    for day in range(2):
        d = np.diff([r[3] for r in rows if r[0] == "a" and r[2] // DAY == day])
        c = [((d[h:] - d.mean()) * (d[: len(d) - h] - d.mean())).sum() / (len(d) - h) for h in range(4)]
        variance = max(0.0, c[0] + 2 * sum((1 - 6 * x * x + 6 * x**3 if x <= 0.5 else 2 * (1 - x) ** 3) * c[h] for h in (1, 2, 3) for x in [h / 4]))
        r = found["a", day * DAY]
        assert r.n == len(d) + 1 and r.kernel_variance == pytest.approx(variance) and r.roll_spread == pytest.approx(2 * math.sqrt(max(0, -c[1])))
        assert r.noise_to_signal == pytest.approx(r.roll_spread**2 / 4 / variance if variance > 1e-16 else 0)
    assert found["few", 0].kernel_variance is None and found["few", 0].roll_spread == 0 and found["one", 0].roll_spread is None
    assert (found["flat", 0].kernel_variance, found["flat", 0].noise_to_signal) == (0, 0)


def test_failover(spark):
    rows = [("s", 1, 0, 1.0, 1.0, "b"), ("s", 2, 100, 1.0, 1.0, "a"), ("s", 3, 150, 1.0, 1.0, "b"), ("s", 4, 1100, 1.0, 1.0, "b"), ("s", 5, 1101, 1.0, 1.0, "c"), ("s", 6, 2000, 1.0, 1.0, "a"), ("s", 7, 2000, 1.0, 1.0, None), ("s", 8, 3200, 1.0, 1.0, None), ("t", 9, 10, 1.0, 1.0, "b"), ("s", 10, None, 1.0, 1.0, "a")]
    frame = spark.createDataFrame(rows, TICKS)
    assert [(r.trade_id, r.is_fallback) for r in feeds.failover(frame, "a", 1000, {}).orderBy("trade_id").collect()] == [(1, True), (2, False), (5, True), (6, False), (8, True), (9, True)]
    late = feeds.failover(frame, "a", 1000, {"a": 50, "b": 5000}).orderBy("trade_id").collect()
    assert [(r.trade_id, r.compensated_ms) for r in late] == [(1, 0), (2, 50), (3, 0), (4, 0), (5, 1101), (6, 1950), (8, 3200), (9, 0)]


def test_vwap_merged(spark):
    rows = [("s", 1, 10, 10.0, 1.0, "a"), ("s", 2, 20, 20.0, 3.0, "b"), ("s", 3, 30, 30.0, 0.0, "a"), ("s", 4, 40, 40.0, 0.0, "a"), ("s", 5, 50, None, 1.0, "a"), ("s", 6, 25, 1.0, None, "a")]
    found = feeds.vwap_merged(spark.createDataFrame(rows, TICKS), 2, {"b": 5}).orderBy("trade_id").collect()
    assert [(r.trade_id, r.price, r.quantity, r.anchor_ms) for r in found] == [(1, 17.5, 4.0, 15), (2, 20.0, 3.0, 30), (3, 40.0, 0.0, 40), (4, 40.0, 0.0, 40)]


def test_nothing(spark):
    bars, ticks = spark.createDataFrame([], BARS), spark.createDataFrame([], TICKS)
    correlated = networks.correlations(bars, DAY)
    assert correlated.count() == 0 and networks.centrality(correlated, 0.1).count() == 0 and networks.shifts(correlated, 0.1, 0.1, 2).count() == 0
    assert networks.contagion(bars, correlated, 0.1, 0.1, DAY).count() == 0 and combining.noise(ticks, DAY).count() == 0
    assert feeds.failover(ticks, "a", 1, {}).count() == 0 and feeds.vwap_merged(ticks, 3, {}).count() == 0
    assert combining.orthogonal(spark.createDataFrame([], SIGNALS), ["p", "q"], ["bar_start_ms"]).count() == 0
