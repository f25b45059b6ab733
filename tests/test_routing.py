"""Candle patterns and the routing of orders, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tapelight.operators import candles, routing

BARS = "symbol string, bar_start_ms long, open double, high double, low double, close double"


def plain_patterns(bars):
    out = set()
    for i, (o, h, lo, c) in enumerate(bars):
        body, extent = abs(c - o), h - lo
        below, above = min(o, c) - lo, h - max(o, c)
        if extent > 0 and body < 0.1 * extent:
            out.add((i, "doji", 0))
        if body > 0 and extent > 0 and below >= 2 * body and above <= 0.5 * body:
            out.add((i, "hammer", 1))
        if body > 0 and extent > 0 and max(below, above) >= 2.5 * body and min(below, above) <= 0.5 * body:
            out.add((i, "pin_bar", 1 if below > above else -1))
        if i >= 1:
            o1, h1, l1, c1 = bars[i - 1]
            if h < h1 and lo > l1:
                out.add((i, "inside_bar", 0))
            if c1 < o1 and c > o and o <= c1 and c >= o1:
                out.add((i, "bullish_engulfing", 1))
            if c1 > o1 and c < o and o >= c1 and c <= o1:
                out.add((i, "bearish_engulfing", -1))
        if i >= 2:
            o2, _, _, c2 = bars[i - 2]
            small = h1 - l1 > 0 and abs(c1 - o1) < 0.3 * (h1 - l1)
            if c2 < o2 and small and c > o and c > (o2 + c2) / 2:
                out.add((i, "morning_star", 1))
            if c2 > o2 and small and c < o and c < (o2 + c2) / 2:
                out.add((i, "evening_star", -1))
    return out


def test_candles_against_plain_loops(spark):
    rng = random.Random(1)
    series = []
    for _ in range(600):
        o, c = rng.randint(0, 8) * 1.0, rng.randint(0, 8) * 1.0
        series.append((o, max(o, c) + rng.choice([0, 0, 1, 5]), min(o, c) - rng.choice([0, 0, 1, 5]), c))
    series += [(3.0, 3.0, 3.0, 3.0)] * 3
    rows = [(s, i, *b) for s in ("a", None) for i, b in enumerate(series)]
    found = candles.patterns(spark.createDataFrame(rows, BARS))
    got = [(r.symbol, r.bar_start_ms, r.pattern, r.direction) for r in found.collect()]
    want = plain_patterns(series)
    assert set(got) == {(s, *p) for s in ("a", None) for p in want} and len(got) == len(set(got)) and len({p for _, p, _ in want}) == 8
    assert all(0 < r.strength <= 1 for r in found.collect())
    assert {(r.pattern, r.n) for r in candles.counts(found).where("symbol = 'a'").collect()} == {(p, sum(x[1] == p for x in want)) for p in {x[1] for x in want}}
    holes = spark.createDataFrame([("a", 0, None, 2.0, 1.0, 1.5), ("a", 1, 1.0, None, 0.0, 2.0), ("a", 2, 1.0, 2.0, None, None)], BARS)
    assert candles.patterns(holes).count() == 0 and candles.patterns(spark.createDataFrame([], BARS)).count() == 0


VENUES = "venue long, market string, fee_bps double, fill_rate double, delay_ms double"
ORDERS = "order_id long, market string, quantity double"


def test_history_and_scores(spark):
    seen = spark.createDataFrame([(1, 1, 0.5, 4.0), (1, 2, 1.0, 8.0), (1, 3, None, 1.0), (2, 1, None, None)], "venue long, i long, fill_rate double, delay_ms double")
    history = routing.history(seen, 0.25, ["i"])
    assert [tuple(r) for r in history.collect()] == [(1, 0.625, 5.0, 2)]
    venues = spark.createDataFrame([(1, "m", 3.0, 0.9, 2.0), (2, "m", 2.0, 0.8, 1.0), (3, "m", 0.0, 1.0, 1.0), (4, "m", 1.0, 1.0, 0.0), (5, "m", 1.0, 1.0, None)], VENUES)
    plain = {r.venue: r.score for r in routing.scored(venues).collect()}
    assert plain == {1: pytest.approx(0.36 + 0.1 + 0.15), 2: pytest.approx(0.32 + 0.15 + 0.3), 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r.venue: r.score for r in routing.scored(venues, history).collect()}[1] == pytest.approx(0.4 * 0.625 + 0.1 + 0.06)


def test_routes(spark):
    venues = routing.scored(spark.createDataFrame([(1, "m", 3.0, 0.9, 2.0), (2, "m", 2.0, 0.8, 1.0), (3, "m", 5.0, 0.1, 9.0), (4, "n", 0.0, 1.0, 1.0), (5, "n", 0.0, 1.0, 1.0)], VENUES))
    orders = spark.createDataFrame([(1, "m", 10.0), (2, "m", 100.0), (3, "n", 100.0), (4, "none", 1.0), (5, "m", None)], ORDERS)
    found = {(r.order_id, r.venue): (r.place, r.quantity, r.cost_bps) for r in routing.routed(orders, venues, "market", 50, 2).collect()}
    one, two = 0.61, 0.77
    assert found == {
        (1, 2): (1, 10.0, 2.0), (2, 2): (1, pytest.approx(100 * two / (one + two)), pytest.approx((2 * two + 3 * one) / (one + two))), (2, 1): (2, pytest.approx(100 * one / (one + two)), pytest.approx((2 * two + 3 * one) / (one + two))),
        (3, 4): (1, 50.0, 0.0), (3, 5): (2, 50.0, 0.0),
    }
    sliced = routing.sliced(orders, [1, 3]).where("order_id = 2").orderBy("slice").collect()
    assert [(r.slice, r.quantity) for r in sliced] == [(0, 25.0), (1, 75.0)] and routing.sliced(orders, [0, 0]).where("order_id = 1").collect()[1].quantity == 5.0


@pytest.mark.parametrize("side", ["buy", "sell"])
def test_filling_against_a_plain_loop(spark, side):
    rng = random.Random(2)
    orders = [(i, rng.choice(["m", "n", None]), rng.choice([float(rng.randint(1, 30)), 0.0, None])) for i in range(60)]
    offers = [(i, rng.choice(["m", "n", "o"]), float(rng.randint(1, 9)), rng.choice([float(rng.randint(1, 40)), 0.0, None])) for i in range(40)]
    want = []
    for market in ("m", "n"):
        left = [[p, i, s] for i, m, p, s in offers if m == market and s]
        left.sort(key=lambda x: (x[0] if side == "buy" else -x[0], x[1]))
        for order, m, quantity in orders:
            while m == market and quantity and left:
                taken = min(quantity, left[0][2])
                want.append((order, left[0][1], taken, left[0][0]))
                quantity -= taken
                left[0][2] -= taken
                if not left[0][2]:
                    left.pop(0)
    frames = spark.createDataFrame(orders, ORDERS), spark.createDataFrame(offers, "offer_id long, market string, price double, size double")
    found = [tuple(r) for r in routing.filled(*frames, "market", side).select("order_id", "offer_id", "filled", "price").collect()]
    assert sorted(found) == sorted(want) and len(want) > 15
    assert routing.filled(frames[0], frames[1].where("false"), "market").count() == 0 and routing.filled(frames[0].where("false"), frames[1], "market").count() == 0


@pytest.mark.parametrize(("few", "many"), [("order", "offer"), ("offer", "order"), (None, None)])
def test_filling_by_blocks_of_a_market(spark, few, many):
    rng = random.Random(3)
    n, amount = {few: 5, many: 600}, {few: 700, many: 9}
    orders = [(i, "m", float(rng.randint(1, amount.get("order", 20)))) for i in range(n.get("order", 400))]
    offers = [(i, "m", float(rng.randint(1, 3)), float(rng.randint(1, amount.get("offer", 20)))) for i in range(n.get("offer", 400))]
    frames = spark.createDataFrame(orders, ORDERS), spark.createDataFrame(offers, "offer_id long, market string, price double, size double")
    whole, parts = ({tuple(r) for r in routing.filled(*frames, "market", size=size).collect()} for size in (1 << 20, 8))
    least = min(sum(q for _, _, q in orders), sum(s for *_, s in offers))
    assert whole == parts and sum(r[2] for r in parts) == least
    blocks = routing._blocks(frames[1], "market", F.struct("price", "offer_id"), 8).groupBy("block").count().collect()
    assert len(blocks) > n.get("offer", 400) // 20 and max(r["count"] for r in blocks) < 80


def test_filling_needs_no_market_in_one_task(spark):
    plan = __spark_entry__.queries()["orders_filled"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Window [" in line and "block" not in line] == []
