import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelight.functions import measures, sessions
from tapelight.functions.frames import ordered
from tapelight.operators import depth, signals
from tapelight.sources import events


def millis(*when):
    return int(dt.datetime(*when, tzinfo=dt.timezone.utc).timestamp() * 1000)


def levels(spark, rows):
    return spark.createDataFrame([("X", s, float(p), float(q)) for s, p, q in rows], "symbol string, side string, price double, quantity double")


def bars(spark, closes, symbol="X", highs=None, lows=None):
    rows = [(symbol, i * 1000, float(c), float(h), float(low)) for i, (c, h, low) in enumerate(zip(closes, highs or closes, lows or closes, strict=True))]
    return spark.createDataFrame(rows, "symbol string, bar_start_ms long, close double, high double, low double")


def tick_rows(spark, rows):
    return spark.createDataFrame([("X", float(p), float(q), i, i) for i, (p, q) in enumerate(rows)], "symbol string, price double, quantity double, trade_id long, ts_ms long")


def test_depth(spark):
    book = levels(spark, [("bid", 100, 5), ("bid", 99, 50), ("bid", 95, 10), ("ask", 101, 4), ("ask", 103, 60)])
    r = depth.depth_measures(book, 99.0, 1.0, 5.0, 50.0, 0.5).first()
    assert (r.bid_wall, r.ask_wall, r.bids_above, r.asks_below) == (99, 103, 1, 0)
    assert (r.bid_within, r.ask_within, r.bid_below, r.ask_above) == (55, 4, 10, 64)
    assert (r.bid_depth_pct, r.bid_range, r.ask_range, r.whole_range, r.spread_steps, r.value_at) == (65, 5, 2, 6, 2, 4950)
    assert r.count_imbalance == pytest.approx(0.2) and r.bid_density == pytest.approx(0.6)
    asks = depth.walked(book, 10.0, 10.0).where("side = 'ask'").first()
    assert asks.full_price == pytest.approx((4 * 101 + 6 * 103) / 10) and asks.impact == pytest.approx(asks.full_price - 101) and asks.fee == pytest.approx(asks.full_price * 10 / 1000)
    thin = depth.walked(book, 1000.0, 10.0).where("side = 'bid'").first()
    assert thin.full_price is None and thin.filled == 65 and thin.fee == pytest.approx(100.0)
    one = depth.depth_measures(levels(spark, [("bid", 10, 1)]), 10.0, 1.0, 5.0, 50.0, 0.5).first()
    assert one.whole_range is None and one.bid_range is None and one.ask_within == 0 and one.volume_ratio is None
    assert depth.depth_measures(levels(spark, []), 1.0, 1.0, 1.0, 1.0, 1.0).count() == 0


@pytest.mark.parametrize(
    ("when", "label", "half", "opens"),
    [
        ((2024, 1, 12, 14, 30), "open", 1, (2024, 1, 16, 14, 30)),  # Friday, before a long weekend
        ((2024, 1, 12, 20, 59), "open", 2, (2024, 1, 16, 14, 30)),
        ((2024, 1, 12, 9, 0), "pre-market", 0, (2024, 1, 12, 14, 30)),
        ((2024, 1, 12, 21, 0), "after-hours", 0, (2024, 1, 16, 14, 30)),
        ((2024, 1, 15, 16, 0), "closed", 0, (2024, 1, 16, 14, 30)),  # a holiday
        ((2024, 3, 8, 22, 0), "after-hours", 0, (2024, 3, 11, 13, 30)),  # summer time begins
    ],
)
def test_us_clock(spark, when, label, half, opens):
    days = sessions.with_next_trading_day(sessions.calendar(spark, 2024, 2024))
    t = spark.createDataFrame([(millis(*when),)], "ms long").withColumn("day", F.to_date(sessions.new_york(F.col("ms")))).join(days, "day")
    columns = sessions.us_equity_clock(F.col("ms"), F.col("is_trading_day"), 60_000) | sessions.us_equity_next(F.col("ms"), F.col("is_trading_day"), F.col("next_day"))
    r = t.select(*(c.alias(n) for n, c in columns.items())).first()
    assert (r.label, r.half, r.next_open_ms) == (label, half, millis(*opens))
    assert (r.time_in_session_ms is not None) == (label == "open") and r.is_opening_bell_minute == (when[3:] == (14, 30)) and r.is_closing_bell_minute == (when[3:] == (20, 59))


def test_fixed_hours_and_dates(spark):
    t = spark.createDataFrame([(millis(2024, 1, 6, 8, 0),), (millis(2024, 1, 6, 16, 30),)], "ms long")
    r = t.select("ms", *(c.alias(n) for n, c in sessions.fixed_hours(F.col("ms"), *sessions.FIXED_HOURS["LSE"]).items())).orderBy("ms").collect()
    assert r[0].is_open and r[0].next_open_ms == r[0].ms and r[0].until_close_ms == 510 * 60_000
    assert not r[1].is_open and r[1].next_open_ms == millis(2024, 1, 7, 8, 0) and r[1].until_close_ms is None
    first = dt.date(1969, 12, 20)
    pairs = [(first + dt.timedelta(a), first + dt.timedelta(a + b)) for a in range(40) for b in (0, 1, 5, 6, 7, 30)]
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", sessions.weekdays_between(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(g.n == sum((g.a + dt.timedelta(i)).weekday() < 5 for i in range((g.b - g.a).days + 1)) for g in got)


def test_estimators(spark):
    closes = (100 + np.cumsum(np.sin(np.arange(60) * 1.7))).tolist()
    prices = np.array(closes)
    change = np.diff(prices)
    expected = np.cov(change[1:], change[:-1], bias=True)[0, 1]
    roll = signals.roll_spread(tick_rows(spark, [(p, 1) for p in closes])).first()
    assert roll.n == 58 and (roll.spread is None if expected >= 0 else roll.spread == pytest.approx(2 * math.sqrt(-expected)))
    slope, at = np.polyfit(prices[:-1], change, 1)
    left = change - at - slope * prices[:-1]
    error = math.sqrt((left**2).sum() / (len(change) - 2) / ((prices[:-1] - prices[:-1].mean()) ** 2).sum())
    b = bars(spark, closes)
    r = signals.mean_reversion(b.withColumn("value", F.col("close")), "symbol").first()
    assert r.slope == pytest.approx(slope) and r.t == pytest.approx(slope / error) and r.half_life == pytest.approx(-math.log(2) / slope if slope < 0 else None)
    ret = np.diff(np.log(prices))
    off = np.cumsum(ret - ret.mean())
    assert signals.hurst(b).first().hurst == pytest.approx(min(max(math.log((off.max() - off.min()) / ret.std()) / math.log(len(ret)), 0), 1))
    flat = bars(spark, [5.0] * 6)
    assert signals.hurst(flat).first().hurst is None and signals.mean_reversion(flat.withColumn("value", F.col("close")), "symbol").first().t is None
    assert signals.high_low_spread(bars(spark, [1, 1], highs=[2, 2], lows=[0, 1])).first().spread is None
    assert signals.high_low_spread(bars(spark, [1, 1], highs=[1, 1], lows=[1, 1])).first().spread == 0
    assert signals.hurst(bars(spark, [])).count() == 0


def test_tick_patterns(spark):
    t = tick_rows(spark, [(100, 1), (110, 5), (109, 1), (99, 1), (99, 0), (0, 1)])
    assert [(r.trade_id, r.after) for r in signals.sandwiches(t, 2, 0.05).collect()] == [(0, 99)]
    assert signals.sandwiches(t, 1, 0.05).count() == 0
    assert [r.trade_id for r in signals.front_runs(tick_rows(spark, [(100, 1), (100, 5), (0, 0), (0, 3)]), 0.001, 3.0).collect()] == [0]


def test_health_summary(spark):
    feeds = spark.createDataFrame([("a", 900, 5, 100, False), ("b", 100, 9, 900, True), ("c", None, 0, None, None)], "feed_id string, last_ms long, n long, age_ms long, is_stale boolean")
    r = signals.health_summary(feeds).first()
    assert (r.healthy, r.stale, r.unknown, r.stale_ratio_known, r.most_stale, r.oldest_stale, r.most_ticks, r.last_updated, r.is_degraded) == (1, 1, 1, 0.5, "c", "b", "b", "a", True)


def test_boosts_and_ratios(spark):
    one = spark.createDataFrame([(0.5, 0.5, 2.0, 1.0, 1.0)], "b double, o double, m double, t double, x double")
    r = one.select(*(c.alias(n) for n, c in measures.boost_algebra(*map(F.col, "bomtx")).items())).first()
    assert r.composed == pytest.approx(0.8) and r.invariant == pytest.approx(4) and r.cone == "lightlike" and r.distance == 0
    rows = bars(spark, [9, 12]).selectExpr("symbol", "bar_start_ms", "IF(bar_start_ms = 0, 10.0D, 8.0D) AS open", "GREATEST(open, close) AS high", "LEAST(open, close) AS low", "close", "0.0D AS volume")
    out = rows.select("bar_start_ms", *(c.alias(n) for n, c in measures.bar_ratios(ordered(order=("bar_start_ms",)), 0.0, 3.0).items())).orderBy("bar_start_ms").collect()
    assert out[1].is_bullish_engulfing and out[1].is_engulfing and out[1].is_intraday_reversal and out[1].relative_volume is None and out[1].range_overlap == 1


def test_json_events(spark):
    payloads = [
        '{"price": "10.5", "size": 2, "symbol": "A", "side": "B", "timestamp": 1700000000000000}', '{"type": "trade", "sym": "A", "p": 1}', '{"type": "bar", "s": "A", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "vw": null}',
        '{"type": "book", "s": "A", "bids": [["1", "2"], ["x", 1]], "asks": []}', '{"status": "odd"}', "[1, 2]", "", None, '{"type": "quote", "s": "A", "bid": 1, "ask": 2}', '{"type": "other", "price": 1, "size": 1, "symbol": "A"}',
    ]
    rows = events.parse_events(spark.createDataFrame(list(enumerate(payloads)), "n int, payload string")).orderBy("n").collect()
    assert [r.kind for r in rows] == ["trade", None, "bar", "book", "status", None, None, None, "quote", None]
    trade, bar, book, status, quote = (rows[i] for i in (0, 2, 3, 4, 8))
    assert (trade.trade.price, trade.trade.size, trade.trade.side, trade.timestamp_ns, trade.quote) == (10.5, 2, "buy", 1700000000000000, None)
    assert (bar.bar.close, bar.bar.volume, bar.bar.vwap, bar.bar.period_secs, bar.timestamp_ns) == (1.5, 0, None, 60, 0)
    assert [tuple(x) for x in book.book.bids] == [(1, 2)] and book.book.asks == [] and not book.book.is_snapshot
    assert tuple(status.status) == ("connected", "odd") and status.symbol is None and quote.quote.ask_size == 0


def test_fix(spark):
    def framed(body, begin="8=FIX.4.2"):
        text = f"{begin}|9={len(body.encode())}|{body}".replace("|", "\x01")
        return text + f"10={sum(text.encode()) % 256:03}\x01"

    good = framed("35=D|44=1=2|55=\u00e9|55=B|")
    cases = [good, framed("35=D|", "8=FIX.4.4"), good[:-2] + "x\x01", framed("44=1|"), framed("35=D|x=1|"), framed("35=D|bare|"), "", None]
    rows = events.parse_fix(spark.createDataFrame(list(enumerate(cases)), "n int, message string")).select("n", "msg_type", "error", events.fix_value(F.col("fields"), 55).alias("symbol"), events.fix_value(F.col("fields"), 44).alias("price")).orderBy("n").collect()
    assert (rows[0].error, rows[0].msg_type, rows[0].symbol, rows[0].price) == (None, "D", "B", "1=2")
    assert [r.error for r in rows[1:]] == ["the version isn't FIX.4.2", "the checksum isn't a number", "tag 35 is missing", "a tag isn't a number", "a field has no separator", "tag 8 is missing", "tag 8 is missing"]
    made = spark.range(1).select(events.fix_message(F.lit("D"), F.create_map(F.lit(55), F.lit("\u00e9"), F.lit(34), F.lit("7"), F.lit(8), F.lit("no"))).alias("m")).first().m
    assert made == framed("35=D|34=7|55=\u00e9|")
