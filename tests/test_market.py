import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tapelight.functions import frames, sessions
from tapelight.operators import bars, book, carried, filters, folds, framed, joins, reports, rolling
from tapelight.plans import catalog
from tapelight.sources import ticks as sources
from tapelight.streaming import live


def tick_rows(spark, rows, symbol="BTC"):
    return spark.createDataFrame([(symbol, "binance", float(p), float(q), 1, i, t) for i, (p, q, t) in enumerate(rows)], "symbol string, exchange string, price double, quantity double, side int, trade_id long, ts_ms long")


@pytest.mark.parametrize(
    ("rows", "period", "expected"),
    [
        ([(100, 5, 60000), (110, 3, 60100), (90, 2, 60200), (105, 4, 60300)], 60000, (60000, 100, 110, 90, 105, 14, 4)),
        ([(3000, 7, 30000)], 30000, (30000, 3000, 3000, 3000, 3000, 7, 1)),
        ([(200, 1, 0), (50, 1, 1), (300, 1, 2), (100, 1, 3), (150, 1, 4)], 60000, (0, 200, 300, 50, 150, 5, 5)),
    ],
)
def test_time_bars(spark, rows, period, expected):
    r = bars.time_bars(tick_rows(spark, rows), period).first()
    assert (r.bar_start_ms, r.open, r.high, r.low, r.close, r.volume, r.trade_count) == expected


def test_bar_edges_and_gaps(spark):
    made = bars.time_bars(tick_rows(spark, [(1, 1, 300000), (2, 1, 599999), (3, 1, 600000)]), 300000).orderBy("bar_start_ms").collect()
    assert [(r.bar_start_ms, r.trade_count) for r in made] == [(300000, 2), (600000, 1)]
    filled = bars.gap_fill(bars.time_bars(tick_rows(spark, [(1, 1, 60000), (2, 1, 240000)]), 60000), 60000).orderBy("bar_start_ms").collect()
    assert [(r.bar_start_ms, r.volume, r.is_gap_fill) for r in filled] == [(60000, 1, False), (120000, 0, True), (180000, 0, True), (240000, 1, False)]


def test_min_max_window(spark):
    t = tick_rows(spark, [(p, 1, i) for i, p in enumerate([0, 50, 100, 200])])
    from tapelight.functions.frames import last_rows

    assert [r.n for r in t.select(rolling.min_max("price", last_rows(3)).alias("n"), "trade_id").orderBy("trade_id").collect()] == [0, 1, 1, 1]


def test_lorentz_is_inverted(spark):
    b = spark.createDataFrame([(float(t), 50000.0) for t in (60000, 120000, 180000)], "t double, x double")
    there = rolling.lorentz(b, 0.5, "t", "x")
    back = rolling.lorentz(there.select("t", F.col("t_boosted").alias("a"), F.col("x_boosted").alias("b")), -0.5, "a", "b").collect()
    assert all(abs(r.t_boosted - r.t) < 1e-6 and abs(r.x_boosted - 50000) < 1e-6 for r in back)
    with pytest.raises(ValueError):
        rolling.lorentz(b, 1.0, "t", "x")


def plain_ema(x, n):
    out = [None] * (n - 1) + [sum(x[:n]) / n]
    for v in x[n:]:
        out.append(out[-1] + 2 / (n + 1) * (v - out[-1]))
    return out[: len(x)] if len(x) >= n else [None] * len(x)


def test_folds(spark):
    closes = [10, 12, 11, 15, 14, 13, 18, 17, 16, 20]
    b = spark.createDataFrame([("A", i, c + 0.0, c + 1.0, c - 1.0) for i, c in enumerate(closes)], "symbol string, bar_start_ms long, close double, high double, low double")
    assert [r.ema for r in folds.with_ema(b, 3).orderBy("bar_start_ms").collect()] == pytest.approx(plain_ema(closes, 3))
    rsi = [r.rsi for r in folds.rsi(b, 3).orderBy("bar_start_ms").collect()]
    assert rsi[:3] == [None] * 3 and rsi[3] == pytest.approx(100 - 100 / (1 + 6 / 1))
    rising = spark.createDataFrame([("A", i, float(i), float(i), float(i)) for i in range(6)], b.schema)
    assert folds.rsi(rising, 3).orderBy("bar_start_ms").collect()[-1].rsi == 100
    assert folds.garch(b, 1e-4, 0.1, 0.8).orderBy("bar_start_ms").first().variance == pytest.approx(1e-3)
    assert folds.atr(b, 3).where("atr IS NULL").count() == 2
    trades = spark.createDataFrame([("A", 1, 1, 10.0, 100.0), ("A", 2, 1, 10.0, 110.0), ("A", 3, -1, 5.0, 120.0), ("A", 4, -1, 20.0, 90.0)], "symbol string, trade_id long, side int, quantity double, price double")
    assert [(r.position, r.average_cost, r.realised) for r in carried.positions(trades).orderBy("trade_id").collect()] == [(10, 100, 0), (20, 105, 0), (15, 105, 75), (-5, 90, -150)]


def test_as_of_and_lee_ready(spark):
    trades = spark.createDataFrame([("A", 1, 10, 5.0), ("A", 2, 20, 7.0), ("B", 3, 5, 1.0)], "symbol string, trade_id long, ts_ms long, price double")
    quotes = spark.createDataFrame([("A", 10, 4.0, 5.0), ("A", 15, 7.0, 7.0)], "symbol string, ts_ms long, bid double, ask double")
    rows = joins.lee_ready(joins.as_of(trades, quotes, "symbol", "ts_ms", ["bid", "ask"])).orderBy("trade_id").collect()
    assert [(r.bid, r.aggressor) for r in rows] == [(4, 1), (7, 1), (None, None)]


def test_book(spark):
    deltas = [("A", "bid", 50000.0, 5.0, 1), ("A", "bid", 49900.0, 3.0, 2), ("A", "ask", 50100.0, 2.0, 3), ("A", "ask", 50200.0, 1.0, 4), ("A", "bid", 50000.0, 10.0, 5), ("A", "ask", 50200.0, 0.0, 6)]
    state = book.state(spark.createDataFrame(deltas, "symbol string, side string, price double, quantity double, sequence long"))
    m = book.metrics(state).first()
    assert (m.bid, m.ask, m.spread, m.is_crossed) == (50000, 50100, 100, False) and state.where("side = 'ask'").count() == 1
    gaps = book.sequence_gaps(spark.createDataFrame([("A", 1, 1), ("A", 2, 2), ("A", 3, 5), ("A", 4, 5)], "symbol string, ts_ms long, sequence long"))
    assert [(r.expected, r.sequence) for r in gaps.orderBy("ts_ms").collect()] == [(3, 5), (6, 5)]


def test_sessions(spark):
    ms = spark.createDataFrame([(1704724200000,), (1705147200000,), (1704621600000,), (1704664800000,), (1704715200000,)], "ms long")
    rows = ms.select("ms", sessions.us_equity_status(F.col("ms")).alias("us"), sessions.forex_status(F.col("ms")).alias("fx")).collect()
    assert [r.us for r in rows[:2]] == ["Open", "Closed"] and [r.fx for r in rows[2:]] == ["Closed", "Open", "Open"]


def test_holidays(spark):
    assert [sessions.easter(y) for y in (2000, 2019, 2024, 2025, 2038)] == [dt.date(2000, 4, 23), dt.date(2019, 4, 21), dt.date(2024, 3, 31), dt.date(2025, 4, 20), dt.date(2038, 4, 25)]
    assert sessions.us_holidays(2024) == [dt.date(2024, *d) for d in ((1, 1), (1, 15), (2, 19), (3, 29), (5, 27), (6, 19), (7, 4), (9, 2), (11, 28), (12, 25))]
    assert sessions.calendar(spark, 2024, 2024).where("is_trading_day").count() == 252


def test_payloads(spark):
    raw = [("binance", '{"p":"100","q":"1","m":false}'), ("binance", '{"p":"100","q":"1","m":true}'), ("coinbase", '{"price":"100","size":"1","side":"buy"}'), ("alpaca", '{"p":"100","s":"1"}'), ("binance", '{"p":65000.0,"q":0.5}'), ("polygon", "{}"), ("polygon", '{"p":"x","s":"1"}'), ("polygon", '{"p":"1"}'), ("polygon", None)]
    rows = sources.normalise(spark.createDataFrame([(e, "btc", p, 1) for e, p in raw], "exchange string, symbol string, payload string, received_at_ms long")).collect()
    assert [r.side for r in rows] == ["buy", "sell", "buy", None, None, None, None, None, None]
    assert [r.error is None for r in rows] == [True] * 5 + [False] * 4 and float(rows[4].price) == 65000


def test_ndjson_and_replay(spark, tmp_path):
    (tmp_path / "t.ndjson").write_text('# head\n\n{"exchange":"a","symbol":"s","price":1.5,"quantity":2,"received_at_ms":10}\n{"symbol":"s","price":2,"received_at_ms":30}\nbroken\n')
    ticks = sources.read_ndjson(spark, str(tmp_path / "t.ndjson"))
    assert ticks.count() == 3 and ticks.where("error IS NOT NULL").count() == 1
    assert [r.received_at_ms for r in sources.replay(ticks.where("error IS NULL"), 5).collect()] == [30]


def test_delta_frames(spark):
    rows = spark.createDataFrame([("A", 1, 1, 100, 1, 5.0), ("A", 2, 2, 97, -1, 2.0), ("A", 3, 3, 99, 1, 1.0)], "symbol string, ts_ms long, trade_id long, price_ticks long, side int, quantity double")
    decoded = sources.delta_decode(sources.delta_encode(rows)).orderBy("ts_ms").collect()
    assert [(r.price_ticks, r.side, r.quantity) for r in decoded] == [(100, 1, 5), (97, -1, 2), (99, 1, 1)]
    runs = sources.run_lengths(spark.createDataFrame([("A", i, v) for i, v in enumerate("xxyxx")], "k string, i int, v string"), "k", ["i"], "v").orderBy("run").collect()
    assert [(r.v, r.n) for r in runs] == [("x", 2), ("y", 1), ("x", 2)]


def test_filters(spark):
    t = tick_rows(spark, [(1, 1, 1), (1, 1, 2), (2, 1, 3), (100, 1, 4)])
    assert filters.not_repeated(t).count() == 3
    assert [r.price for r in filters.not_outlier(t, 3, 2.0).orderBy("trade_id").collect()] == [1, 1, 2]
    assert reports.quantiles(t, "symbol", "price", {"p50": 0.5}).first().p50 == 2


def test_streaming_bars(spark, tmp_path):
    spark.createDataFrame([("A", 1.0, 1.0, 1, dt.datetime(2024, 1, 1, 0, 0, 5)), ("A", 3.0, 1.0, 2, dt.datetime(2024, 1, 1, 0, 0, 50)), ("A", 2.0, 1.0, 3, dt.datetime(2024, 1, 1, 0, 9))], "symbol string, price double, quantity double, trade_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, price double, quantity double, trade_id long, ts timestamp").parquet(str(tmp_path / "in"))
    query = live.bars(stream, "1 minute", "1 minute").writeStream.format("memory").queryName("live_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.open, r.close, r.trade_count) for r in spark.table("live_bars").collect()] == [(1.0, 3.0, 2)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_zero_and_flat_prices_give_nulls_not_errors(spark):
    prices = [0.0, 0.0, -1.0, 5.0, 5.0, 5.0, 5.0, 5.0, 0.0, 3.0]
    rows = [("a", "binance", p, 0.0, 1 - 2 * (i % 2), i, i * 1000) for i, p in enumerate(prices)]
    rows += [("b", "coinbase", p, 1.0, 1, i, i * 1000) for i, p in enumerate(prices)]
    ticks = spark.createDataFrame(rows, "symbol string, exchange string, price double, quantity double, side int, trade_id long, ts_ms long")
    bars = ticks.selectExpr("symbol", "ts_ms AS bar_start_ms", "price AS open", "price AS high", "price AS low", "price AS close", "quantity AS volume", "1L AS trade_count", "price * quantity AS turnover")
    frame = frames.last_rows(3, order=("bar_start_ms",))
    made = [
        filters.not_outlier(ticks, 3, 2.0), rolling.microstructure(ticks, 2), rolling.anomalies(ticks, 3), rolling.order_flow(ticks, 3), rolling.patterns(ticks, 0.1),
        rolling.alpha(bars, 3), rolling.drawdown(bars), rolling.candle_shapes(bars), rolling.stochastic(bars, 3, 2), bars.select(rolling.min_max("close", frame)), bars.select(frames.zscore("close", frame)),
        reports.risk(bars), reports.weekday_effect(bars), joins.correlations(bars), joins.arbitrage(joins.latest(ticks, "symbol", "exchange"), 1.0),
        reports.execution_quality(ticks.selectExpr("symbol", "side", "price AS executed_price", "0D AS arrival_price", "0D AS benchmark_price")),
    ]
    for found in made:
        found.collect()
    flat = filters.not_outlier(ticks.where("symbol = 'a' AND trade_id >= 3 AND trade_id <= 7"), 3, 2.0)
    assert flat.count() == 5


def test_quantiles_are_nearest_ranks(spark):
    rng = random.Random(4)
    values = {key: [rng.choice([None, 1.0, 2.0, rng.random() * 9]) for _ in range(n)] for key, n in (("x", 1), ("y", 2), ("z", 57))}
    values["x"] = [3.0]
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, v double")
    found = {r.k: (r.low, r.mid, r.top) for r in reports.quantiles(rows, "k", "v", {"low": 0.0, "mid": 0.5, "top": 1.0}).collect()}
    for key, own in values.items():
        own = sorted(v for v in own if v is not None)
        at = lambda share: own[int(share * (len(own) - 1) + 0.5)] if own else None  # noqa: B023, E731
        if own:
            assert found[key] == (own[0], at(0.5), own[-1])


def test_backruns_from_a_price_of_zero(spark):
    t = tick_rows(spark, [(p, 1, i) for i, p in enumerate([10, 0, 20, 15, 0, 0, 5, 4])])
    found = rolling.patterns(t, 0.5).orderBy("trade_id").collect()
    assert [(r.trade_id, str(r.up), r.after) for r in found] == [(2, "inf", 1), (5, "nan", 2), (6, "inf", 1)]


def test_doubles_are_scaled_before_they_are_rounded(spark):
    """As in DuckDB: 9.63 / 6.4 - 1 is 0.5046875, which times 10^6 is just below a half."""
    t = tick_rows(spark, [(p, 1, i) for i, p in enumerate([6.4, 9.63, 9.0, 6.4, 12.91, 12.0])])
    assert [r.up for r in catalog.rounded(rolling.patterns(t, 0.5)).orderBy("trade_id").collect()] == [0.504687, 1.017187]
    odd = spark.createDataFrame([(x,) for x in (None, float("nan"), float("inf"), float("-inf"), 1e305, -1e-9, -2.5e-6)], "x double")
    found = [r.x for r in catalog.rounded(odd).collect()]
    assert found[0] is None and math.isnan(found[1]) and found[2:] == [float("inf"), float("-inf"), 1e305, 0.0, -3e-6] and math.copysign(1, found[5]) == 1
    assert [r.x for r in catalog.rounded(spark.createDataFrame([(1.005,), (2.675,), (-1.005,)], "x double"), 2).collect()] == [1.0, 2.68, -1.0]


def test_microstructure_beside_a_price_of_zero(spark):
    t = tick_rows(spark, [(p, 2, i) for i, p in enumerate([4, 5, 4, 0, 4, 5, 5, 5, 5, 5])])
    found = {r.trade_id: r for r in rolling.microstructure(t, 3).collect()}
    assert found[2].amihud is None and found[4].amihud == found[5].amihud == found[6].amihud == float("inf")
    assert found[7].amihud == pytest.approx(math.log(5 / 4) / 2 / 3) and found[7].kyle_lambda != found[7].kyle_lambda
    assert found[9].bounce == 1.0 and found[9].amihud == 0.0


def test_frames_are_added_up_as_in_duckdb(spark):
    """Bit by bit against plain loops: rows before the first whole block, whole blocks, rows after them."""
    rng = random.Random(11)
    known = [(rng.choice([None, 1.5, 2.25, rng.random()]), rng.choice([None, 1.0, rng.random()])) for _ in range(150)]

    def covariance(s, y, x):
        n, mx, my, c = s
        dx, dy = x - mx, y - my
        my += dy / (n + 1)
        return n + 1, mx + dx / (n + 1), my, math.fma(dx, y - my, c)

    def joined(s, o):
        if not s[0] or not o[0]:
            return s if s[0] else o
        n = s[0] + o[0]
        return n, (o[0] * o[1] + s[0] * s[1]) / n, (o[0] * o[2] + s[0] * s[2]) / n, o[3] + s[3] + (s[1] - o[1]) * (s[2] - o[2]) * o[0] * s[0] / n

    def rows(s, since, until):
        for y, x in known[since:until]:
            s = covariance(s, y, x) if y is not None and x is not None else s
        return s

    has = framed.np.array([None not in pair for pair in known])
    y, x = (framed.np.array([pair[i] or 0.0 for pair in known]) for i in (0, 1))
    for n in (3, 16, 50):
        found = framed.over_frames(framed.COVARIANCE, has, (y, x), framed.np.arange(len(known) - n + 1), n)
        for i in range(len(known) - n + 1):
            begin, end = -(-i // 16), (i + n) // 16
            if i // 16 == end:
                wanted = rows((0, 0.0, 0.0, 0.0), i, i + n)
            else:
                wanted = rows((0, 0.0, 0.0, 0.0), i, begin * 16)
                for b in range(begin, end):
                    wanted = joined(wanted, rows((0, 0.0, 0.0, 0.0), b * 16, b * 16 + 16))
                wanted = rows(wanted, end * 16, i + n)
            assert tuple(f[i] for f in found) == wanted
    a, b, c = (framed.np.array([rng.uniform(-1, 1) * 2.0 ** rng.randint(-40, 40) for _ in range(20000)]) for _ in range(3))
    c[::2] = -(a * b)[::2] * (1 + framed.np.array([rng.choice([0, 1e-16, 1e-9]) for _ in range(10000)]))
    assert [math.fma(*p) for p in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)] == framed.fma(a, b, c).tolist()
    with framed.np.errstate(all="ignore"):
        assert framed.fma(*(framed.np.array([v]) for v in (math.inf, 1.0, 1.0))).tolist() == [math.inf]


def test_slopes_at_a_half_are_those_of_the_sql(spark, tmp_path):
    """Each event 60 times with ids of its own: prices stand still for 60 ticks, and many slopes lie at a half of the fourth digit."""
    duckdb = pytest.importorskip("duckdb")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 500")
    copies = events.crossJoin(spark.range(60).withColumnRenamed("id", "copy")).withColumn("event_id", F.col("event_id") + 1000 * F.col("copy"))
    copies.drop("copy").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows = {(r.symbol, r.trade_id): tuple(r)[2:] for r in catalog.microstructure(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = {r[:2]: r[2:] for r in c.sql(catalog.SQL["microstructure"]).fetchall()}
    assert len(wanted) == len(rows) == 30000
    plain = lambda values: repr([v if v is None else v + 0.0 for v in values])  # noqa: E731  NaN as itself, -0.0 as 0.0
    assert [k for k, v in wanted.items() if plain(v) != plain(rows[k])] == []


def test_trailing_intervals_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(-25, 60)]), rng.choice([None, 0.0, 1.5, 4.0])) for i in range(300)]
    frame = spark.createDataFrame(rows, "symbol string, trade_id long, ts_ms long, quantity double")
    out = rolling.trailing(frame, 10, {"n": ("count", "trade_id"), "total": ("sum", "quantity"), "low": ("min", "quantity"), "high": ("max", "quantity")})
    found = {r.trade_id: (r.n, r.total, r.low, r.high) for r in out.collect()}
    assert len(found) == len(rows)
    for symbol, i, t, _ in rows:
        seen = [(q, u) for s, _, u, q in rows if s == symbol and (u is None if t is None else u is not None and t - 10 <= u <= t)]
        known = [q for q, _ in seen if q is not None]
        assert found[i] == (len(seen), sum(known) if known else None, min(known, default=None), max(known, default=None))
    empty = rolling.trailing(frame.where("false"), 10, {"n": ("count", "trade_id")})
    assert empty.count() == 0


@pytest.mark.parametrize("name", ["participation_hourly", "trade_intensity"])
def test_intervals_are_not_summed_row_by_row(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "-3600000" not in plan and "windowspecdefinition(symbol" in plan and "period" in plan
