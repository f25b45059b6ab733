"""Queries over depth, clocks, boosts, bar ratios and estimators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import sessions
from ..functions.frames import ordered
from ..operators import analytics, book, depth, reports, signals
from ..sources import events
from .catalog import DELTAS, HOUR, NEW_YORK, deltas, hourly, query, rounded
from .measures import named
from .ticks import table, ticks

BAR = ("bar_start_ms",)

# Depth --------------------------------------------------------------------------------------------------------------


@query("{T}, " + DELTAS + """, h AS (SELECT symbol, max(CASE WHEN side = 'bid' THEN price END) AS bb, min(CASE WHEN side = 'ask' THEN price END) AS ba FROM l GROUP BY 1),
x AS (SELECT l.*, bb, ba, side = 'bid' AS b FROM l JOIN h USING (symbol)),
a AS (SELECT symbol, any_value(bb) AS bb, any_value(ba) AS ba, count(*) FILTER (b) AS nb, count(*) FILTER (NOT b) AS na, coalesce(sum(quantity) FILTER (b), 0) AS vb, coalesce(sum(quantity) FILTER (NOT b), 0) AS va,
  min(price) FILTER (b) AS wb, max(price) FILTER (NOT b) AS wa, count(*) FILTER (b AND price > 30) AS bids_above, count(*) FILTER (NOT b AND price < 30) AS asks_below,
  coalesce(sum(quantity) FILTER (b AND price >= bb - 5), 0) AS bid_within, coalesce(sum(quantity) FILTER (NOT b AND price <= ba + 5), 0) AS ask_within,
  coalesce(sum(quantity) FILTER (b AND price < 30), 0) AS bid_below, coalesce(sum(quantity) FILTER (NOT b AND price > 30), 0) AS ask_above,
  coalesce(sum(quantity) FILTER (b AND price >= bb * 0.9), 0) AS bid_depth_pct, coalesce(sum(quantity) FILTER (NOT b AND price <= ba * 1.1), 0) AS ask_depth_pct,
  sum(price * quantity) FILTER (price = 30) AS value_at, max(price) FILTER (b AND quantity >= 80) AS bid_wall, min(price) FILTER (NOT b AND quantity >= 80) AS ask_wall FROM x GROUP BY 1)
SELECT symbol, round((nb - na) / (nb + na), 6) AS count_imbalance, round(CASE WHEN vb > 0 THEN vb / nullif(va, 0) END, 6) AS volume_ratio, bids_above, asks_below, CASE WHEN nb >= 2 THEN bb - wb END AS bid_range, CASE WHEN na >= 2 THEN wa - ba END AS ask_range,
  ba - wb AS whole_range, round((ba - bb) / nullif((ba + bb) / 2, 0), 6) AS spread_share, round((ba - bb) / 0.5, 6) AS spread_steps, bid_within, ask_within, bid_below, ask_above, bid_depth_pct, ask_depth_pct, value_at, bid_wall, ask_wall,
  round(CASE WHEN nb >= 2 THEN nb / nullif(bb - wb, 0) END, 6) AS bid_density, round(CASE WHEN na >= 2 THEN na / nullif(wa - ba, 0) END, 6) AS ask_density FROM a""")
def book_depth_measures(spark, sf_dir):
    return rounded(depth.depth_measures(book.state(deltas(spark, sf_dir)), 30.0, 5.0, 10.0, 80.0, 0.5))


@query("{T}, " + DELTAS + """, w AS (SELECT *, greatest(least(quantity, 400 - (cumulative - quantity)), 0) AS taken FROM r),
g AS (SELECT symbol, side, sum(taken) AS filled, sum(price * taken) / nullif(sum(taken), 0) AS mean_price, sum(quantity) AS depth, arg_min(price, rank) AS best FROM w GROUP BY 1, 2), f AS (SELECT *, CASE WHEN depth >= 400 THEN mean_price END AS full_price FROM g)
SELECT symbol, side, filled, round(mean_price, 6) AS mean_price, round(full_price, 6) AS full_price, round(abs(full_price - best), 6) AS impact, round((best + coalesce(abs(full_price - best), 0)) * 400 * 5 / 10000, 6) AS fee FROM f""")
def book_walked(spark, sf_dir):
    return rounded(depth.walked(book.state(deltas(spark, sf_dir)), 400.0, 5.0))


@query("{T}, " + DELTAS + """ SELECT symbol, round(coalesce(sum(quantity) FILTER (side = 'bid'), 0) / nullif(sum(quantity) FILTER (side = 'ask'), 0), 6) AS depth_ratio FROM r WHERE rank <= 10 GROUP BY 1""")
def book_depth_ratio(spark, sf_dir):
    return rounded(depth.depth_ratio(book.state(deltas(spark, sf_dir)), 10))


@query("{T}, " + DELTAS + """ SELECT symbol, side, CAST(rank AS INTEGER) AS rank, price, cumulative, round(cumulative / sum(quantity) OVER (PARTITION BY symbol, side), 6) AS share FROM r WHERE rank <= 20""")
def book_depth_chart(spark, sf_dir):
    return rounded(depth.depth_chart(book.state(deltas(spark, sf_dir)), 20))


# Clocks -------------------------------------------------------------------------------------------------------------


def new_york_ticks(spark, sf_dir):
    """Ticks with their New York day, whether it is a trading day, and the next one; the calendar has 13,000 days."""
    days = sessions.with_next_trading_day(sessions.calendar(spark, 2000, 2035)).select("day", "is_trading_day", "next_day")
    return ticks(spark, sf_dir).withColumn("day", F.to_date(sessions.new_york(F.col("ts_ms")))).join(F.broadcast(days), "day")


@query("{T}, " + NEW_YORK + """, e AS (SELECT *, trading AND m >= 570 AND m < 960 AS o, trading AND NOT (m >= 570 AND m < 960) AND m >= 240 AND m < 1200 AS x, CASE WHEN trading AND m >= 570 AND m < 960 THEN ms - 34200000 END AS el FROM z)
SELECT trade_id, CASE WHEN o THEN 'open' WHEN x AND m < 570 THEN 'pre-market' WHEN x THEN 'after-hours' ELSE 'closed' END AS label, CAST(el AS BIGINT) AS time_in_session_ms, CAST(23400000 - el AS BIGINT) AS remaining_ms, round(el / 23400000, 6) AS progress,
  CASE WHEN el / 23400000 < 0.5 THEN 1 WHEN o THEN 2 ELSE 0 END AS half, x AND m < 570 AS is_pre_market, x AND m >= 960 AS is_after_hours, NOT o AND NOT x AND isodow(epoch_ms(ts_ms)) <= 5 AS is_overnight, coalesce(el / 23400000 BETWEEN 0.25 AND 0.75, false) AS is_mid_session,
  coalesce(el + 900000 >= 23400000, false) AS is_near_close, coalesce(el < 1800000, false) AS is_opening_range, coalesce(el >= 9000000 AND el < 12600000, false) AS is_lunch_hour, coalesce(el > 19800000, false) AS is_power_hour,
  coalesce(el <= 60000, false) AS is_opening_bell_minute, coalesce(el + 60000 >= 23400000, false) AS is_closing_bell_minute FROM e""")
def sessions_us_clock(spark, sf_dir):
    clock = sessions.us_equity_clock(F.col("ts_ms"), F.col("is_trading_day"), 15 * sessions.MINUTE_MS)
    return rounded(new_york_ticks(spark, sf_dir).select("trade_id", *named(clock)))


@query("{T}, " + NEW_YORK + """, e AS (SELECT *, CASE WHEN trading AND m < 570 THEN day ELSE next_day END AS d1, CASE WHEN trading AND m < 960 THEN day ELSE next_day END AS d2, CASE WHEN trading AND m < 1200 THEN day ELSE next_day END AS d3 FROM z),
f AS (SELECT trade_id, ts_ms, trading AND m >= 570 AND m < 960 AS o, epoch_ms((d1 + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York') AS o1, epoch_ms((d2 + INTERVAL 960 MINUTE) AT TIME ZONE 'America/New_York') AS c1, epoch_ms((d3 + INTERVAL 1200 MINUTE) AT TIME ZONE 'America/New_York') AS x1 FROM e)
SELECT trade_id, o1 AS next_open_ms, c1 AS next_close_ms, x1 AS next_extended_close_ms, CAST(CASE WHEN o THEN 0 ELSE (o1 - ts_ms) // 300000 END AS BIGINT) AS bars_until_open, round(CASE WHEN o THEN 0 ELSE (o1 - ts_ms) / 60000 END, 6) AS minutes_until_open FROM f""")
def sessions_us_next(spark, sf_dir):
    t = new_york_ticks(spark, sf_dir)
    t = t.select("trade_id", "ts_ms", sessions.us_equity_status(F.col("ts_ms"), ~F.col("is_trading_day")).alias("status"), *named(sessions.us_equity_next(F.col("ts_ms"), F.col("is_trading_day"), F.col("next_day"))))
    wait = F.when(F.col("status") == "Open", 0).otherwise(F.col("next_open_ms") - F.col("ts_ms"))
    return t.select("trade_id", "next_open_ms", "next_close_ms", "next_extended_close_ms", F.floor(wait / 300_000).alias("bars_until_open"), (F.round(wait / 60_000, 6) + 0.0).alias("minutes_until_open"))


@query("""{T}, h(exchange_of, opens, closes) AS (VALUES ('NYSE', 870, 1260), ('LSE', 480, 990), ('CRYPTO', 0, 1439)), x AS (SELECT trade_id, ts_ms, exchange_of, opens, closes, ts_ms // 60000 % 1440 AS m, ts_ms - ts_ms % 86400000 AS day FROM t, h), y AS (SELECT *, m >= opens AND m < closes AS o, day + opens * 60000 AS op FROM x)
SELECT exchange_of AS exchange, trade_id, o AS is_open, CAST(CASE WHEN o THEN ts_ms WHEN op > ts_ms THEN op ELSE op + 86400000 END AS BIGINT) AS next_open_ms, CAST(CASE WHEN o THEN day + closes * 60000 - ts_ms END AS BIGINT) AS until_close_ms FROM y""")
def sessions_fixed_hours(spark, sf_dir):
    t = ticks(spark, sf_dir).select("trade_id", "ts_ms")
    each = [t.select(F.lit(name).alias("exchange"), "trade_id", *named(sessions.fixed_hours(F.col("ts_ms"), *hours))) for name, hours in sessions.FIXED_HOURS.items()]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT day, month(day) AS m, dayofmonth(day) AS n, isodow(day) AS w FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, dayname(day) AS weekday, n >= 22 AS is_expiry_week, m IN (1, 3, 5, 7, 9, 11) AND n >= 18 AS is_quiet_window,
  (m = 12 AND n IN (24, 26, 31)) OR (m = 1 AND n = 2) OR (m = 7 AND n IN (3, 5)) OR (m = 11 AND w = 5 AND n BETWEEN 23 AND 29) AS is_beside_holiday,
  (SELECT count(*) FROM generate_series(day, day + INTERVAL 45 DAY, INTERVAL 1 DAY) s(x) WHERE isodow(x) <= 5) AS weekdays FROM e""")
def calendar_more_flags(spark, sf_dir):
    day = F.col("day")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(day.cast("string").alias("day"), *named(sessions.date_flags(day)), sessions.weekdays_between(day, F.date_add(day, 45)).cast("long").alias("weekdays"))


# Boosts, ticks and bars -----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 99) / 1e2 AS b, (p_partkey % 7) / 1e1 AS o, 1e0 + p_size AS m, 1e0 + p_partkey % 13 AS t, 1e0 + p_partkey % 17 AS x FROM part), q AS (SELECT *, 1 / sqrt(1 - b * b) AS g, t * t - x * x AS s, x / sqrt(x * x + t * t) AS c FROM p)
SELECT p_partkey, round((b + o) / (1 + b * o), 6) AS composed, round(tanh(2 * atanh(b) + atanh(o)), 6) AS chained, round(tanh(b + o), 6) AS of_rapidity, round(g * t, 6) AS dilated, round(x / g, 6) AS contracted, round(g * x, 6) AS stretched, round(t / g, 6) AS proper_time,
  round(g * m, 6) AS energy, round((g - 1) * m, 6) AS kinetic, round(g * b * m, 6) AS momentum, round(m * m, 6) AS invariant, round(CASE WHEN s >= 0 THEN sqrt(s) END, 6) AS mass, round(t / (g ** 3 * m), 6) AS acceleration, round(s, 6) AS interval, round(sqrt(abs(s)), 6) AS distance,
  CASE WHEN s > 1e-12 THEN 'timelike' WHEN s < -1e-12 THEN 'spacelike' ELSE 'lightlike' END AS cone, round((c - b) / (1 - b * c), 6) + 0.0 AS aberration, round(acos(greatest(least((c + b) / (1 + b * c), 1), -1)), 6) AS aberration_angle FROM q""")
def measures_boost_algebra(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return rounded(p.select("p_partkey", *named(M.boost_algebra((key % 99) / F.lit(100.0), (key % 7) / F.lit(10.0), F.lit(1.0) + F.col("p_size"), F.lit(1.0) + key % 13, F.lit(1.0) + key % 17))))


@query("""{T}, x AS (SELECT *, CASE WHEN trade_id % 5 > 0 THEN ts_ms - trade_id % 90 END AS sent FROM t) SELECT trade_id, ts_ms >= 1704207000000 AND ts_ms < 1704230400000 AS in_session, sent IS NOT NULL AS has_exchange_ts, ts_ms - sent AS latency_ms FROM x""")
def measures_tick_times(spark, sf_dir):
    sent = F.when(F.col("trade_id") % 5 > 0, F.col("ts_ms") - F.col("trade_id") % 90)
    out = ticks(spark, sf_dir).select("trade_id", sent.alias("sent"), *named(M.tick_times(1704207000000, 1704230400000, sent)))
    return out.select("trade_id", "in_session", "has_exchange_ts", F.when(F.col("sent").isNotNull(), F.col("latency_ms")).alias("latency_ms"))


@query("""{B}, x AS (SELECT *, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))
SELECT symbol, bar_start_ms, high > greatest(open, close) AS has_upper_wick, low < least(open, close) AS has_lower_wick, round(volume * close, 4) AS volume_notional, round(volume / 200, 6) AS relative_volume, round(high / nullif(close, 0), 6) AS high_close_ratio, round(open / nullif(close, 0), 6) AS open_close_ratio,
  round((close - low) / nullif(high - low, 0), 6) AS close_to_low_ratio, round((high - low) / nullif(open, 0) * 100, 4) AS height_pct, high - low > 50 AS is_wide, greatest(open, close) > greatest(po, pc) AND least(open, close) < least(po, pc) AS is_engulfing, pc < po AND close > open AND open < pc AND close > po AS is_bullish_engulfing,
  (pc > po AND open > pc AND close < open) OR (pc < po AND open < pc AND close > open) AS is_intraday_reversal, round(greatest(least(high, ph) - greatest(low, pl), 0), 6) AS range_overlap FROM x WHERE pc IS NOT NULL""")
def measures_bar_ratios(spark, sf_dir):
    by = ordered(order=BAR)
    out = hourly(spark, sf_dir).select("symbol", *BAR, F.lag("close").over(by).alias("pc"), *named(M.bar_ratios(by, 200.0, 50.0))).where("pc IS NOT NULL").drop("pc")
    return rounded(out.withColumns({"volume_notional": F.round("volume_notional", 4), "height_pct": F.round("height_pct", 4)}))


# Estimators -----------------------------------------------------------------------------------------------------------


@query("""{T}, c AS (SELECT symbol, ts_ms, trade_id, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS ch FROM t), d AS (SELECT symbol, ch, lag(ch) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS be FROM c)
SELECT symbol, round(CASE WHEN covar_pop(ch, be) < 0 THEN 2 * sqrt(-covar_pop(ch, be)) END, 4) AS spread, count(*) AS n FROM d WHERE be IS NOT NULL GROUP BY 1""")
def spread_roll(spark, sf_dir):
    return rounded(signals.roll_spread(ticks(spark, sf_dir)), 4)


@query("""{B}, x AS (SELECT symbol, high, low, lag(high) OVER w AS h, lag(low) OVER w AS l FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms)), y AS (SELECT symbol, avg(ln(high / low) ** 2 + ln(h / l) ** 2) AS be, avg(ln(greatest(high, h) / least(low, l)) ** 2) AS ga FROM x WHERE h IS NOT NULL GROUP BY 1),
k AS (SELECT symbol, (sqrt(2 * be) - sqrt(be)) / (3 - 2 * sqrt(2)) - sqrt(ga / (3 - 2 * sqrt(2))) AS al FROM y), g AS (SELECT symbol, min(low) > 0 AS good FROM b GROUP BY 1) SELECT symbol, round(CASE WHEN good THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) END, 6) AS spread FROM k JOIN g USING (symbol)""")
def spread_high_low(spark, sf_dir):
    return rounded(signals.high_low_spread(hourly(spark, sf_dir)))


@query("""{B}, p AS (SELECT x.symbol AS a, y.symbol AS b, x.bar_start_ms, y.close - x.close AS value FROM b x JOIN b y ON x.bar_start_ms = y.bar_start_ms AND x.symbol < y.symbol), l AS (SELECT a, b, value, lag(value) OVER (PARTITION BY a, b ORDER BY bar_start_ms) AS be FROM p),
s AS (SELECT a, b, regr_slope(value - be, be) AS k, regr_sxx(value - be, be) AS sxx, regr_syy(value - be, be) AS syy, count(*) AS n FROM l WHERE be IS NOT NULL GROUP BY 1, 2)
SELECT a, b, round(k, 5) AS slope, round(k / sqrt((syy - k * k * sxx) / (n - 2) / sxx), 4) AS t, round(CASE WHEN k < 0 THEN -ln(2) / k END, 5) AS half_life, n FROM s""")
def pairs_mean_reversion(spark, sf_dir):
    b = hourly(spark, sf_dir)
    x, y = b.select(*BAR, F.col("symbol").alias("a"), F.col("close").alias("x")), b.select(*BAR, F.col("symbol").alias("b"), F.col("close").alias("y"))
    out = signals.mean_reversion(x.join(y, BAR[0]).where("a < b").withColumn("value", F.col("y") - F.col("x")), "a", "b")
    return out.select("a", "b", F.round("slope", 5).alias("slope"), F.round("t", 4).alias("t"), F.round("half_life", 5).alias("half_life"), "n")


@query("""{B}, r AS (SELECT symbol, bar_start_ms, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_start_ms)) AS ret FROM b), m AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS de FROM r WHERE ret IS NOT NULL),
o AS (SELECT symbol, ret, sum(de) OVER (PARTITION BY symbol ORDER BY bar_start_ms ROWS UNBOUNDED PRECEDING) AS off FROM m) SELECT symbol, round(greatest(least(ln((max(off) - min(off)) / stddev_pop(ret)) / ln(count(*)), 1), 0), 6) AS hurst, count(*) AS n FROM o GROUP BY 1""")
def regime_hurst(spark, sf_dir):
    return rounded(signals.hurst(hourly(spark, sf_dir)))


@query("""{T}, v AS (SELECT symbol, ts_ms // 3600000 AS h, sum(CASE WHEN side > 0 THEN quantity ELSE 0 END) AS bu, sum(CASE WHEN side < 0 THEN quantity ELSE 0 END) AS se FROM t GROUP BY 1, 2), m AS (SELECT symbol, avg(bu) AS b, avg(se) AS s, abs(avg(bu) - avg(se)) AS mu FROM v GROUP BY 1), a AS (SELECT *, mu / (b + s + mu) AS al FROM m)
SELECT symbol, round(al * mu / (al * mu + b + s), 6) AS pin, round(al, 6) AS alpha, round(CASE WHEN b > s THEN 0.5 + 0.5 * al ELSE 0.5 - 0.5 * al END, 6) AS delta, round(mu, 6) AS mu FROM a""")
def flow_informed_trading(spark, sf_dir):
    buy = F.col("side") > 0
    periods = ticks(spark, sf_dir).groupBy("symbol", F.floor(F.col("ts_ms") / HOUR).alias("hour")).agg(F.sum(F.when(buy, F.col("quantity")).otherwise(0.0)).alias("bought"), F.sum(F.when(~buy, F.col("quantity")).otherwise(0.0)).alias("sold"))
    return rounded(signals.informed_trading(periods))


@query("""{T}, x AS (SELECT symbol, trade_id, price, lead(price) OVER w AS peak, [lead(price, 2) OVER w, lead(price, 3) OVER w, lead(price, 4) OVER w] AS later FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)), y AS (SELECT *, list_filter(later, lambda p: p IS NOT NULL AND (peak - p) / peak >= 0.2)[1] AS after FROM x WHERE price > 0 AND peak > 0)
SELECT symbol, trade_id, peak, after FROM y WHERE (peak - price) / price >= 0.2 AND after IS NOT NULL""")
def ticks_sandwiches(spark, sf_dir):
    return signals.sandwiches(ticks(spark, sf_dir), 3, 0.2)


@query("""{T}, x AS (SELECT symbol, trade_id, price, quantity, lead(price) OVER w AS p, lead(quantity) OVER w AS q FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id))
SELECT symbol, trade_id, round(q / quantity, 6) AS share, round(greatest(least(least(q / quantity, 20) / 20, 0.9), 0.1), 6) AS confidence FROM x WHERE price != 0 AND p != 0 AND quantity != 0 AND abs(price - p) / p <= 0.05 AND q >= 3 * quantity""")
def ticks_front_runs(spark, sf_dir):
    return rounded(signals.front_runs(ticks(spark, sf_dir), 0.05, 3.0))


ZSCORES = """{B}, s AS (SELECT symbol, bar_start_ms, close / nullif(lag(close) OVER w, 0) - 1 AS signal, lead(close) OVER w / nullif(close, 0) - 1 AS forward FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms)), d AS (SELECT *, stddev_pop(signal) OVER c AS sd, avg(signal) OVER c AS mn FROM s WHERE signal IS NOT NULL WINDOW c AS (PARTITION BY bar_start_ms)), z AS (SELECT *, CASE WHEN sd < 1e-12 THEN 0 ELSE (signal - mn) / sd END AS z FROM d)"""


@query(ZSCORES + " SELECT symbol, bar_start_ms, round(signal, 4) + 0.0 AS signal, round(forward, 4) + 0.0 AS forward, round(z, 4) + 0.0 AS z FROM z")
def signals_cross_section(spark, sf_dir):
    return rounded(signals.cross_section(hourly(spark, sf_dir), 1), 4)


@query(ZSCORES + " SELECT symbol, round(corr(z, forward), 5) AS ic, round(avg(CASE WHEN sign(z) = sign(forward) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM z WHERE forward IS NOT NULL GROUP BY 1")
def signals_information_coefficient(spark, sf_dir):
    out = signals.information_coefficient(signals.cross_section(hourly(spark, sf_dir), 1))
    return out.select("symbol", F.round("ic", 5).alias("ic"), F.round("hit_rate", 6).alias("hit_rate"), "n")


@query("""WITH o AS (SELECT o_orderkey AS order_id, o_totalprice / 100 AS q, 1e5 + o_custkey AS adv, 0.01 + o_custkey % 9 / 100.0 AS vol, 1.0 + o_orderkey % 5 AS sp FROM orders), s AS (SELECT *, q / adv AS p FROM o)
SELECT order_id, round(p, 6) AS participation, sp / 2 AS spread_cost, round(0.1 * p * vol * 1e4, 4) AS linear, round(0.1 * sqrt(p) * vol * 1e4, 4) AS square_root, round(vol * sqrt(p) * 1e4, 4) AS invariant, round(0.2 * p * 1e4, 4) AS permanent, round(sqrt(p * 0.5 / 0.1), 6) AS horizon FROM s""")
def execution_slippage_models(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    found = signals.slippage(F.col("o_totalprice") / 100, F.lit(1e5) + F.col("o_custkey"), F.lit(0.01) + F.col("o_custkey") % 9 / F.lit(100.0), F.lit(1.0) + F.col("o_orderkey") % 5, 0.5)
    four = ("linear", "square_root", "invariant", "permanent")
    return rounded(o.select(F.col("o_orderkey").alias("order_id"), *((F.round(c, 4) if name in four else c).alias(name) for name, c in found.items())))


SLICES = "WITH o AS (SELECT o_orderkey AS order_id, o_totalprice AS q FROM orders)"


@query(SLICES + " SELECT order_id, CAST(i AS INTEGER) AS slice, q / 8 AS quantity FROM o, range(8) r(i)")
def execution_equal_slices(spark, sf_dir):
    return signals.equal_slices(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("quantity")), 8)


@query(SLICES + ", p(slice, share) AS (VALUES (0, 0.5), (1, 0.125), (2, 0.125), (3, 0.25)) SELECT order_id, slice, q * CAST(share AS DOUBLE) AS quantity FROM o, p")
def execution_profile_slices(spark, sf_dir):
    return signals.profile_slices(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("quantity")), [4.0, 1.0, 1.0, 2.0])


@query("""{T}, g AS (SELECT symbol, exchange, sum(side * quantity) AS net, sum(CASE WHEN side > 0 THEN price * quantity END) / nullif(sum(CASE WHEN side > 0 THEN quantity END), 0) AS cost, arg_max(price, row(ts_ms, trade_id)) AS mark FROM t GROUP BY 1, 2), m AS (SELECT *, sign(net) * (mark - cost) / nullif(cost, 0) AS moved FROM g)
SELECT symbol, exchange, round(moved * 100, 4) + 0.0 AS pnl_pct, coalesce(moved <= -0.1, false) AS is_stopped_out, coalesce(moved >= 0.2, false) AS is_take_profit FROM m""")
def positions_stops(spark, sf_dir):
    out = signals.stops(analytics.open_positions(ticks(spark, sf_dir), "symbol", "exchange"), 0.1, 0.2)
    return rounded(out.select("symbol", "exchange", "pnl_pct", "is_stopped_out", "is_take_profit"), 4)


@query("""{T}, n AS (SELECT max(ts_ms) AS now FROM t), f AS (SELECT exchange AS feed_id, max(ts_ms) AS last_ms, count(*) AS n, max(now) - max(ts_ms) AS age_ms FROM t, n GROUP BY 1)
SELECT count(*) FILTER (age_ms <= 60000) AS healthy, count(*) FILTER (age_ms > 60000) AS stale, CAST(0 AS BIGINT) AS unknown, round(count(*) FILTER (age_ms > 60000) / count(*), 6) AS stale_ratio_known, round(count(*) FILTER (age_ms <= 60000) / count(*), 6) AS healthy_ratio, round(avg(age_ms), 4) AS mean_age_ms, max(age_ms) AS oldest_age_ms,
  min(age_ms) FILTER (age_ms <= 60000) AS least_healthy_age_ms, arg_min(feed_id, row(last_ms, feed_id)) AS most_stale, arg_min(feed_id, row(last_ms, feed_id)) FILTER (age_ms > 60000) AS oldest_stale, arg_max(feed_id, row(n, feed_id)) AS most_ticks, arg_max(feed_id, row(last_ms, feed_id)) AS last_updated,
  count(*) FILTER (age_ms <= 60000) > 0 AND count(*) FILTER (age_ms <= 60000) < count(*) AS is_degraded FROM f""")
def feed_health_summary(spark, sf_dir):
    t = ticks(spark, sf_dir)
    now = t.agg(F.max("ts_ms")).first()[0]  # one number
    out = signals.health_summary(reports.feed_health(t.withColumnRenamed("exchange", "feed_id"), now or 0, 60_000))
    return rounded(out.withColumn("mean_age_ms", F.round("mean_age_ms", 4)))


# Events of feeds --------------------------------------------------------------------------------------------------------


@query("""{T}, k AS (SELECT *, trade_id % 6 AS k FROM t) SELECT trade_id, CASE k WHEN 0 THEN 'trade' WHEN 1 THEN 'quote' WHEN 2 THEN 'bar' WHEN 3 THEN 'book' WHEN 4 THEN 'status' END AS kind, CASE WHEN k < 5 THEN symbol END AS symbol,
  CASE k WHEN 0 THEN ts_ms * 1000 WHEN 1 THEN ts_ms * 1000000 WHEN 2 THEN (ts_ms // 1000) * 1000000 WHEN 5 THEN NULL ELSE 0 END AS timestamp_ns, CASE WHEN k = 0 THEN price END AS price, CASE WHEN k = 0 THEN quantity END AS size, CASE WHEN k = 0 THEN CASE WHEN side > 0 THEN 'buy' ELSE 'sell' END END AS side,
  CASE WHEN k = 1 THEN price END AS bid, CASE WHEN k = 1 THEN price + 1 END AS ask, CASE WHEN k = 1 THEN quantity END AS bid_size, CASE WHEN k = 1 THEN CAST(0 AS DOUBLE) END AS ask_size, CASE WHEN k = 2 THEN price END AS close, CASE WHEN k = 2 THEN 60 END AS period_secs,
  CASE WHEN k = 3 THEN price END AS best_bid, CASE WHEN k = 3 THEN 2 END AS n_asks, CASE WHEN k = 3 THEN trade_id END AS sequence, CASE WHEN k = 3 THEN true END AS is_snapshot, CASE WHEN k = 4 THEN 'throttled' END AS status, CASE WHEN k = 4 THEN 'Rate_Limited' END AS message FROM k""")
def sources_json_events(spark, sf_dir):
    """Payloads of five kinds, and text that is none, built from the ticks and parsed."""
    c = F.col
    pair = lambda p: F.array(c(p) if p == "price" else c("price") + 1, c("quantity"))
    payloads = [
        F.struct(F.lit("trade").alias("type"), c("symbol").alias("sym"), c("price").cast("string").alias("p"), c("quantity").alias("q"), F.when(c("side") > 0, "BUY").otherwise("s").alias("taker_side"), c("ts_ms").alias("timestamp")),
        F.struct(c("symbol").alias("product_id"), c("price").alias("bid"), (c("price") + 1).alias("ask"), c("quantity").alias("bs"), (c("ts_ms") * 1_000_000).alias("ts_ns")),
        F.struct(F.lit("bar").alias("type"), c("symbol").alias("ticker"), *(c("price").alias(x) for x in "ohlc"), F.floor(c("ts_ms") / 1000).alias("time")),
        F.struct(c("symbol"), F.array(pair("price")).alias("bids"), F.array(pair("ask"), pair("ask")).alias("asks"), c("trade_id").alias("seq"), F.lit(True).alias("snapshot")),
        F.struct(F.lit("Rate_Limited").alias("status"), c("symbol").alias("s")),
    ]
    payload = F.lit("no payload")
    for k, fields in enumerate(payloads):
        payload = F.when(c("trade_id") % 6 == k, F.to_json(fields)).otherwise(payload)
    out = events.parse_events(ticks(spark, sf_dir).select("trade_id", payload.alias("payload")))
    return out.select(
        "trade_id", "kind", "symbol", "timestamp_ns", *("trade." + x for x in ("price", "size", "side")), *("quote." + x for x in ("bid", "ask", "bid_size", "ask_size")), "bar.close", "bar.period_secs",
        F.get("book.bids", 0).price.alias("best_bid"), F.when(c("book").isNotNull(), F.size("book.asks")).alias("n_asks"), "book.sequence", "book.is_snapshot", "status.status", "status.message",
    )


@query("""{T}, b AS (SELECT trade_id, symbol, quantity, '35=D' || chr(1) || '34=' || trade_id || chr(1) || '38=' || CAST(quantity AS BIGINT) || chr(1) || '55=' || symbol || chr(1) AS body FROM t), f AS (SELECT *, '8=FIX.4.2' || chr(1) || '9=' || length(body) || chr(1) || body AS framed FROM b)
SELECT trade_id, 'D' AS msg_type, symbol, CAST(quantity AS BIGINT) AS quantity, lpad(CAST(CAST(list_sum(list_transform(string_split(framed, ''), lambda c: ord(c))) AS BIGINT) % 256 AS VARCHAR), 3, '0') AS checksum, CASE WHEN trade_id % 7 = 0 THEN 'the checksum is wrong' END AS error FROM f""")
def sources_fix_messages(spark, sf_dir):
    """Messages written from the ticks, one in seven damaged, and parsed."""
    fields = F.create_map(F.lit(55), F.col("symbol"), F.lit(38), F.col("quantity").cast("long").cast("string"), F.lit(34), F.col("trade_id").cast("string"))
    sent = ticks(spark, sf_dir).select("trade_id", events.fix_message(F.lit("D"), fields).alias("message"))
    sent = sent.withColumn("message", F.when(F.col("trade_id") % 7 == 0, F.replace("message", F.lit("FIX.4.2\x01"), F.lit("FIX.4.2\x01\x01"))).otherwise(F.col("message")))
    out = events.parse_fix(sent)
    value = lambda tag: events.fix_value(F.col("fields"), tag)
    return out.select("trade_id", "msg_type", value(55).alias("symbol"), value(38).cast("long").alias("quantity"), value(10).alias("checksum"), "error")
