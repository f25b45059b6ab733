"""Queries over the analytics, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import ordered
from ..operators import analytics as A
from ..operators import joins, reports
from .catalog import HOUR, hourly, query, rounded
from .ticks import ticks

RET = "{B}, r AS (SELECT symbol, bar_start_ms, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_start_ms)) AS ret FROM b)"


@query(RET + """, m AS (SELECT symbol, bar_start_ms, close / lag(close, 10) OVER w - 1 AS momentum,
  stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY bar_start_ms ROWS 9 PRECEDING) AS vol FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))
SELECT symbol, bar_start_ms, round(momentum, 4) AS momentum, round(vol, 4) AS vol, round(momentum / nullif(vol, 0), 3) AS adjusted,
  rank() OVER (PARTITION BY bar_start_ms ORDER BY momentum DESC, symbol) AS place FROM m WHERE momentum IS NOT NULL""")
def alpha_momentum_ranked(spark, sf_dir):
    out = A.momentum(hourly(spark, sf_dir), 10)
    return out.select("symbol", "bar_start_ms", F.round("momentum", 4).alias("momentum"), F.round("vol", 4).alias("vol"), F.round("adjusted", 3).alias("adjusted"), F.col("place").cast("long"))


@query(RET + """, v AS (SELECT symbol, bar_start_ms, stddev_pop(ret) OVER w AS vol FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 19 PRECEDING))
SELECT symbol, bar_start_ms, round(vol, 4) AS vol, round(stddev_pop(vol) OVER (PARTITION BY symbol ORDER BY bar_start_ms ROWS 19 PRECEDING), 4) AS vol_of_vol FROM v""")
def volatility_of_volatility(spark, sf_dir):
    return rounded(A.vol_of_vol(hourly(spark, sf_dir), 20), 4)


@query(RET + """, l AS (SELECT *, ln(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY bar_start_ms)) AS long FROM r)
SELECT symbol, round(var_pop(long) / nullif(5 * var_pop(ret), 0), 4) AS ratio, count(long) AS n FROM l GROUP BY 1""")
def variance_ratio(spark, sf_dir):
    return rounded(A.variance_ratio(hourly(spark, sf_dir), 5), 4)


@query("""{B} SELECT x.symbol AS a, y.symbol AS b, round(regr_slope(y.close, x.close), 4) AS slope, round(regr_intercept(y.close, x.close), 3) AS intercept,
  round(regr_r2(y.close, x.close), 4) AS r2, count(*) AS n FROM b x JOIN b y ON x.bar_start_ms = y.bar_start_ms AND x.symbol < y.symbol GROUP BY 1, 2""")
def pairs_hedge_ratio(spark, sf_dir):
    out = A.hedge(hourly(spark, sf_dir))
    return out.select("a", "b", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 4).alias("r2"), "n")


@query("""{T}, x AS (SELECT symbol, trade_id, side, price, (price + lag(price) OVER w) / 2 AS mid, lead(price, 5) OVER w AS later FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id))
SELECT symbol, trade_id, round(2 * abs(price - mid), 4) AS effective, round(2 * side * (price - later), 4) + 0.0 AS realised, round(2 * side * (later - mid), 4) + 0.0 AS impact, 2 * abs(price - mid) > 20 AS is_wide FROM x""")
def spread_components(spark, sf_dir):
    out = A.spreads(ticks(spark, sf_dir), 10.0, 5)
    return out.select("symbol", "trade_id", F.round("effective", 4).alias("effective"), (F.round("realised", 4) + 0.0).alias("realised"), (F.round("impact", 4) + 0.0).alias("impact"), "is_wide")


@query("""{T} SELECT symbol, trade_id, round(((price - 1) * (quantity + 1) + (price + 1) * (101 - quantity)) / (102), 4) AS micro FROM t""")
def micro_prices(spark, sf_dir):
    price, quantity = F.col("price"), F.col("quantity")
    return rounded(ticks(spark, sf_dir).select("symbol", "trade_id", A.micro_price(price - 1, price + 1, 101 - quantity, quantity + 1).alias("micro")), 4)


@query("""{T}, c AS (SELECT *, sum(quantity) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) - quantity AS before FROM t),
d AS (SELECT symbol, CAST(floor(before / 1000) AS BIGINT) AS bucket, sum(side * quantity) AS net, sum(quantity) AS total FROM c GROUP BY 1, 2), s AS (SELECT symbol, bucket, abs(net) / nullif(total, 0) AS share FROM d)
SELECT symbol, bucket, round(share, 6) AS share, round(avg(share) OVER (PARTITION BY symbol ORDER BY bucket ROWS 9 PRECEDING), 6) AS toxicity FROM s""")
def flow_toxicity(spark, sf_dir):
    return rounded(A.toxicity(ticks(spark, sf_dir), 1000.0, 10))


@query("""{T}, l AS (SELECT symbol, side, CAST(floor(price / 10) AS BIGINT) AS level, sum(quantity) AS depth, count(*) AS n FROM t GROUP BY 1, 2, 3)
SELECT symbol, side, level, round(depth, 4) AS depth, n, depth > 2 * avg(depth) OVER (PARTITION BY symbol, side) AS is_wall FROM l""")
def book_walls(spark, sf_dir):
    return rounded(A.levels(ticks(spark, sf_dir), 10.0, 2.0), 4)


@query("""{T}, l AS (SELECT symbol, arg_max(price, row(ts_ms, trade_id)) AS last FROM t GROUP BY 1)
SELECT t.symbol, side, round(sum(CASE WHEN abs(price - last) <= 0.1 * last THEN quantity ELSE 0 END), 4) AS within, round(sum(CASE WHEN abs(price - last) <= 0.1 * last THEN 0 ELSE quantity END), 4) AS beyond FROM t JOIN l ON t.symbol = l.symbol GROUP BY 1, 2""")
def depth_near_last(spark, sf_dir):
    return rounded(A.depth_within(ticks(spark, sf_dir), 0.1), 4)


@query("""{T}, p AS (SELECT symbol, exchange, sum(side * quantity) AS net, sum(price * quantity) FILTER (side > 0) / nullif(sum(quantity) FILTER (side > 0), 0) AS cost, arg_max(price, row(ts_ms, trade_id)) AS mark FROM t GROUP BY 1, 2)
SELECT symbol, exchange, round(net, 4) AS net, round(cost, 4) AS cost, round(mark, 4) AS mark, round(net * (mark - cost), 2) AS unrealised FROM p""")
def positions_unrealised(spark, sf_dir):
    out = A.open_positions(ticks(spark, sf_dir), "symbol", "exchange")
    return out.select("symbol", "exchange", F.round("net", 4).alias("net"), F.round("cost", 4).alias("cost"), F.round("mark", 4).alias("mark"), F.round("unrealised", 2).alias("unrealised"))


@query("""{T}, h AS (SELECT symbol, (ts_ms // 3600000) % 24 AS hour, sum(quantity) AS volume FROM t GROUP BY 1, 2), s AS (SELECT symbol, hour, 10000 * volume / nullif(sum(volume) OVER (PARTITION BY symbol), 0) AS slice FROM h)
SELECT symbol, hour, round(slice, 4) AS slice, round(sum(slice) OVER (PARTITION BY symbol ORDER BY hour), 4) AS done FROM s""")
def schedule_by_volume(spark, sf_dir):
    return rounded(A.volume_schedule(ticks(spark, sf_dir), 10_000.0), 4)


@query("""{T} SELECT symbol, trade_id, round(quantity / nullif(sum(quantity) OVER w, 0), 6) AS share, round(max(price) OVER w - min(price) OVER w, 4) AS span, round(avg(quantity) OVER w, 4) AS mean_quantity
FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)""")
def participation_hourly(spark, sf_dir):
    out = A.participation(ticks(spark, sf_dir), HOUR)
    share = F.round(F.col("share") * 1e6) / 1e6  # halves as DuckDB rounds them
    return out.select("symbol", "trade_id", share.alias("share"), F.round("span", 4).alias("span"), F.round("mean_quantity", 4).alias("mean_quantity"))


@query("""{T}, v AS (SELECT symbol, exchange, avg(price) AS price, sum(quantity) AS volume, count(*) AS n FROM t GROUP BY 1, 2)
SELECT symbol, exchange, round(price, 4) AS price, round(volume, 4) AS volume, n, round(volume / nullif(sum(volume) OVER (PARTITION BY symbol), 0), 6) AS share, rank() OVER (PARTITION BY symbol ORDER BY volume DESC, exchange) AS place FROM v""")
def venue_comparison(spark, sf_dir):
    out = A.venues(ticks(spark, sf_dir))
    return out.select("symbol", "exchange", F.round("price", 4).alias("price"), F.round("volume", 4).alias("volume"), "n", F.round("share", 6).alias("share"), F.col("place").cast("long"))


@query("""{T}, l AS (SELECT symbol, avg(price) AS price FROM t GROUP BY 1), p AS (SELECT x.symbol, y.symbol AS other, round(x.price / y.price, 3) AS price FROM l x JOIN l y ON x.symbol <> y.symbol)
SELECT f.symbol AS a, f.other AS b, s.other AS c, round(f.price * s.price * h.price * 0.9995 * 0.9995 * 0.9995, 6) AS "left", f.price * s.price * h.price * 0.9995 * 0.9995 * 0.9995 > 1 AS is_gain
FROM p f JOIN p s ON f.other = s.symbol JOIN p h ON s.other = h.symbol AND h.other = f.symbol WHERE f.symbol < f.other AND f.symbol < s.other AND f.other <> s.other""")
def arbitrage_triangular(spark, sf_dir):
    mean = ticks(spark, sf_dir).groupBy("symbol").agg(F.avg("price").alias("price"))
    other = mean.select(F.col("symbol").alias("other"), F.col("price").alias("of_other"))
    rates = mean.join(other, mean.symbol != other.other).select("symbol", "other", F.round(F.try_divide("price", "of_other"), 3).alias("price"))
    return rounded(A.triangles(rates, 0.0005))


@query(RET + """, o AS (SELECT * FROM r WHERE ret IS NOT NULL), p AS (SELECT x.symbol, y.symbol AS other, 0.04 * covar_pop(x.ret, y.ret) AS part FROM o x JOIN o y ON x.bar_start_ms = y.bar_start_ms GROUP BY 1, 2)
SELECT round(sum(part), 6) AS variance, round(1.645 * sqrt(greatest(sum(part), 0)), 6) AS value_at_risk FROM p""")
def portfolio_value_at_risk(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return rounded(A.portfolio_variance(bars, bars.select("symbol").distinct().withColumn("weight", F.lit(0.2)), 1.645))


@query("""{T}, f AS (SELECT symbol, avg((price - 100) / 10000) AS mean, arg_max((price - 100) / 10000, row(ts_ms, trade_id)) AS last, count(*) AS n FROM t GROUP BY 1)
SELECT symbol, round(mean, 6) AS mean, round(last, 6) AS last, n, round(mean * 1095, 4) AS annual, last > mean AS is_rising FROM f""")
def funding_rates(spark, sf_dir):
    out = A.funding(ticks(spark, sf_dir).withColumn("rate", (F.col("price") - 100) / 10_000), 1095)
    return out.select("symbol", F.round("mean", 6).alias("mean"), F.round("last", 6).alias("last"), "n", F.round("annual", 4).alias("annual"), "is_rising")


@query("""{T}, d AS (SELECT symbol, ts_ms // 86400000 AS day, sum(side * quantity) / nullif(sum(quantity), 0) AS mean, count(*) AS n FROM t GROUP BY 1, 2)
SELECT symbol, day, round(mean, 6) AS mean, n, round(mean - lag(mean) OVER (PARTITION BY symbol ORDER BY day), 6) + 0.0 AS change, round(avg(mean) OVER (PARTITION BY symbol ORDER BY day ROWS 2 PRECEDING), 6) AS three_days FROM d""")
def sentiment_daily(spark, sf_dir):
    out = A.sentiment(ticks(spark, sf_dir).select("symbol", F.col("side").alias("score"), F.col("quantity").alias("weight"), "ts_ms"))
    return out.select("symbol", "day", F.round("mean", 6).alias("mean"), "n", (F.round("change", 6) + 0.0).alias("change"), F.round("three_days", 6).alias("three_days"))


@query("""{T}, w AS (SELECT symbol, ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS wait FROM t), l AS (SELECT symbol, list_sort(list(wait)) AS v FROM w WHERE wait IS NOT NULL GROUP BY 1)
SELECT symbol, v[CAST(round(0.5 * (len(v) - 1)) AS INTEGER) + 1] AS p50, v[CAST(round(0.9 * (len(v) - 1)) AS INTEGER) + 1] AS p90, v[CAST(round(0.99 * (len(v) - 1)) AS INTEGER) + 1] AS p99 FROM l""")
def latency_percentiles(spark, sf_dir):
    wait = ticks(spark, sf_dir).select("symbol", (F.col("ts_ms") - F.lag("ts_ms").over(ordered())).alias("wait"))
    return reports.quantiles(wait, "symbol", "wait", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(RET + """, o AS (SELECT * FROM r WHERE ret IS NOT NULL), c AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS c FROM o x JOIN o y ON x.bar_start_ms = y.bar_start_ms AND x.symbol < y.symbol GROUP BY 1, 2)
SELECT arg_max(a || ' ' || b, row(c, a, b)) AS most, round(max(c), 4) AS highest, arg_min(a || ' ' || b, row(c, a, b)) AS least, round(min(c), 4) AS lowest, count(*) FILTER (abs(c) > 0.05) AS edges FROM c""")
def correlation_extremes(spark, sf_dir):
    pairs = joins.correlations(hourly(spark, sf_dir))
    name, by = F.concat_ws(" ", "a", "b"), F.struct("corr", "a", "b")
    return pairs.agg(F.max_by(name, by).alias("most"), F.round(F.max("corr"), 4).alias("highest"), F.min_by(name, by).alias("least"), F.round(F.min("corr"), 4).alias("lowest"), F.count_if(F.abs("corr") > 0.05).alias("edges"))
