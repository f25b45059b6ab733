"""Every query over the driver's tables, with DuckDB SQL for the same rows written on its own.

A query is a function of (spark, sf_dir); doubles are rounded so that both engines' sums, which differ in their last
bits, compare equal. Queries without SQL are ordered folds, covered by tests against plain loops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sessions
from ..functions.frames import last_rows, ordered, zscore
from ..operators import bars as B
from ..operators import book, carried, filters, folds, joins, reports, rolling
from .ticks import EXCHANGES, table, ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000

TICKS = """t AS (SELECT event_type AS symbol, CASE user_id % 4 WHEN 0 THEN 'binance' WHEN 1 THEN 'coinbase' WHEN 2 THEN 'alpaca' ELSE 'polygon' END AS exchange,
  value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS side, event_id AS trade_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms FROM events)"""
BARS = (
    TICKS
    + """, b AS (SELECT symbol, (ts_ms // 3600000) * 3600000 AS bar_start_ms, arg_min(price, row(ts_ms, trade_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(ts_ms, trade_id)) AS close, sum(quantity) AS volume, count(*) AS trade_count, sum(price * quantity) AS turnover FROM t GROUP BY 1, 2)"""
)


def query(sql: str | None = None):
    """Register a query; `sql` may begin with {T} (ticks) or {B} (hourly bars) as its first common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{T}", "WITH " + TICKS).replace("{B}", "WITH " + BARS)
        return f

    return add


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as DuckDB does, which scales before it decides on halves; -0.0 becomes 0.0."""
    scale = F.lit(10.0**digits)

    def near(c: str) -> Column:
        scaled = F.col(c) * scale  # of a double whose product is no double any more nothing can be rounded
        return F.when(F.abs(scaled) == float("inf"), F.col(c)).otherwise(F.round(scaled) / scale) + 0.0

    return frame.select(*(near(c).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.time_bars(ticks(spark, sf_dir), HOUR)


# Bars ---------------------------------------------------------------------------------------------------------------


@query("""{B} SELECT symbol, bar_start_ms, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(volume,6) AS volume, trade_count, round(turnover,4) AS turnover, round(turnover / nullif(volume,0),6) AS vwap FROM b""")
def bars_hourly(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).withColumn("turnover", F.round("turnover", 4)))


@query("""{T}, m AS (SELECT t.*, unnest([60000, 900000, 86400000]) AS period_ms FROM t)
SELECT symbol, CAST(period_ms AS INTEGER) AS period_ms, CAST(ts_ms // period_ms * period_ms AS BIGINT) AS bar_start_ms, arg_min(price, row(ts_ms, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts_ms, trade_id)) AS close, count(*) AS trade_count FROM m GROUP BY ALL""")
def bars_multi_timeframe(spark, sf_dir):
    return B.multi_time_bars(ticks(spark, sf_dir), [60_000, 900_000, 86_400_000]).drop("volume", "turnover")


@query("""{T}, n AS (SELECT *, CAST((row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) - 1) // 50 AS BIGINT) AS bar FROM t)
SELECT symbol, bar, arg_min(price, row(ts_ms, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts_ms, trade_id)) AS close, sum(quantity) AS volume, count(*) AS trade_count, min(ts_ms) AS start_ms FROM n GROUP BY 1, 2""")
def bars_ticks(spark, sf_dir):
    return B.tick_bars(ticks(spark, sf_dir), 50).drop("turnover")


@query("""{T}, c AS (SELECT *, sum(quantity) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS e, sum(quantity) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) - quantity AS s FROM t),
x AS (SELECT *, unnest(range(CAST(floor(s / 1000) AS BIGINT), CAST(ceil(e / 1000) AS BIGINT))) AS bar FROM c WHERE quantity > 0),
p AS (SELECT symbol, bar, side, least(e, (bar + 1) * 1000.0) - greatest(s, bar * 1000.0) AS part FROM x)
SELECT symbol, bar, round(sum(CASE WHEN side > 0 THEN part ELSE 0 END), 6) AS buy, round(sum(CASE WHEN side < 0 THEN part ELSE 0 END), 6) AS sell, round(sum(part), 6) AS volume FROM p GROUP BY 1, 2""")
def bars_volume_split(spark, sf_dir):
    return rounded(B.split_volume_bars(ticks(spark, sf_dir), 1000.0))


@query("""{T}, c AS (SELECT *, sum(quantity) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS e, sum(quantity) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) - quantity AS s FROM t),
x AS (SELECT *, unnest(range(CAST(floor(s / 1000) AS BIGINT), CAST(ceil(e / 1000) AS BIGINT))) AS bar FROM c WHERE quantity > 0),
p AS (SELECT symbol, bar, side, least(e, (bar + 1) * 1000.0) - greatest(s, bar * 1000.0) AS part FROM x),
v AS (SELECT symbol, bar, abs(sum(side * part)) / 1000 AS i FROM p GROUP BY 1, 2 HAVING round(sum(part), 6) >= 1000)
SELECT symbol, bar, CASE WHEN count(*) OVER w >= 10 THEN round(avg(i) OVER w, 6) END AS vpin FROM v WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 9 PRECEDING)""")
def vpin_split(spark, sf_dir):
    return rounded(B.vpin(ticks(spark, sf_dir), 1000.0, 10))


@query("""{B}, n AS (SELECT *, lead(bar_start_ms) OVER (PARTITION BY symbol ORDER BY bar_start_ms) AS nxt FROM b)
SELECT symbol, bar_start_ms, open, high, low, close, volume, trade_count, false AS is_gap_fill FROM b
UNION ALL SELECT symbol, unnest(range(bar_start_ms + 3600000, nxt, 3600000)) AS bar_start_ms, close, close, close, close, 0.0, 0, true FROM n WHERE nxt > bar_start_ms + 3600000""")
def bars_gap_filled(spark, sf_dir):
    return B.gap_fill(hourly(spark, sf_dir), HOUR)


@query("""{T}, h AS (SELECT *, ts_ms // 3600000 * 3600000 AS bar_start_ms FROM t), d AS (SELECT *, coalesce(lead(ts_ms) OVER (PARTITION BY symbol, bar_start_ms ORDER BY ts_ms, trade_id) - ts_ms, 0) AS held FROM h)
SELECT symbol, bar_start_ms, round(coalesce(sum(price * held) / nullif(sum(held), 0), arg_max(price, row(ts_ms, trade_id))), 6) AS twap FROM d GROUP BY 1, 2""")
def twap_hourly(spark, sf_dir):
    return rounded(B.twap(ticks(spark, sf_dir), HOUR))


@query("""{T}, p AS (SELECT *, CAST((ts_ms - min(ts_ms) OVER (PARTITION BY symbol)) // 86400000 AS BIGINT) AS period FROM t)
SELECT symbol, trade_id, period, round(sum(price * quantity) OVER w / nullif(sum(quantity) OVER w, 0), 6) AS vwap FROM p WINDOW w AS (PARTITION BY symbol, period ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING)""")
def vwap_cumulative(spark, sf_dir):
    return rounded(B.cumulative_vwap(ticks(spark, sf_dir), 86_400_000).select("symbol", "trade_id", "period", "vwap"))


# Filters and transforms ---------------------------------------------------------------------------------------------


@query("""{T}, o AS (SELECT max(ts_ms) AS now FROM t) SELECT symbol, trade_id, price, quantity FROM t, o WHERE price BETWEEN 50 AND 300 AND quantity >= 5 AND upper(symbol) IN ('PURCHASE', 'CLICK', 'VIEW') AND greatest(now - ts_ms, 0) <= 864000000""")
def filter_chain(spark, sf_dir):
    t = ticks(spark, sf_dir)
    now = t.agg(F.max("ts_ms").alias("now"))
    kept = filters.chain(t, lambda f: filters.price_range(f, 50, 300), lambda f: filters.min_quantity(f, 5), lambda f: filters.symbols(f, ["purchase", "click", "view"]))
    return kept.crossJoin(F.broadcast(now)).where("greatest(now - ts_ms, 0) <= 864000000").select("symbol", "trade_id", "price", "quantity")  # `now` is one row


@query("""{T}, z AS (SELECT *, count(*) OVER w AS n, avg(price) OVER w AS m, stddev_samp(price) OVER w AS s FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, trade_id, price FROM z WHERE n < 20 OR s = 0 OR abs(price - m) / s <= 2.0""")
def filter_outliers(spark, sf_dir):
    return filters.not_outlier(ticks(spark, sf_dir), 20, 2.0).select("symbol", "trade_id", "price")


@query("""{T}, l AS (SELECT *, lag(price) OVER w AS p, lag(quantity) OVER w AS q FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)) SELECT symbol, trade_id FROM l WHERE p IS NULL OR p <> price OR q <> quantity""")
def filter_repeats(spark, sf_dir):
    return filters.not_repeated(ticks(spark, sf_dir)).select("symbol", "trade_id")


@query("""{T} SELECT upper(symbol) AS symbol, trade_id, (ts_ms + 500) // 1000 * 1000 AS aligned_ms, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) - 1 AS sequence FROM t WHERE price > 0 AND quantity > 0""")
def ticks_processed(spark, sf_dir):
    return filters.processed(ticks(spark, sf_dir)).select("symbol", "trade_id", filters.aligned("ts_ms", 1000).alias("aligned_ms"), F.col("sequence").cast("long").alias("sequence"))


@query("""{T} SELECT symbol, trade_id, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY symbol, exchange ORDER BY ts_ms, trade_id) <= 60000, false) AS is_duplicate FROM t""")
def duplicates_windowed(spark, sf_dir):
    return filters.windowed_duplicates(ticks(spark, sf_dir), ["symbol", "exchange"], 60_000).select("symbol", "trade_id", "is_duplicate")


# Rolling ------------------------------------------------------------------------------------------------------------


@query("""{B} SELECT symbol, bar_start_ms, CASE WHEN max(close) OVER w = min(close) OVER w THEN 0 ELSE round((close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w), 6) END AS norm FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 19 PRECEDING)""")
def normalise_min_max(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_start_ms", rolling.min_max("close", last_rows(20, order=("bar_start_ms",))).alias("norm")))


@query("""{B} SELECT symbol, bar_start_ms, CASE WHEN stddev_pop(close) OVER w < 1e-12 THEN 0 ELSE round((close - avg(close) OVER w) / stddev_pop(close) OVER w, 4) END AS z FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 19 PRECEDING)""")
def normalise_zscore(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_start_ms", zscore("close", last_rows(20, order=("bar_start_ms",))).alias("z")), 4)


@query("""{B} SELECT symbol, bar_start_ms, CASE WHEN count(*) OVER w >= 14 THEN round(avg(close) OVER w, 6) END AS sma FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 13 PRECEDING)""")
def indicator_sma(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_start_ms", rolling.sma("close", last_rows(14, order=("bar_start_ms",)), 14).alias("sma")))


@query("""{B}, x AS (SELECT symbol, bar_start_ms, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 19 PRECEDING))
SELECT symbol, bar_start_ms, CASE WHEN n >= 20 THEN round(m, 4) END AS middle, CASE WHEN n >= 20 THEN round(m + 2 * s, 4) END AS upper, CASE WHEN n >= 20 THEN round(m - 2 * s, 4) END AS lower FROM x""")
def indicator_bollinger(spark, sf_dir):
    return rounded(rolling.bollinger(hourly(spark, sf_dir), 20, 2.0), 4)


@query("""{B}, x AS (SELECT symbol, bar_start_ms, CASE WHEN count(*) OVER w >= 14 THEN CASE WHEN max(high) OVER w = min(low) OVER w THEN 50 ELSE 100 * (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) END END AS k FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 13 PRECEDING))
SELECT symbol, bar_start_ms, round(k, 6) AS k, CASE WHEN count(k) OVER v >= 3 THEN round(avg(k) OVER v, 6) END AS d FROM x WINDOW v AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 2 PRECEDING)""")
def indicator_stochastic(spark, sf_dir):
    return rounded(rolling.stochastic(hourly(spark, sf_dir), 14, 3))


@query("""{B} SELECT symbol, bar_start_ms, round(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), 6) AS true_range FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms)""")
def indicator_true_range(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_start_ms", rolling.true_range().alias("true_range")))


@query("""{B}, x AS (SELECT *, lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, CASE WHEN high = low THEN 0 ELSE abs(close - open) / (high - low) END AS body FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))
SELECT symbol, bar_start_ms, round((high + low + close) / 3, 6) AS typical, round(body, 6) AS body, body <= 0.1 AS is_doji,
CAST(CASE WHEN close > open AND c1 < o1 AND open < c1 AND close > o1 THEN 1 WHEN close < open AND c1 > o1 AND open > c1 AND close < o1 THEN -1 ELSE 0 END AS INTEGER) AS engulfing, coalesce(high < h1 AND low > l1, false) AS is_inside FROM x""")
def candle_shapes(spark, sf_dir):
    return rounded(rolling.candle_shapes(hourly(spark, sf_dir)))


@query("""{T}, x AS (SELECT symbol, trade_id, price, quantity, count(*) OVER w AS n, avg(price) OVER w AS m, stddev_pop(price) OVER w AS s, avg(quantity) OVER w AS q, trade_id - lag(trade_id) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) - 1 AS gap FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, trade_id, 'sequence_gap' AS kind, round(CAST(gap AS DOUBLE), 4) AS value FROM x WHERE gap > 0
UNION ALL SELECT symbol, trade_id, 'price_spike', round(abs(price - m) / s, 4) FROM x WHERE n >= 2 AND s > 0 AND abs(price - m) / s > 3
UNION ALL SELECT symbol, trade_id, 'volume_spike', round(quantity / q, 4) FROM x WHERE n >= 2 AND q > 0 AND quantity / q > 5""")
def anomalies(spark, sf_dir):
    return rounded(rolling.anomalies(ticks(spark, sf_dir)), 4)


@query("""{B}, r AS (SELECT *, ln(close / lag(close) OVER w) AS ret, close / lag(close, 20) OVER w - 1 AS mom FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms)),
x AS (SELECT symbol, bar_start_ms, coalesce(mom, 0) AS momentum, CASE WHEN stddev_pop(close) OVER v < 1e-12 THEN 0 ELSE (close - avg(close) OVER v) / stddev_pop(close) OVER v END AS z, stddev_pop(ret) OVER v * sqrt(252) AS vol FROM r WINDOW v AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 19 PRECEDING))
SELECT symbol, bar_start_ms, round(momentum, 4) AS momentum, round(z, 4) AS z, round(vol, 4) AS vol, CASE WHEN vol < 0.1 THEN 'low' WHEN vol < 0.2 THEN 'normal' WHEN vol < 0.4 THEN 'high' WHEN vol IS NOT NULL THEN 'extreme' END AS regime FROM x""")
def alpha_signals(spark, sf_dir):
    return rounded(rolling.alpha(hourly(spark, sf_dir), 20), 4)


@query("""{T}, d AS (SELECT *, price - lag(price) OVER w AS dp, abs(ln(price / lag(price) OVER w)) / nullif(quantity, 0) AS ill, side * quantity AS flow FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)),
e AS (SELECT *, lag(dp) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS b FROM d),
x AS (SELECT symbol, trade_id, count(b) OVER v AS n, covar_pop(dp, b) OVER v AS c, var_pop(dp) OVER v AS va, regr_slope(dp, flow) OVER v AS k, avg(ill) OVER v AS a FROM e WINDOW v AS (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS 49 PRECEDING))
SELECT symbol, trade_id, CASE WHEN n >= 50 THEN round(2 * sqrt(greatest(-c, 0)), 4) END AS roll_spread, CASE WHEN n >= 50 THEN round(least(greatest(-c / va, 0), 1), 4) END AS bounce, CASE WHEN n >= 50 THEN round(k, 4) END AS kyle_lambda, CASE WHEN n >= 50 THEN round(a, 4) END AS amihud FROM x""")
def microstructure(spark, sf_dir):
    return rounded(rolling.microstructure(ticks(spark, sf_dir), 50), 4)


@query("""{T}, x AS (SELECT symbol, trade_id, sum(CASE WHEN side = 1 THEN quantity ELSE 0 END) OVER w AS buy, sum(CASE WHEN side = -1 THEN quantity ELSE 0 END) OVER w AS sell, sum(side * quantity) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS delta FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS 99 PRECEDING))
SELECT symbol, trade_id, buy, sell, delta, buy - sell AS net, round(coalesce((buy - sell) / nullif(buy + sell, 0), 0), 6) AS imbalance FROM x""")
def order_flow(spark, sf_dir):
    return rounded(rolling.order_flow(ticks(spark, sf_dir), 100))


@query("""{T}, m AS (SELECT symbol, trade_id, price / lag(price) OVER w - 1 AS up, lead(price) OVER w / price - 1 AS one, lead(price, 2) OVER w / lead(price) OVER w - 1 AS two FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)),
x AS (SELECT *, CAST(CASE WHEN one < 0 AND -one < up THEN 1 WHEN two < 0 AND -two < up THEN 2 END AS INTEGER) AS after FROM m) SELECT symbol, trade_id, round(up, 6) AS up, after FROM x WHERE up >= 0.5 AND after IS NOT NULL""")
def mev_backruns(spark, sf_dir):
    return rounded(rolling.patterns(ticks(spark, sf_dir), 0.5))


@query("""{B}, x AS (SELECT symbol, bar_start_ms, 1 - close / max(close) OVER w AS drawdown FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS UNBOUNDED PRECEDING)) SELECT symbol, bar_start_ms, round(drawdown, 6) AS drawdown, round(max(drawdown) OVER (PARTITION BY symbol ORDER BY bar_start_ms ROWS UNBOUNDED PRECEDING), 6) AS max_drawdown FROM x""")
def drawdowns(spark, sf_dir):
    return rounded(rolling.drawdown(hourly(spark, sf_dir)))


@query("""{B} SELECT symbol, bar_start_ms, round((bar_start_ms - 0.1 * close) / sqrt(1 - 0.01), 2) AS t_boosted, round((close - 0.1 * bar_start_ms) / sqrt(1 - 0.01), 2) AS x_boosted FROM b""")
def lorentz_boost(spark, sf_dir):
    return rolling.lorentz(hourly(spark, sf_dir), 0.1).select("symbol", "bar_start_ms", F.round("t_boosted", 2).alias("t_boosted"), F.round("x_boosted", 2).alias("x_boosted"))


@query("""{T} SELECT symbol, trade_id, count(*) OVER w AS n, round(sum(quantity) OVER w, 6) AS volume FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)""")
def trade_intensity(spark, sf_dir):
    t = ticks(spark, sf_dir).select("symbol", "trade_id", "ts_ms", "quantity", F.lit(1).alias("one"))
    return rounded(rolling.trailing(t, HOUR, {"n": ("count", "one"), "volume": ("sum", "quantity")}).select("symbol", "trade_id", "n", "volume"))


@query("""{T} SELECT symbol, trade_id, CAST(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id)) AS DOUBLE) AS sign FROM t""")
def tick_rule(spark, sf_dir):
    return ticks(spark, sf_dir).select("symbol", "trade_id", F.signum(F.col("price") - F.lag("price").over(ordered())).alias("sign"))


@query("""{B}, r AS (SELECT symbol, bar_start_ms, ln(close / lag(close) OVER w) AS ret FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms)), l AS (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY bar_start_ms) AS prev FROM r),
x AS (SELECT symbol, bar_start_ms, sum(ret * ret) OVER w AS rv, sum(abs(ret * prev)) OVER w * pi() / 2 AS bv FROM l WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 23 PRECEDING))
SELECT symbol, bar_start_ms, round(rv, 4) AS rv, round(bv, 4) AS bv, round(greatest(rv - bv, 0), 4) AS jump FROM x WHERE bv IS NOT NULL""")
def realised_variance(spark, sf_dir):
    by, frame = ordered(order=("bar_start_ms",)), last_rows(24, order=("bar_start_ms",))
    r = hourly(spark, sf_dir).withColumn("ret", F.log(F.try_divide("close", F.lag("close").over(by)))).withColumn("prev", F.lag("ret").over(by))
    x = r.select("symbol", "bar_start_ms", F.sum(F.col("ret") * F.col("ret")).over(frame).alias("rv"), (F.sum(F.abs(F.col("ret") * F.col("prev"))).over(frame) * F.pi() / 2).alias("bv"))
    return rounded(x.where("bv IS NOT NULL").withColumn("jump", F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0))), 4)


@query("""{B}, d AS (SELECT *, close - lag(close) OVER w AS diff, lag(close) OVER w AS prev FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms)) SELECT symbol, round(regr_slope(diff, prev), 6) AS slope, CASE WHEN 1 + regr_slope(diff, prev) > 0 AND 1 + regr_slope(diff, prev) < 1 THEN round(-ln(2) / ln(1 + regr_slope(diff, prev)), 4) END AS half_life FROM d GROUP BY symbol""")
def mean_reversion_half_life(spark, sf_dir):
    by = ordered(order=("bar_start_ms",))
    d = hourly(spark, sf_dir).select("symbol", (F.col("close") - F.lag("close").over(by)).alias("diff"), F.lag("close").over(by).alias("prev"))
    fit = d.groupBy("symbol").agg(F.regr_slope("diff", "prev").alias("slope"))
    rho = 1 + F.col("slope")
    return fit.select("symbol", F.round("slope", 6).alias("slope"), F.when((rho > 0) & (rho < 1), F.round(-F.log(F.lit(2.0)) / F.log(rho), 4)).alias("half_life"))


# Joins --------------------------------------------------------------------------------------------------------------


@query("""{T}, q AS (SELECT symbol, ts_ms, price - 1 AS bid, price + 1 AS ask FROM t WHERE exchange = 'polygon'), tr AS (SELECT * FROM t WHERE exchange <> 'polygon'),
j AS (SELECT tr.symbol, tr.trade_id, tr.price, tr.ts_ms, q.bid, q.ask, lag(tr.price) OVER (PARTITION BY tr.symbol ORDER BY tr.ts_ms, tr.trade_id) AS prev FROM tr ASOF LEFT JOIN q ON tr.symbol = q.symbol AND tr.ts_ms >= q.ts_ms)
SELECT symbol, trade_id, bid, ask, CAST(CASE WHEN price > (bid + ask) / 2 THEN 1 WHEN price < (bid + ask) / 2 THEN -1 WHEN price > prev THEN 1 WHEN price < prev THEN -1 END AS INTEGER) AS aggressor FROM j""")
def lee_ready(spark, sf_dir):
    t = ticks(spark, sf_dir)
    quotes = t.where("exchange = 'polygon'").select("symbol", "ts_ms", (F.col("price") - 1).alias("bid"), (F.col("price") + 1).alias("ask"))
    joined = joins.as_of(t.where("exchange != 'polygon'"), quotes, "symbol", "ts_ms", ["bid", "ask"])
    return joins.lee_ready(joined).select("symbol", "trade_id", "bid", "ask", "aggressor")


@query("""{T}, l AS (SELECT symbol, trade_id, """ + ", ".join(f"last_value(CASE WHEN exchange = '{e}' THEN price END IGNORE NULLS) OVER w AS {e}" for e in EXCHANGES) + """ FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING)) SELECT symbol, trade_id, greatest(binance, coinbase, alpaca, polygon) AS best_bid, least(binance, coinbase, alpaca, polygon) AS best_ask FROM l""")
def nbbo(spark, sf_dir):
    return joins.nbbo(ticks(spark, sf_dir), EXCHANGES)


@query("""{T}, l AS (SELECT symbol, exchange, arg_max(price, row(ts_ms, trade_id)) AS p FROM t GROUP BY 1, 2) SELECT a.symbol, a.exchange AS buy, a.p AS buy_price, b.exchange AS sell, b.p AS sell_price, round((b.p - a.p) / a.p * 1e4, 6) AS bps FROM l a JOIN l b ON a.symbol = b.symbol AND a.exchange <> b.exchange AND b.p > a.p WHERE (b.p - a.p) / a.p * 1e4 > 10""")
def arbitrage(spark, sf_dir):
    return rounded(joins.arbitrage(joins.latest(ticks(spark, sf_dir), "symbol", "exchange"), 10.0))


@query("""{B}, r AS (SELECT symbol, bar_start_ms, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_start_ms)) AS ret FROM b) SELECT x.symbol AS a, y.symbol AS b, round(corr(x.ret, y.ret), 6) AS corr, count(*) AS n FROM r x JOIN r y USING (bar_start_ms) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL AND x.symbol < y.symbol GROUP BY 1, 2""")
def correlations(spark, sf_dir):
    return rounded(joins.correlations(hourly(spark, sf_dir)))


@query("""WITH l AS (SELECT event_type AS symbol, arg_max(value, row(ts, event_id)) AS price FROM events GROUP BY 1), c(basket, symbol, weight) AS (VALUES ('all', 'click', 0.5), ('all', 'view', 0.5), ('gone', 'click', 0.5), ('gone', 'nothing', 0.5))
SELECT basket, CASE WHEN count(price) = count(*) THEN round(sum(weight * price), 6) END AS value FROM c LEFT JOIN l USING (symbol) GROUP BY 1""")
def basket_price(spark, sf_dir):
    parts = spark.createDataFrame([("all", "click", 0.5), ("all", "view", 0.5), ("gone", "click", 0.5), ("gone", "nothing", 0.5)], "basket string, symbol string, weight double")
    return rounded(joins.basket(joins.latest(ticks(spark, sf_dir), "symbol").select("symbol", "price"), parts))


# Reports ------------------------------------------------------------------------------------------------------------


@query("""{T} SELECT symbol, count(*) AS n, sum(quantity) AS volume, round(sum(price * quantity) / sum(quantity), 6) AS vwap, min(price) AS low, max(price) AS high, arg_max(price, row(ts_ms, trade_id)) AS last FROM t GROUP BY 1""")
def tick_stats(spark, sf_dir):
    return rounded(reports.tick_stats(ticks(spark, sf_dir)))


@query("""{T}, d AS (SELECT symbol, ts_ms - lag(ts_ms) OVER w AS wait, lag(price) OVER w = price AND lag(quantity) OVER w = quantity AS same FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY wait) - 1 AS rk, count(*) OVER (PARTITION BY symbol) AS n FROM d WHERE wait IS NOT NULL),
r AS (SELECT symbol, avg(CASE WHEN wait > 7200000 THEN 1.0 ELSE 0.0 END) AS g, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS s, max(CASE WHEN rk = round(0.99 * (n - 1)) THEN wait END) AS p FROM k GROUP BY 1)
SELECT symbol, round(g, 6) AS gap_rate, round(s, 6) AS repeat_rate, p AS p99_ms, round(100 * (1 - g) * (1 - s) * exp(-p / 1e6), 6) AS score FROM r""")
def feed_quality(spark, sf_dir):
    return rounded(reports.feed_quality(ticks(spark, sf_dir), 7_200_000))


@query("""{T} SELECT symbol, CAST((ts_ms // 3600000) % 24 AS BIGINT) AS hour, round(avg(price), 6) AS price, sum(quantity) AS volume, count(*) AS n FROM t GROUP BY 1, 2""")
def intraday_profile(spark, sf_dir):
    return rounded(reports.intraday_profile(ticks(spark, sf_dir)))


@query("""{T}, p AS (SELECT symbol, CAST((ts_ms // 3600000) % 24 AS BIGINT) AS hour, round(avg(price), 6) AS price, sum(quantity) AS volume, count(*) AS n FROM t GROUP BY 1, 2) SELECT * EXCLUDE m FROM (SELECT *, max(volume) OVER (PARTITION BY symbol) AS m FROM p) WHERE volume >= 0.9 * m""")
def best_hours(spark, sf_dir):
    return rounded(reports.best_hours(reports.intraday_profile(ticks(spark, sf_dir)), 0.9))


@query("""{B} SELECT symbol, CAST((bar_start_ms // 86400000 + 3) % 7 AS BIGINT) AS weekday, round(avg(close / open - 1), 6) AS ret, count(*) AS n FROM b GROUP BY 1, 2""")
def weekday_effect(spark, sf_dir):
    return rounded(reports.weekday_effect(hourly(spark, sf_dir)))


@query("""{T}, w AS (SELECT symbol, ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS wait FROM t) SELECT symbol, CAST(floor(log2(wait)) * 4 + floor((wait / power(2.0, floor(log2(wait))) - 1) * 4) AS BIGINT) AS bucket, count(*) AS n FROM w WHERE wait > 0 GROUP BY 1, 2""")
def latency_histogram(spark, sf_dir):
    return reports.latency_histogram(ticks(spark, sf_dir))


@query("""{B}, r AS (SELECT *, ln(close / lag(close) OVER w) AS ret, 1 - close / max(close) OVER w AS lost FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms)), k AS (SELECT *, count(ret) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY ret NULLS LAST) - 1 AS rk FROM r)
SELECT symbol, round(stddev_samp(ret) * sqrt(252), 4) AS volatility, round(-max(CASE WHEN rk = floor((1 - 0.95) * n) THEN ret END), 4) AS var, round(-avg(CASE WHEN rk <= floor((1 - 0.95) * n) THEN ret END), 4) AS shortfall, round(avg(ret) / stddev_samp(ret) * sqrt(252), 4) AS sharpe, round(max(lost), 4) AS max_drawdown FROM k GROUP BY 1""")
def risk_report(spark, sf_dir):
    return rounded(reports.risk(hourly(spark, sf_dir)), 4)


@query("""WITH f AS (SELECT l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, p_retailprice AS arrival, l_extendedprice / l_quantity AS px, p_retailprice * (1 - l_discount) AS bench FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0), s AS (SELECT *, (px - arrival) / arrival * 1e4 * side AS slip, (px - bench) / bench * 1e4 * side AS short FROM f)
SELECT symbol, round(avg(slip), 4) AS slippage_bps, round(avg(CASE WHEN slip <= 0 THEN 1.0 ELSE 0.0 END), 6) AS fill_rate, round(avg(short), 4) AS shortfall_bps, count(*) AS n FROM s GROUP BY 1""")
def execution_quality(spark, sf_dir):
    fills = table(spark, sf_dir, "lineitem").where("l_quantity > 0").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("side"), F.col("p_retailprice").alias("arrival_price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("executed_price"), (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("benchmark_price"))
    out = reports.execution_quality(fills)
    return out.select("symbol", F.round("slippage_bps", 4).alias("slippage_bps"), F.round("fill_rate", 6).alias("fill_rate"), F.round("shortfall_bps", 4).alias("shortfall_bps"), "n")


@query("""WITH p AS (SELECT o_custkey AS account, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS value FROM orders), g AS (SELECT *, sum(abs(value)) OVER (PARTITION BY account) AS gross FROM p)
SELECT account, round(sum(abs(value)), 2) AS gross, round(sum(value), 2) AS net, round(sum(greatest(value, 0)), 2) AS long, round(sum(greatest(-value, 0)), 2) AS short, round(max(abs(value) / nullif(gross, 0)), 6) AS largest, round(sum((abs(value) / nullif(gross, 0)) ** 2), 6) AS hhi FROM g GROUP BY 1""")
def account_exposure(spark, sf_dir):
    value = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    out = reports.exposure(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), value.alias("value")))
    return out.select("account", *(F.round(c, 2).alias(c) for c in ("gross", "net", "long", "short")), F.round("largest", 6).alias("largest"), F.round("hhi", 6).alias("hhi"))


@query("""{T}, n AS (SELECT max(ts_ms) AS now FROM t) SELECT exchange AS feed_id, max(ts_ms) AS last_ms, count(*) AS n, max(now) - max(ts_ms) AS age_ms, max(now) - max(ts_ms) > 60000 AS is_stale FROM t, n GROUP BY 1""")
def feed_health(spark, sf_dir):
    t = ticks(spark, sf_dir)
    now = t.agg(F.max("ts_ms")).first()[0]  # one number
    return reports.feed_health(t.withColumnRenamed("exchange", "feed_id"), now or 0, 60_000)


@query("""WITH s AS (SELECT year(o_orderdate) AS period, c_mktsegment AS sector, sum(o_totalprice) AS v, count(*) AS c, avg(o_totalprice) AS m, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), w AS (SELECT period, sector, v / sum(v) OVER (PARTITION BY period) AS pw, c / sum(c) OVER (PARTITION BY period) AS bw, f / 1e5 AS pr, m / 1e5 AS br FROM s), t AS (SELECT *, sum(bw * br) OVER (PARTITION BY period) AS total FROM w)
SELECT period, sector, round((pw - bw) * (br - total), 6) AS allocation, round(bw * (pr - br), 6) AS selection, round((pw - bw) * (pr - br), 6) AS interaction FROM t""")
def brinson_attribution(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = joined.groupBy(F.year("o_orderdate").cast("long").alias("period"), F.col("c_mktsegment").alias("sector")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("c"), F.avg("o_totalprice").alias("br"), F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("pr"))
    by = Window.partitionBy("period")
    return rounded(reports.brinson(s.select("period", "sector", (F.col("v") / F.sum("v").over(by)).alias("pw"), (F.col("c") / F.sum("c").over(by)).alias("bw"), (F.col("pr") / 1e5).alias("pr"), (F.col("br") / 1e5).alias("br"))))


# Books --------------------------------------------------------------------------------------------------------------

DELTAS = "d AS (SELECT symbol, CASE WHEN side > 0 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN side > 0 THEN floor(price / 10) ELSE 60 + floor(price / 10) END AS price, CASE WHEN quantity < 20 THEN 0 ELSE quantity END AS quantity, trade_id AS sequence, ts_ms FROM t), l AS (SELECT symbol, side, price, arg_max(quantity, sequence) AS quantity FROM d GROUP BY 1, 2, 3 HAVING arg_max(quantity, sequence) > 0), r AS (SELECT *, row_number() OVER w AS rank, sum(quantity) OVER w AS cumulative FROM l WINDOW w AS (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END))"


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = F.col("side") > 0
    grid = F.floor(F.col("price") / 10).cast("double")
    return ticks(spark, sf_dir).select("symbol", F.when(bid, "bid").otherwise("ask").alias("side"), F.when(bid, grid).otherwise(grid + 60).alias("price"), F.when(F.col("quantity") < 20, 0.0).otherwise(F.col("quantity")).alias("quantity"), F.col("trade_id").alias("sequence"), "ts_ms")


@query("{T}, " + DELTAS + " SELECT symbol, side, price, quantity, CAST(rank AS INTEGER) AS rank, cumulative FROM r WHERE rank <= 10")
def book_levels(spark, sf_dir):
    return book.levels(book.state(deltas(spark, sf_dir)), 10)


@query("{T}, " + DELTAS + """, m AS (SELECT symbol, max(CASE WHEN side = 'bid' AND rank = 1 THEN price END) AS bid, max(CASE WHEN side = 'ask' AND rank = 1 THEN price END) AS ask, max(CASE WHEN side = 'bid' AND rank = 1 THEN quantity END) AS bq, max(CASE WHEN side = 'ask' AND rank = 1 THEN quantity END) AS aq, sum(CASE WHEN side = 'bid' AND rank <= 5 THEN quantity END) AS b5, sum(CASE WHEN side = 'ask' AND rank <= 5 THEN quantity END) AS a5, sum(CASE WHEN side = 'bid' THEN quantity END) AS bt, sum(CASE WHEN side = 'ask' THEN quantity END) AS aa, sum(price * quantity) AS notional FROM r GROUP BY 1)
SELECT symbol, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread, round((ask - bid) / ((bid + ask) / 2) * 1e4, 6) AS spread_bps, bid >= ask AS is_crossed, round((bid * aq + ask * bq) / (bq + aq), 6) AS microprice, round((bq - aq) / (bq + aq), 6) AS touch_imbalance, round((b5 - a5) / (b5 + a5), 6) AS top_imbalance, round((bt - aa) / (bt + aa), 6) AS total_imbalance, notional FROM m""")
def book_metrics(spark, sf_dir):
    return rounded(book.metrics(book.state(deltas(spark, sf_dir))))


@query("{T}, " + DELTAS + " SELECT symbol, CASE WHEN sum(quantity) >= 300 THEN round(sum(price * greatest(least(quantity, 300 - (cumulative - quantity)), 0)) / 300, 6) END AS fill_price FROM r WHERE side = 'ask' GROUP BY 1")
def book_fill_price(spark, sf_dir):
    return rounded(book.fill_price(book.state(deltas(spark, sf_dir)), "ask", 300.0))


@query("""{T}, q AS (SELECT symbol, ts_ms, trade_id, floor(price / 50) AS bid, floor(price / 50) + 1 AS ask, quantity AS bq, 100 - quantity AS aq FROM t), l AS (SELECT *, lag(bid) OVER w AS b1, lag(bq) OVER w AS bq1, lag(ask) OVER w AS a1, lag(aq) OVER w AS aq1 FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id))
SELECT symbol, trade_id, coalesce((CASE WHEN bid > b1 THEN bq WHEN bid = b1 THEN bq - bq1 ELSE -bq1 END) - (CASE WHEN ask < a1 THEN aq WHEN ask = a1 THEN aq - aq1 ELSE -aq1 END), 0) AS ofi FROM l""")
def book_order_flow(spark, sf_dir):
    grid = F.floor(F.col("price") / 50).cast("double")
    return book.touch_flow(ticks(spark, sf_dir).select("symbol", "ts_ms", "trade_id", grid.alias("bid"), (grid + 1).alias("ask"), F.col("quantity").alias("bid_qty"), (100 - F.col("quantity")).alias("ask_qty")))


# Sessions -----------------------------------------------------------------------------------------------------------


@query("""{T}, m AS (SELECT trade_id, ts_ms, CAST((ts_ms // 60000 + 4320) % 10080 AS BIGINT) AS w, ts_ms % 86400000 AS d FROM t) SELECT trade_id, CASE WHEN w >= 7080 AND w < 9960 THEN 'Closed' ELSE 'Open' END AS forex, w >= 7200 AS is_weekend, round(d / 86400000.0, 6) AS day_share FROM m""")
def sessions_forex(spark, sf_dir):
    ms = F.col("ts_ms")
    return rounded(ticks(spark, sf_dir).select("trade_id", sessions.forex_status(ms).alias("forex"), sessions.is_weekend(ms).alias("is_weekend"), sessions.fraction_of_day(ms).alias("day_share")))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT strftime(day, '%Y-%m-%d') AS day, month(day) IN (3, 6, 9, 12) AND isodow(day) = 5 AND dayofmonth(day) BETWEEN 15 AND 21 AS triple_witching, month(day) IN (1, 4, 7, 10) AS earnings, CAST((dayofmonth(day) - 1) // 7 + 1 AS BIGINT) AS week_of_month FROM d""")
def calendar_flags(spark, sf_dir):
    day = F.col("day")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(day.cast("string").alias("day"), sessions.is_triple_witching(day).alias("triple_witching"), sessions.is_earnings_season(day).alias("earnings"), sessions.week_of_month(day).cast("long").alias("week_of_month"))


#: The calendar of the events' months, with all market holidays from December 2023 to February 2024.
NEW_YORK = """c AS (SELECT CAST(d AS DATE) AS day, isodow(d) <= 5 AND CAST(d AS DATE) NOT IN ('2023-12-25', '2024-01-01', '2024-01-15', '2024-02-19') AS trading FROM generate_series(DATE '2023-12-20', DATE '2024-02-25', INTERVAL 1 DAY) s(d)),
n AS (SELECT c.day, c.trading, min(o.day) AS next_day FROM c LEFT JOIN c o ON o.day > c.day AND o.trading GROUP BY 1, 2),
y AS (SELECT trade_id, ts_ms, (epoch_ms(ts_ms) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM t),
z AS (SELECT y.*, trading, next_day, CAST(local AS DATE) AS day, hour(local) * 60 + minute(local) AS m, hour(local) * 3600000 + minute(local) * 60000 + ts_ms % 60000 AS ms FROM y JOIN n ON n.day = CAST(y.local AS DATE))"""


@query("{T}, " + NEW_YORK + """ SELECT symbol, CASE WHEN NOT trading THEN 'Closed' WHEN m >= 570 AND m < 960 THEN 'Open' WHEN m >= 240 AND m < 1200 THEN 'Extended' ELSE 'Closed' END AS status, count(*) AS n FROM t JOIN z USING (trade_id) GROUP BY 1, 2""")
def sessions_us_equity(spark, sf_dir):
    t = ticks(spark, sf_dir)
    days = sessions.calendar(spark, 2000, 2035)
    day = F.to_date(sessions.new_york(F.col("ts_ms")))
    marked = t.withColumn("day", day).join(F.broadcast(days), "day", "left")  # 13,000 days
    return marked.groupBy("symbol", sessions.us_equity_status(F.col("ts_ms"), F.col("is_holiday")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# Sets, limits -------------------------------------------------------------------------------------------------------


@query("""{B} SELECT symbol, bar_start_ms, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bar_start_ms) AS r FROM b) WHERE r <= 5""")
def top_bars(spark, sf_dir):
    by = ordered(order=(F.col("volume").desc(), "bar_start_ms"))
    return hourly(spark, sf_dir).withColumn("r", F.row_number().over(by)).where("r <= 5").select("symbol", "bar_start_ms", "volume")


@query("""{T} SELECT symbol, price, quantity, min(trade_id) AS trade_id FROM t GROUP BY ALL""")
def ticks_distinct(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("symbol", "price", "quantity").agg(F.min("trade_id").alias("trade_id"))


@query("""{T} SELECT exchange, trade_id, greatest(ts_ms - CASE exchange WHEN 'binance' THEN 5 WHEN 'coinbase' THEN 10 ELSE 0 END, 0) AS compensated_ms FROM t""")
def feeds_merged(spark, sf_dir):
    offset = F.when(F.col("exchange") == "binance", 5).when(F.col("exchange") == "coinbase", 10).otherwise(0)
    return ticks(spark, sf_dir).select("exchange", "trade_id", F.greatest(F.col("ts_ms") - offset, F.lit(0)).alias("compensated_ms"))


# Ordered folds ------------------------------------------------------------------------------------------------------

EMA = """{B}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start_ms) AS i FROM b), r AS (WITH RECURSIVE f AS (SELECT symbol, CAST(14 AS BIGINT) AS i, avg(close) AS v FROM n WHERE i <= 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT n.symbol, n.i, f.v + 2.0 / 15 * (n.close - f.v) FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1) SELECT * FROM f) SELECT n.symbol, n.bar_start_ms, round(r.v, 6) AS ema FROM n LEFT JOIN r ON n.symbol = r.symbol AND n.i = r.i"""

STEPS = """{B}, n AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS ch, ln(close / lag(close) OVER w) AS ret, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))"""


def recursion(first: str, step: str, rows: str = "n") -> str:
    """SQL of a fold f over numbered rows: the first state, then one row after the other."""
    return f"(WITH RECURSIVE f AS ({first} UNION ALL SELECT {rows}.symbol, {rows}.i, {step} FROM f JOIN {rows} ON {rows}.symbol = f.symbol AND {rows}.i = f.i + 1) SELECT * FROM f)"


def averaged(column: str, n: int, weight: str, begin: int = 1, rows: str = "n") -> str:
    """SQL of an average that begins with the mean of n rows and then moves by `weight` of each row's difference."""
    last = begin + n - 1
    first = f"SELECT symbol, CAST({last} AS BIGINT) AS i, avg({column}) AS v FROM {rows} WHERE i BETWEEN {begin} AND {last} GROUP BY symbol HAVING count(*) = {n}"
    return recursion(first, f"f.v + {weight} * ({rows}.{column} - f.v)", rows)


RSI = STEPS + ", g AS (SELECT symbol, i, greatest(ch, 0) AS up, greatest(-ch, 0) AS dn FROM n), u AS " + averaged("up", 14, "1.0 / 14", 2, "g") + ", d AS " + averaged("dn", 14, "1.0 / 14", 2, "g") + """
SELECT n.symbol, bar_start_ms, round(CASE WHEN d.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / d.v) END, 6) AS rsi FROM n LEFT JOIN u ON n.symbol = u.symbol AND n.i = u.i LEFT JOIN d ON n.symbol = d.symbol AND n.i = d.i"""

ATR = STEPS + ", g AS (SELECT symbol, i, CASE WHEN i = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM n), a AS " + averaged("tr", 14, "1.0 / 14", 1, "g") + """
SELECT n.symbol, bar_start_ms, round(v, 6) AS atr FROM n LEFT JOIN a ON n.symbol = a.symbol AND n.i = a.i"""

MACD = STEPS + ", x AS " + averaged("close", 12, "2.0 / 13") + ", y AS " + averaged("close", 26, "2.0 / 27") + ", l AS (SELECT x.symbol, x.i, x.v - y.v AS line FROM x JOIN y ON x.symbol = y.symbol AND x.i = y.i), z AS " + averaged("line", 9, "2.0 / 10", 26, "l") + """
SELECT n.symbol, bar_start_ms, round(line, 6) + 0.0 AS macd, round(z.v, 6) + 0.0 AS signal, round(line - z.v, 6) + 0.0 AS histogram FROM n LEFT JOIN l ON n.symbol = l.symbol AND n.i = l.i LEFT JOIN z ON n.symbol = z.symbol AND n.i = z.i"""

ADX_FIRST = "SELECT symbol, i, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS v FROM g WHERE i = 1"
ADX_PART = "CASE WHEN f.p * 13 / 14 + up + f.m * 13 / 14 + dn > 0 AND f.r * 13 / 14 + tr > 0 THEN 100 * abs(f.p * 13 / 14 + up - f.m * 13 / 14 - dn) / (f.p * 13 / 14 + up + f.m * 13 / 14 + dn) ELSE 0 END"
ADX = STEPS + """, g AS (SELECT symbol, i, CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS dn, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM n), a AS """ + recursion(ADX_FIRST, f"f.p * 13 / 14 + up, f.m * 13 / 14 + dn, f.r * 13 / 14 + tr, (f.v * 13 + {ADX_PART}) / 14", "g") + """
SELECT n.symbol, bar_start_ms, round(CASE WHEN n.i > 1 THEN v END, 6) AS adx FROM n JOIN a ON n.symbol = a.symbol AND n.i = a.i"""

GARCH = STEPS + ", g AS (SELECT symbol, i, lag(ret) OVER (PARTITION BY symbol ORDER BY i) AS last FROM n), a AS " + recursion("SELECT symbol, i, CAST(1e-4 / (1 - 0.1 - 0.85) AS DOUBLE) AS v FROM g WHERE i = 1", "CASE WHEN g.i = 2 THEN f.v ELSE 1e-4 + 0.1 * last * last + 0.85 * f.v END", "g") + """
SELECT n.symbol, bar_start_ms, round(v, 6) AS variance FROM n JOIN a ON n.symbol = a.symbol AND n.i = a.i"""

EWMA = STEPS + ", a AS " + recursion("SELECT symbol, i, ret * ret AS v FROM n WHERE i = 2", "0.94 * f.v + 0.06 * n.ret * n.ret") + """
SELECT n.symbol, bar_start_ms, round(v, 6) AS variance FROM n LEFT JOIN a ON n.symbol = a.symbol AND n.i = a.i"""

HELD = """CASE WHEN f.held * s >= 0 THEN CASE WHEN f.held + s != 0 THEN (f.held * f.cost + s * price) / (f.held + s) ELSE 0 END WHEN abs(s) > abs(f.held) THEN price WHEN f.held + s = 0 THEN 0 ELSE f.cost END"""
POSITIONS = """{T}, n AS (SELECT symbol, trade_id, side * quantity AS s, price, row_number() OVER (PARTITION BY symbol ORDER BY trade_id) AS i FROM t WHERE quantity > 0), a AS """ + recursion(
    "SELECT symbol, i, s AS held, price AS cost, CAST(0 AS DOUBLE) AS realised FROM n WHERE i = 1", f"f.held + s, {HELD}, f.realised + CASE WHEN f.held * s < 0 THEN least(abs(f.held), abs(s)) * sign(f.held) * (price - f.cost) ELSE 0 END") + """
SELECT n.symbol, trade_id, held AS position, round(cost, 6) + 0.0 AS average_cost, round(realised, 6) + 0.0 AS realised FROM n JOIN a ON n.symbol = a.symbol AND n.i = a.i"""  # fmt: skip


@query(EMA)
def indicator_ema(spark, sf_dir):
    return rounded(folds.with_ema(hourly(spark, sf_dir), 14))


@query(RSI)
def indicator_rsi(spark, sf_dir):
    return rounded(folds.rsi(hourly(spark, sf_dir)))


@query(ATR)
def indicator_atr(spark, sf_dir):
    return rounded(folds.atr(hourly(spark, sf_dir)))


@query(MACD)
def indicator_macd(spark, sf_dir):
    return rounded(folds.macd(hourly(spark, sf_dir)))


@query(ADX)
def indicator_adx(spark, sf_dir):
    return rounded(folds.adx(hourly(spark, sf_dir)))


@query(GARCH)
def volatility_garch(spark, sf_dir):
    return rounded(folds.garch(hourly(spark, sf_dir), 1e-4, 0.1, 0.85))


@query(EWMA)
def volatility_ewma(spark, sf_dir):
    return rounded(folds.ewma_volatility(hourly(spark, sf_dir)))


@query(POSITIONS)
def positions_average_cost(spark, sf_dir):
    return rounded(carried.positions(ticks(spark, sf_dir).where("quantity > 0")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, rolling min-max of the close, and a Lorentz boost of the result."""
    normed = hourly(spark, sf_dir).withColumn("norm", rolling.min_max("close", last_rows(20, order=("bar_start_ms",))))
    return rolling.lorentz(normed, 0.1, "bar_start_ms", "norm")


@query("""{B}, n AS (SELECT *, CASE WHEN max(close) OVER w = min(close) OVER w THEN 0 ELSE (close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w) END AS norm FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 19 PRECEDING))
SELECT symbol, bar_start_ms, close, round(norm, 6) AS norm, round((bar_start_ms - 0.1 * norm) / sqrt(0.99), 2) AS t_boosted, round((norm - 0.1 * bar_start_ms) / sqrt(0.99), 2) AS x_boosted FROM n""")
def pipeline_bars_normalise_boost(spark, sf_dir):
    out = flagship(spark, sf_dir)
    return out.select("symbol", "bar_start_ms", "close", F.round("norm", 6).alias("norm"), F.round("t_boosted", 2).alias("t_boosted"), F.round("x_boosted", 2).alias("x_boosted"))
