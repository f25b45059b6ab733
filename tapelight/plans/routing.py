"""Queries over candle patterns and the routing of orders, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles, routing
from .catalog import hourly, query, recursion, rounded
from .ticks import table

PATTERNS = """{B}, n AS (SELECT *, lag(open) OVER w AS o1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(close) OVER w AS c1, lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2,
  abs(close - open) AS body, high - low AS extent, least(open, close) - low AS below, high - greatest(open, close) AS above FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms)),
s AS (SELECT *, h1 - l1 > 0 AND abs(c1 - o1) < 0.3 * (h1 - l1) AS small FROM n),
p AS (SELECT symbol, bar_start_ms, 'doji' AS pattern, 0 AS direction, 1 - body / extent AS strength FROM s WHERE extent > 0 AND body < 0.1 * extent
UNION ALL SELECT symbol, bar_start_ms, 'hammer', 1, least(below / body / 2, 1) FROM s WHERE body > 0 AND extent > 0 AND below >= 2 * body AND above <= 0.5 * body
UNION ALL SELECT symbol, bar_start_ms, 'pin_bar', CASE WHEN below > above THEN 1 ELSE -1 END, least(greatest(below, above) / body / 2.5, 1) FROM s WHERE body > 0 AND extent > 0 AND greatest(below, above) >= 2.5 * body AND least(below, above) <= 0.5 * body
UNION ALL SELECT symbol, bar_start_ms, 'inside_bar', 0, 0.7 FROM s WHERE high < h1 AND low > l1
UNION ALL SELECT symbol, bar_start_ms, 'bullish_engulfing', 1, least(body / abs(c1 - o1), 1) FROM s WHERE c1 < o1 AND close > open AND open <= c1 AND close >= o1
UNION ALL SELECT symbol, bar_start_ms, 'bearish_engulfing', -1, least(body / abs(c1 - o1), 1) FROM s WHERE c1 > o1 AND close < open AND open >= c1 AND close <= o1
UNION ALL SELECT symbol, bar_start_ms, 'morning_star', 1, 0.85 FROM s WHERE c2 < o2 AND small AND close > open AND close > (o2 + c2) / 2
UNION ALL SELECT symbol, bar_start_ms, 'evening_star', -1, 0.85 FROM s WHERE c2 > o2 AND small AND close < open AND close < (o2 + c2) / 2)"""


@query(PATTERNS + " SELECT symbol, bar_start_ms, pattern, direction, round(strength, 6) AS strength FROM p")
def candle_patterns(spark, sf_dir):
    return rounded(candles.patterns(hourly(spark, sf_dir)))


@query(PATTERNS + " SELECT symbol, pattern, count(*) AS n, max(bar_start_ms) AS last FROM p GROUP BY 1, 2")
def candle_pattern_counts(spark, sf_dir):
    return candles.counts(candles.patterns(hourly(spark, sf_dir)))


ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def outcomes(spark, sf_dir):
    """Lines as outcomes of suppliers as venues."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("venue"), *ORDER, (1 - F.col("l_discount")).alias("fill_rate"), (1 + 2 * F.col("l_linenumber")).alias("delay_ms"))


HISTORY = """WITH n AS (SELECT l_suppkey AS symbol, 1 - l_discount AS fill, CAST(1 + 2 * l_linenumber AS DOUBLE) AS delay, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem),
a AS """ + recursion("SELECT symbol, i, fill, delay FROM n WHERE i = 1", "f.fill + 0.1 * (n.fill - f.fill), f.delay + 0.1 * (n.delay - f.delay)") + """,
e AS (SELECT symbol AS venue, max(i) AS n, arg_max(fill, i) AS fill, arg_max(delay, i) AS delay FROM a GROUP BY 1)"""  # fmt: skip


@query(HISTORY + " SELECT venue, round(fill, 6) AS fill_rate, round(delay, 6) AS delay_ms, n FROM e")
def venue_history(spark, sf_dir):
    return rounded(routing.history(outcomes(spark, sf_dir), 0.1, ORDER))


@query(HISTORY + """, v AS (SELECT s_suppkey AS venue, s_nationkey AS nation, 1 + s_suppkey % 7 AS fee, coalesce(fill, abs(s_acctbal) / 10000) AS fill, coalesce(delay, 1 + s_suppkey % 11) AS delay FROM supplier LEFT JOIN e ON e.venue = s_suppkey),
r AS (SELECT *, 0.4 * fill + 0.3 / fee + 0.3 / delay AS score, row_number() OVER (PARTITION BY nation ORDER BY 0.4 * fill + 0.3 / fee + 0.3 / delay DESC, venue) AS place FROM v QUALIFY place <= 3),
p AS (SELECT *, score / sum(score) OVER (PARTITION BY nation) AS part, sum(fee * score) OVER (PARTITION BY nation) / sum(score) OVER (PARTITION BY nation) AS cost FROM r)
SELECT o_orderkey AS order_id, venue, place, round(CASE WHEN o_totalprice < 200000 THEN o_totalprice ELSE o_totalprice * part END, 4) AS quantity, round(CASE WHEN o_totalprice < 200000 THEN fee ELSE cost END, 4) AS cost_bps
FROM orders JOIN customer ON c_custkey = o_custkey JOIN p ON nation = c_nationkey WHERE o_totalprice >= 200000 OR place = 1""")
def orders_routed(spark, sf_dir):
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("venue"), F.col("s_nationkey").alias("nation"), (1 + F.col("s_suppkey") % 7).alias("fee_bps"), (F.abs("s_acctbal") / 10000).alias("fill_rate"), (1 + F.col("s_suppkey") % 11).cast("double").alias("delay_ms"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("order_id"), F.col("c_nationkey").alias("nation"), F.col("o_totalprice").alias("quantity"))
    out = routing.routed(o, routing.scored(v, routing.history(outcomes(spark, sf_dir), 0.1, ORDER)), "nation", 200_000, 3)
    return rounded(out, 4)


@query("""SELECT o_orderkey AS order_id, CAST(i AS INTEGER) AS slice, round(o_totalprice * [0.4, 0.1, 0.2, 0.3][i + 1], 4) AS quantity FROM orders, range(4) r(i)""")
def orders_sliced(spark, sf_dir):
    return rounded(routing.sliced(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("quantity")), [4, 1, 2, 3]), 4)


@query("""WITH o AS (SELECT o_orderkey AS order_id, o_orderkey % 5 AS market, floor(o_totalprice / 10000) AS quantity FROM orders WHERE o_totalprice >= 10000),
w AS (SELECT *, sum(quantity) OVER (PARTITION BY market ORDER BY order_id ROWS UNBOUNDED PRECEDING) AS until FROM o),
h AS (SELECT p_partkey AS offer_id, p_partkey % 5 AS market, p_retailprice AS price, p_size * 10.0 AS size, sum(p_size * 10.0) OVER (PARTITION BY p_partkey % 5 ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS offered FROM part)
SELECT order_id, offer_id, CAST(least(until, offered) - greatest(until - quantity, offered - size) AS DOUBLE) AS filled, price FROM w JOIN h ON w.market = h.market AND until - quantity < offered AND offered - size < until""")
def orders_filled(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 5).alias("market"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("quantity"))
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("offer_id"), (F.col("p_partkey") % 5).alias("market"), F.col("p_retailprice").alias("price"), (F.col("p_size") * 10.0).alias("size"))
    return routing.filled(o, h, "market")
