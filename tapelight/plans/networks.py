"""Queries over correlation networks, combined signals, noise and merged feeds, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import last_rows, ordered
from ..operators import analytics as A
from ..operators import combining, feeds, networks
from .catalog import HOUR, hourly, query, recursion, rounded
from .ticks import ticks

DAY = 24 * HOUR

# Networks -----------------------------------------------------------------------------------------------------------

CORRELATED = """{B}, s AS (SELECT x.symbol AS a, y.symbol AS b, x.bar_start_ms // 86400000 AS period, sum(ln(x.close)) AS x, sum(ln(y.close)) AS y, sum(ln(x.close) ** 2) AS xx, sum(ln(y.close) ** 2) AS yy,
  sum(ln(x.close) * ln(y.close)) AS xy, count(*) AS n FROM b x JOIN b y ON x.bar_start_ms = y.bar_start_ms AND x.symbol < y.symbol WHERE x.close > 0 AND y.close > 0 GROUP BY ALL),
w AS (SELECT a, b, (period + 1) * 86400000 AS date, sum(x) OVER v AS x, sum(y) OVER v AS y, sum(xx) OVER v AS xx, sum(yy) OVER v AS yy, sum(xy) OVER v AS xy, sum(n) OVER v AS n FROM s WINDOW v AS (PARTITION BY a, b ORDER BY period RANGE 2 PRECEDING)),
c AS (SELECT date, a, b, CASE WHEN xx / n - (x / n) ** 2 > 1e-12 AND yy / n - (y / n) ** 2 > 1e-12 THEN (xy / n - x / n * (y / n)) / (sqrt(xx / n - (x / n) ** 2) * sqrt(yy / n - (y / n) ** 2)) END AS correlation, CAST(n AS BIGINT) AS n FROM w)"""


def three_days(spark, sf_dir) -> DataFrame:
    return networks.correlations(hourly(spark, sf_dir), DAY, 3)


@query(CORRELATED + " SELECT date, a, b, round(correlation, 6) + 0.0 AS correlation, n FROM c WHERE abs(correlation) >= 0.1")
def correlation_edges(spark, sf_dir):
    return rounded(networks.edges(three_days(spark, sf_dir), 0.1))


@query(CORRELATED + """, e AS (SELECT date, unnest([a, b]) AS symbol, CASE WHEN abs(correlation) >= 0.1 THEN abs(correlation) END AS weight FROM c),
o AS (SELECT date, symbol, count(weight) AS edges, coalesce(sum(weight), 0) AS strength FROM e GROUP BY ALL)
SELECT date, symbol, round(edges / greatest(count(*) OVER (PARTITION BY date) - 1, 1), 6) AS degree, round(strength, 6) AS strength, row_number() OVER (PARTITION BY date ORDER BY strength DESC, symbol) = 1 AS is_leader FROM o""")
def correlation_centrality(spark, sf_dir):
    return rounded(networks.centrality(three_days(spark, sf_dir), 0.1))


SHIFTS = CORRELATED + """, n AS (SELECT 'all' AS symbol, date, avg(abs(correlation)) AS mean, row_number() OVER (ORDER BY date) AS i FROM c WHERE abs(correlation) >= 0.05 GROUP BY date), a AS """ + recursion(
    "SELECT symbol, i, mean AS v FROM n WHERE i = 1", "f.v + 2.0 / 6 * (n.mean - f.v)") + """
SELECT date, round(mean, 6) AS mean_correlation, round(v, 6) AS average, round(mean - v, 6) + 0.0 AS deviation, abs(mean - v) > 0.03 AS is_shift FROM n JOIN a USING (i)"""  # fmt: skip


@query(SHIFTS)
def correlation_shifts(spark, sf_dir):
    return rounded(networks.shifts(three_days(spark, sf_dir), 0.05, 0.03, 5))


SHOCKS = CORRELATED + """, l AS (SELECT *, lead(date) OVER (PARTITION BY a, b ORDER BY date) AS until FROM c),
r AS (SELECT symbol, bar_start_ms, abs(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_start_ms))) AS size FROM b),
k AS (SELECT * FROM (SELECT * FROM r WHERE size >= 0.8) QUALIFY count(*) OVER (PARTITION BY bar_start_ms) > 1),
e AS (SELECT p.bar_start_ms, l.a, l.b, abs(correlation) AS c FROM k p JOIN k q ON p.bar_start_ms = q.bar_start_ms AND p.symbol < q.symbol JOIN l ON l.a = p.symbol AND l.b = q.symbol
  WHERE l.date <= p.bar_start_ms // 86400000 * 86400000 AND (until IS NULL OR until > p.bar_start_ms // 86400000 * 86400000) AND abs(correlation) >= 0.1),
g AS (SELECT bar_start_ms, list(symbol ORDER BY symbol) AS free FROM k GROUP BY 1),
d AS (SELECT bar_start_ms, list(a || '/' || b) AS pairs FROM e GROUP BY 1),
f AS (WITH RECURSIVE f AS (SELECT g.bar_start_ms, free, CAST([] AS VARCHAR[]) AS members, coalesce(pairs, []) AS pairs FROM g LEFT JOIN d USING (bar_start_ms)
  UNION ALL SELECT bar_start_ms, list_filter(free, lambda x: NOT list_contains(m, x)), m, pairs
  FROM (SELECT *, list_prepend(free[1], list_filter(free[2:], lambda x: list_contains(pairs, free[1] || '/' || x))) AS m FROM f WHERE len(free) > 0)) SELECT * FROM f),
i AS (SELECT f.bar_start_ms, members, avg(c) AS inside FROM f JOIN e ON e.bar_start_ms = f.bar_start_ms AND list_contains(members, e.a) AND list_contains(members, e.b) GROUP BY 1, 2)
SELECT i.bar_start_ms, arg_max(symbol, size) AS trigger, array_to_string(members, ',') AS affected, round(avg(size), 6) AS mean_shock, round(avg(size) * any_value(inside), 6) AS score
FROM i JOIN k ON k.bar_start_ms = i.bar_start_ms AND list_contains(members, symbol) GROUP BY i.bar_start_ms, members"""


@query(SHOCKS)
def shocks_spreading(spark, sf_dir):
    out = networks.contagion(A.returns(hourly(spark, sf_dir)), three_days(spark, sf_dir), 0.8, 0.1, DAY)
    return rounded(out.withColumn("affected", F.array_join("affected", ",")))


# Signals ------------------------------------------------------------------------------------------------------------

SIGNALS = ["momentum", "reversion", "activity"]
SIGNALLED = """{B}, r AS (SELECT symbol, bar_start_ms, ln(close / lag(close) OVER w) AS ret, close / lag(close, 5) OVER w - 1 AS momentum, 1 - close / avg(close) OVER (w ROWS 19 PRECEDING) AS reversion,
  volume / avg(volume) OVER (w ROWS 19 PRECEDING) - 1 AS activity FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))"""


def signalled(spark, sf_dir) -> DataFrame:
    by, frame = ordered(order=("bar_start_ms",)), last_rows(20, order=("bar_start_ms",))
    bars = A.returns(hourly(spark, sf_dir))
    return bars.select("symbol", "bar_start_ms", "ret", (F.col("close") / F.lag("close", 5).over(by) - 1).alias("momentum"), (1 - F.col("close") / F.avg("close").over(frame)).alias("reversion"), (F.col("volume") / F.avg("volume").over(frame) - 1).alias("activity"))


@query(SIGNALLED + """, l AS (SELECT *, lead(ret) OVER (PARTITION BY symbol ORDER BY bar_start_ms) AS later FROM r),
i AS (SELECT symbol, coalesce(corr(momentum, later), 0) AS m, coalesce(corr(reversion, later), 0) AS v, coalesce(corr(activity, later), 0) AS a FROM l GROUP BY 1)
SELECT r.symbol, bar_start_ms, round((momentum * m * m + reversion * v * v + activity * a * a) / (m * m + v * v + a * a), 6) + 0.0 AS combined FROM r JOIN i USING (symbol)""")
def signals_combined(spark, sf_dir):
    rows = signalled(spark, sf_dir)
    shares = combining.weights(combining.foretelling(rows, SIGNALS, "ret"), SIGNALS, "squared")
    return rounded(combining.combined(rows, shares, SIGNALS, ["bar_start_ms"]))


@query(SIGNALLED + """, p AS (SELECT symbol, abs(corr(momentum, reversion)) + abs(corr(momentum, activity)) + abs(corr(reversion, activity)) AS total FROM r GROUP BY 1) SELECT symbol, round(total / 3, 6) AS overlap FROM p""")
def signals_overlap(spark, sf_dir):
    return rounded(combining.diversification(signalled(spark, sf_dir), SIGNALS))


@query(SIGNALLED + """, g AS (SELECT symbol, sum(momentum * momentum) AS mm, sum(momentum * reversion) AS mr, sum(momentum * activity) AS ma, sum(reversion * reversion) AS rr, sum(reversion * activity) AS ra
  FROM r WHERE momentum IS NOT NULL AND reversion IS NOT NULL AND activity IS NOT NULL GROUP BY 1),
k AS (SELECT symbol, mr / mm AS c01, ma / mm AS c02, (ra - mr / mm * ma) / (rr - mr / mm * mr) AS c12 FROM g),
q AS (SELECT r.*, c02, c12, reversion - c01 * momentum AS left1 FROM r LEFT JOIN k USING (symbol))
SELECT symbol, bar_start_ms, round(momentum, 6) + 0.0 AS momentum, round(left1, 6) + 0.0 AS reversion, round(activity - c02 * momentum - c12 * left1, 6) + 0.0 AS activity FROM q""")
def signals_orthogonal(spark, sf_dir):
    return rounded(combining.orthogonal(signalled(spark, sf_dir), SIGNALS, ["bar_start_ms"]))


# Noise --------------------------------------------------------------------------------------------------------------


@query("""{T}, d AS (SELECT symbol, ts_ms // 86400000 * 86400000 AS period_start_ms, price - lag(price) OVER (PARTITION BY symbol, ts_ms // 86400000 ORDER BY ts_ms, trade_id) AS d, row_number() OVER (PARTITION BY symbol, ts_ms // 86400000 ORDER BY ts_ms, trade_id) AS i FROM t),
m AS (SELECT symbol, period_start_ms, count(*) AS n, avg(d) AS m FROM d GROUP BY 1, 2),
c AS (SELECT x.symbol, x.period_start_ms, h, sum((x.d - m) * (y.d - m)) / (any_value(n) - 1 - h) AS g FROM d x JOIN m USING (symbol, period_start_ms), range(0, 4) r(h), d y
  WHERE y.symbol = x.symbol AND y.period_start_ms = x.period_start_ms AND y.i = x.i - h AND x.d IS NOT NULL AND y.d IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT symbol, period_start_ms, sum(g * CASE h WHEN 0 THEN 1 WHEN 1 THEN 2 * (1 - 6 * 0.25 ** 2 + 6 * 0.25 ** 3) WHEN 2 THEN 2 * (1 - 6 * 0.25 + 6 * 0.125) ELSE 2 * 2 * 0.25 ** 3 END) AS v, sum(CASE WHEN h = 1 THEN g END) AS first FROM c GROUP BY 1, 2),
o AS (SELECT symbol, period_start_ms, n, CASE WHEN n >= 3 THEN 2 * sqrt(greatest(-first, 0)) END AS roll_spread, CASE WHEN n >= 8 THEN greatest(v, 0) END AS kernel_variance FROM m LEFT JOIN k USING (symbol, period_start_ms))
SELECT symbol, period_start_ms, n, round(roll_spread, 4) AS roll_spread, round(kernel_variance, 4) AS kernel_variance, round(CASE WHEN kernel_variance > 1e-16 THEN roll_spread ** 2 / (4 * kernel_variance) WHEN kernel_variance IS NOT NULL THEN 0 END, 4) AS noise_to_signal FROM o""")
def noise_realised_kernel(spark, sf_dir):
    return rounded(combining.noise(ticks(spark, sf_dir), DAY, 3), 4)


# Feeds --------------------------------------------------------------------------------------------------------------

DELAYS = {"binance": 5, "coinbase": 10}
COMPENSATED = """{T}, d AS (SELECT *, greatest(ts_ms - CASE exchange WHEN 'binance' THEN 5 WHEN 'coinbase' THEN 10 ELSE 0 END, 0) AS compensated_ms FROM t)"""


@query(COMPENSATED + """, l AS (SELECT *, last_value(CASE WHEN exchange = 'binance' THEN compensated_ms END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY compensated_ms, exchange <> 'binance', trade_id ROWS UNBOUNDED PRECEDING) AS last FROM d)
SELECT symbol, exchange, trade_id, compensated_ms, exchange <> 'binance' AS is_fallback FROM l WHERE exchange = 'binance' OR last IS NULL OR compensated_ms - last > 3600000""")
def feeds_failover(spark, sf_dir):
    return feeds.failover(ticks(spark, sf_dir), "binance", HOUR, DELAYS).select("symbol", "exchange", "trade_id", "compensated_ms", "is_fallback")


@query(COMPENSATED + """ SELECT symbol, compensated_ms, trade_id, round(coalesce(sum(price * quantity) OVER w / nullif(sum(quantity) OVER w, 0), last_value(price) OVER w), 6) AS price, round(sum(quantity) OVER w, 6) AS quantity, max(compensated_ms) OVER w AS anchor_ms
FROM d WINDOW w AS (PARTITION BY symbol ORDER BY compensated_ms, trade_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def feeds_vwap_merged(spark, sf_dir):
    return rounded(feeds.vwap_merged(ticks(spark, sf_dir), 5, DELAYS))
