"""Queries over the liquidity of quotes, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import ordered
from ..operators import liquidity
from .catalog import HOUR, query, recursion, rounded
from .ticks import ticks

QUOTED = """{T}, q AS (SELECT symbol, ts_ms, trade_id, price - 0.01 * quantity AS bid, price + 0.01 * quantity AS ask, quantity AS bid_size, 100 - quantity AS ask_size FROM t),
o AS (SELECT *, ask - bid AS spread, (bid + ask) / 2 AS mid, CASE WHEN (bid + ask) / 2 > 1e-10 THEN (ask - bid) / ((bid + ask) / 2) * 10000 ELSE 0 END AS spread_bps FROM q)"""


def quotes(spark, sf_dir):
    """Quotes around the ticks: the wider the more is traded."""
    t = ticks(spark, sf_dir)
    return t.select("symbol", "ts_ms", "trade_id", (F.col("price") - 0.01 * F.col("quantity")).alias("bid"), (F.col("price") + 0.01 * F.col("quantity")).alias("ask"), F.col("quantity").alias("bid_size"), (100 - F.col("quantity")).alias("ask_size"))


SCORES = QUOTED + """, n AS (SELECT *, row_number() OVER w AS i, max(spread) OVER (w ROWS 49 PRECEDING) AS widest, min(spread) OVER (w ROWS 49 PRECEDING) AS narrowest, CASE WHEN bid_size + ask_size > 1e-10 THEN (bid_size - ask_size) / (bid_size + ask_size) ELSE 0 END AS imbalance
  FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)),
a AS """ + recursion("SELECT symbol, i, spread AS v FROM n WHERE i = 1", "f.v + 0.1 * (n.spread - f.v)") + """
SELECT n.symbol, ts_ms, trade_id, round(spread, 6) AS spread, round(spread_bps, 4) AS spread_bps, round(v, 6) AS average_spread, round(widest, 6) AS widest, round(narrowest, 6) AS narrowest, round(imbalance, 6) + 0.0 AS imbalance,
  round(CASE WHEN n.i > 1 AND mid >= 1e-10 THEN v / mid * sqrt(100 / mid) ELSE 0 END, 4) AS impact, round((1 - least(spread_bps / 50, 1) + 1 - abs(imbalance)) / 2, 6) AS score FROM n JOIN a ON n.symbol = a.symbol AND n.i = a.i"""  # fmt: skip


@query(SCORES)
def liquidity_scores(spark, sf_dir):
    out = liquidity.scores(quotes(spark, sf_dir), 0.1, 50, 100.0)
    return rounded(out.withColumns({"spread_bps": F.round("spread_bps", 4), "impact": F.round("impact", 4)}))


@query(QUOTED + """, p AS (SELECT symbol, ts_ms // 14400000 * 14400000 AS period_start_ms, spread_bps, row_number() OVER (PARTITION BY symbol, ts_ms // 14400000 ORDER BY spread_bps) AS place, count(*) OVER (PARTITION BY symbol, ts_ms // 14400000) AS n FROM o)
SELECT symbol, period_start_ms, count(*) AS n, round(avg(spread_bps), 4) AS mean, round(min(spread_bps), 4) AS least, round(max(spread_bps), 4) AS most, round(coalesce(stddev_samp(spread_bps), 0), 4) AS deviation,
  round(max(CASE WHEN place = least(floor(n * 0.95) + 1, n) THEN spread_bps END), 4) AS p95, count(*) FILTER (spread_bps > 100) AS alerts FROM p GROUP BY 1, 2""")
def spread_statistics(spark, sf_dir):
    return rounded(liquidity.statistics(quotes(spark, sf_dir), 4 * HOUR, 100.0), 4)


@query(QUOTED + """, l AS (SELECT *, lead(mid) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) AS later FROM o), m AS (SELECT *, abs(later - mid) AS impact FROM l WHERE later IS NOT NULL)
SELECT symbol, round(avg(impact), 6) AS adverse_selection, round(avg(0.2 * spread), 6) AS inventory_cost, round(avg(spread - impact - 0.2 * spread), 6) AS order_processing FROM m GROUP BY 1""")
def spread_parts(spark, sf_dir):
    later = liquidity.touch(quotes(spark, sf_dir)).withColumn("impact", F.abs(F.lead("mid").over(ordered()) - F.col("mid"))).where("impact IS NOT NULL")
    parts = liquidity.decomposed(F.col("spread"), F.col("impact"), 0.2)
    return rounded(later.groupBy("symbol").agg(*(F.avg(c).alias(name) for name, c in parts.items())))
