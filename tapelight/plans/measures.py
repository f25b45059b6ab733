"""Queries over the measures: wide selects of many columns, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.frames import last_rows, ordered
from ..operators import reports
from .catalog import hourly, query, rounded
from .ticks import table, ticks


def named(columns: dict) -> list:
    return [c.alias(name) for name, c in columns.items()]


@query("""{T} SELECT symbol, trade_id, price > 100 AS is_above, price = 100 AS is_at, round(price - 100, 6) AS change_from, round((price - 100) / 100 * 100, 6) AS change_pct, price % 0.5 = 0 AS is_round, side * quantity + 0.0 AS signed_quantity, quantity >= 50 AS is_large, quantity = 0 AS is_zero, round(price * quantity, 6) AS dollar_value, greatest(1706745600000 - ts_ms, 0) AS age_ms, CASE WHEN side > 0 THEN 'buy' ELSE 'sell' END AS side_name FROM t""")
def measures_tick(spark, sf_dir):
    return rounded(ticks(spark, sf_dir).select("symbol", "trade_id", *named(M.tick_measures(100.0, 0.5, 50.0, 1706745600000))))


@query("""{B}, x AS (SELECT *, abs(close - open) AS bd, high - low AS sp, high - greatest(open, close) AS up, least(open, close) - low AS dn FROM b)
SELECT symbol, bar_start_ms, round(bd, 6) AS body_size, round(sp, 6) AS bar_range, round(bd / nullif(sp, 0), 6) AS body_ratio, round(up, 6) AS upper_shadow, round(dn, 6) AS lower_shadow, round((high + low + close) / 3, 6) AS hlc3, round((open + high + low + close) / 4, 6) AS ohlc4, round((high + low + 2 * close) / 4, 6) AS weighted_close, round(((close - low) - (high - close)) / nullif(sp, 0), 6) AS close_location,
close > open AS is_bullish, close < open AS is_bearish, up <= 0.05 * sp AND dn <= 0.05 * sp AS is_marubozu, bd <= 0.3 * sp AND up > 0 AND dn > 0 AS is_spinning_top, up >= 2 * bd AND dn <= bd AND sp > 0 AS is_shooting_star, round(sp / open * 100, 6) AS range_pct, round(volume * close, 6) AS notional, round(turnover / nullif(volume, 0) - close, 6) + 0.0 AS vwap_deviation, round(volume / trade_count, 6) AS volume_per_trade, close > (high + low) / 2 AS close_above_middle, round(dn / nullif(sp, 0), 6) AS lower_shadow_pct FROM x""")
def measures_bar(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_start_ms", *named(M.bar_measures())))


@query("""{B}, x AS (SELECT *, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))
SELECT symbol, bar_start_ms, round((close - pc) / pc * 100, 6) AS change_pct, round(open - pc, 6) AS close_gap, round(close - pc, 6) AS close_momentum, high < ph AND low > pl AS is_inside, high > ph AND low < pl AS is_outside, greatest(open, close) <= greatest(po, pc) AND least(open, close) >= least(po, pc) AS is_harami, (close > open AND pc < po) OR (close < open AND pc > po) AS is_reversal, greatest(low, pl) <= least(high, ph) AS overlaps FROM x WHERE pc IS NOT NULL""")
def measures_bar_pairs(spark, sf_dir):
    by = ordered(order=("bar_start_ms",))
    paired = hourly(spark, sf_dir).select("symbol", "bar_start_ms", F.lag("close").over(by).alias("pc"), *named(M.bar_pair_measures(by)))
    return rounded(paired.where("pc IS NOT NULL").drop("pc"))


@query("""{B}, x AS (SELECT *, close - lag(close) OVER w AS ch, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))
SELECT symbol, round(avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END), 4) AS bullish_ratio, max(close) AS peak_close, min(close) AS trough_close, round(avg(abs(close - open) / nullif(high - low, 0)), 4) AS body_fraction, round(sum(CASE WHEN close > open THEN volume ELSE 0 END) / sum(volume), 4) AS up_volume_share, round(stddev_samp(high - low), 4) AS range_deviation, round(stddev_samp(close), 4) AS close_deviation, round(avg(close), 4) AS mean_close, round(avg(volume), 4) AS mean_volume, round(sum(abs(close - open)), 4) AS total_body, count(*) FILTER (high > ph) AS higher_highs, count(*) FILTER (low < pl) AS lower_lows, count(*) FILTER (ch > 0) AS up_moves, round(avg(ch) FILTER (ch > 0), 4) AS mean_up_move FROM x GROUP BY 1""")
def measures_bar_runs(spark, sf_dir):
    by = ordered(order=("bar_start_ms",))
    b = hourly(spark, sf_dir).withColumns({"change": F.col("close") - F.lag("close").over(by), "prior_high": F.lag("high").over(by), "prior_low": F.lag("low").over(by)})
    return rounded(b.groupBy("symbol").agg(*named(M.bar_run_measures())), 4)


@query("""{B}, x AS (SELECT symbol, bar_start_ms, close, min(close) OVER w AS lo, max(close) OVER w AS hi, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s, quantile_cont(close, 0.75) OVER w - quantile_cont(close, 0.25) OVER w AS iqr, list(close) OVER w AS v FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 19 PRECEDING))
SELECT symbol, bar_start_ms, lo AS low, hi AS high, round(hi - lo, 6) AS span, round(m, 6) AS mean, round(s, 6) AS deviation, round(iqr, 6) AS iqr, round(len(list_filter(v, lambda e: e <= close)) / len(v), 6) AS percentile_rank, round(len(list_filter(v, lambda e: e > (lo + hi) / 2)) / len(v), 6) AS share_above_middle, abs(close - m) > 2 * s AS is_outlier, CAST(len(list_filter(v, lambda e: abs(e - m) > 2 * s)) AS INTEGER) AS n_outliers FROM x""")
def measures_window(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("symbol", "bar_start_ms", *named(M.window_measures("close", last_rows(20, order=("bar_start_ms",))))), 6)


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 99) / 100.0 AS beta FROM part), x AS (SELECT *, 1 / sqrt(1 - beta * beta) AS g FROM p)
SELECT p_partkey, round(g, 6) AS gamma, round(atanh(beta), 6) AS rapidity, round(sqrt((1 + beta) / (1 - beta)), 6) AS doppler, round(g - 1, 6) AS kinetic, round(g * beta, 6) AS momentum, round(1 / g, 6) AS contraction, round(1 + beta * beta / 2, 6) AS approximate, round(cbrt(g), 6) AS warp, round(sqrt(1 - 1 / (g * g)), 6) AS beta_back, round((beta + 0.5) / (1 + 0.5 * beta), 6) AS added FROM x""")
def measures_boost(spark, sf_dir):
    beta = (F.col("p_partkey") % 99) / F.lit(100.0)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *named(M.boost_measures(beta))))


@query("""SELECT c_nationkey AS nation, approx.n, round(p10, 2) AS p10, round(p50, 2) AS p50, round(p90, 2) AS p90 FROM (SELECT c_nationkey, count(*) AS n, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY 1) approx, LATERAL (SELECT v[CAST(round(0.1 * (len(v) - 1)) AS INTEGER) + 1] AS p10, v[CAST(round(0.5 * (len(v) - 1)) AS INTEGER) + 1] AS p50, v[CAST(round(0.9 * (len(v) - 1)) AS INTEGER) + 1] AS p90)""")
def balance_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.round("c_acctbal", 2).alias("c_acctbal"))
    return reports.quantiles(rows, "nation", "c_acctbal", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).join(rows.groupBy("nation").agg(F.count(F.lit(1)).alias("n")), "nation")


@query("""WITH v AS (SELECT s_suppkey, s_nationkey, abs(s_acctbal) / 10000 AS fill, 1 + s_suppkey % 7 AS fee, 1 + s_suppkey % 11 AS lat FROM supplier), s AS (SELECT *, 0.4 * fill + 0.3 / fee + 0.3 / lat AS score FROM v) SELECT s_nationkey AS nation, arg_max(s_suppkey, row(score, -s_suppkey)) AS venue, round(max(score), 6) AS score FROM s GROUP BY 1""")
def best_venue(spark, sf_dir):
    v = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.abs("s_acctbal") / 10000).alias("fill"), (1 + F.col("s_suppkey") % 7).alias("fee"), (1 + F.col("s_suppkey") % 11).alias("lat"))
    scored = v.withColumn("score", 0.4 * F.col("fill") + 0.3 / F.col("fee") + 0.3 / F.col("lat"))
    return rounded(scored.groupBy("nation").agg(F.max_by("s_suppkey", F.struct("score", -F.col("s_suppkey"))).alias("venue"), F.max("score").alias("score")))


@query("""{T}, s AS (SELECT symbol, exchange, trade_id, ts_ms, side, exp(-(1706745600000 - ts_ms) / 86400000.0) AS w FROM t) SELECT symbol, round(sum(w * side) / sum(w), 6) AS net, count(*) AS n, arg_max(exchange, w) AS latest FROM s GROUP BY 1""")
def signal_decay_weighted(spark, sf_dir):
    s = ticks(spark, sf_dir).withColumn("w", F.exp(-(F.lit(1706745600000) - F.col("ts_ms")) / 86_400_000.0))
    return rounded(s.groupBy("symbol").agg((F.sum(F.col("w") * F.col("side")) / F.sum("w")).alias("net"), F.count(F.lit(1)).alias("n"), F.max_by("exchange", "w").alias("latest")))
