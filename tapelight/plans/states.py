"""Queries over operators with carried state, fitted models and optimisers, with SQL (recursive where the operator is)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import carried, events, pairs, portfolio, regimes, volatility
from .catalog import HOUR, hourly, query, recursion, rounded
from .ticks import ticks

RULES = (
    carried.Rule("high", carried.price_above(180.0), "critical", cooldown_ms=6 * HOUR),
    carried.Rule("low_views", carried.price_below(20.0), "warning", "view", cooldown_ms=2 * HOUR),
    carried.Rule("moved", carried.price_change(150.0, 2 * HOUR, 1), "warning", cooldown_ms=12 * HOUR),
    carried.Rule("busy", carried.volume_spike(1.9, 6 * HOUR), cooldown_ms=HOUR),
    carried.Rule("band", carried.band_breakout(2.0, 20), "warning"),
    carried.Rule("cross", carried.averages_cross(5, 20), cooldown_ms=24 * HOUR),
)

FIRED = """{T}, n AS (SELECT *, row_number() OVER w AS i, sum(quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS total, avg(price) OVER (w ROWS 4 PRECEDING) AS fast, avg(price) OVER (w ROWS 19 PRECEDING) AS slow,
  avg(price) OVER (w ROWS 19 PRECEDING) AS m, stddev_samp(price) OVER (w ROWS 19 PRECEDING) AS sd FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)),
p AS (SELECT *, lag(fast) OVER w AS fast_before, lag(slow) OVER w AS slow_before,
  greatest(i - 999, min(i) OVER (PARTITION BY symbol ORDER BY ts_ms RANGE 7200000 PRECEDING)) AS from_2h, greatest(i - 999, min(i) OVER (PARTITION BY symbol ORDER BY ts_ms RANGE 21600000 PRECEDING)) AS from_6h
  FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)),
q AS (SELECT p.*, (p.price - a.price) / nullif(a.price, 0) * 100 AS change, (p.total - b.total + b.quantity) / (p.i - p.from_6h + 1) AS mean
  FROM p JOIN n a ON a.symbol = p.symbol AND a.i = p.from_2h JOIN n b ON b.symbol = p.symbol AND b.i = p.from_6h),
c AS (SELECT symbol, trade_id, ts_ms, 'high' AS rule, 'critical' AS severity, 21600000 AS quiet FROM q WHERE price > 180
  UNION ALL SELECT symbol, trade_id, ts_ms, 'low_views', 'warning', 7200000 FROM q WHERE symbol = 'view' AND price < 20
  UNION ALL SELECT symbol, trade_id, ts_ms, 'moved', 'warning', 43200000 FROM q WHERE change >= 150
  UNION ALL SELECT symbol, trade_id, ts_ms, 'busy', 'info', 3600000 FROM q WHERE mean > 0 AND quantity > mean * 1.9
  UNION ALL SELECT symbol, trade_id, ts_ms, 'band', 'warning', 0 FROM q WHERE i >= 20 AND abs(price - m) > 2 * sd
  UNION ALL SELECT symbol, trade_id, ts_ms, 'cross', 'info', 86400000 FROM q WHERE i >= 21 AND (fast_before <= slow_before AND fast > slow OR fast_before >= slow_before AND fast < slow)),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, rule ORDER BY ts_ms, trade_id) AS j FROM c),
f AS (WITH RECURSIVE f AS (SELECT symbol, rule, j, ts_ms AS fired_ms, true AS fires FROM k WHERE j = 1
  UNION ALL SELECT k.symbol, k.rule, k.j, CASE WHEN k.ts_ms >= f.fired_ms + k.quiet THEN k.ts_ms ELSE f.fired_ms END, k.ts_ms >= f.fired_ms + k.quiet FROM f JOIN k ON k.symbol = f.symbol AND k.rule = f.rule AND k.j = f.j + 1) SELECT * FROM f)
SELECT symbol, trade_id, ts_ms, rule, severity FROM k JOIN f USING (symbol, rule, j) WHERE fires"""


@query(FIRED)
def alerts_with_cooldowns(spark, sf_dir):
    return carried.alerts(ticks(spark, sf_dir), RULES)


@query("""{T}, s AS (SELECT *, lag(price) OVER w AS last, lag(ts_ms) OVER w AS last_ms, count(*) OVER b AS n, max(price) OVER b AS top, min(price) OVER b AS bottom, avg(quantity) OVER b AS mean
  FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id), b AS (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)),
m AS (SELECT symbol, trade_id, ts_ms, price, CAST(sign(price - last) AS INTEGER) AS move FROM s WHERE price <> last),
r AS (SELECT *, count(*) OVER b AS n, sum(move) OVER b AS trend FROM m WINDOW b AS (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT symbol, trade_id, ts_ms, 'breakout' AS event, CASE WHEN price > top THEN 1 ELSE -1 END AS direction, round(price, 6) AS value, round(CASE WHEN price > top THEN top ELSE bottom END, 6) AS level FROM s WHERE n = 19 AND (price > top OR price < bottom)
UNION ALL SELECT symbol, trade_id, ts_ms, 'volume_spike', NULL, round(quantity / mean, 6), round(mean, 6) FROM s WHERE mean > 0 AND quantity / mean >= 1.5
UNION ALL SELECT symbol, trade_id, ts_ms, 'gap', CAST(sign(price - last) AS INTEGER), round((price - last) / last, 6), round(last, 6) FROM s WHERE ts_ms > last_ms + 3600000 AND last <> 0 AND abs((price - last) / last) >= 0.005
UNION ALL SELECT symbol, trade_id, ts_ms, 'reversal', CAST(trend / 3 AS INTEGER), round(price, 6), NULL FROM r WHERE n = 3 AND abs(trend) = 3 AND trend = -3 * move""")
def events_detected(spark, sf_dir):
    return rounded(events.detect(ticks(spark, sf_dir), spike=1.5))


def sql_list(values) -> str:
    return "[" + ", ".join(sql_list(v) if isinstance(v, tuple) else repr(float(v)) for v in values) + "]"


MEANS, DEVIATIONS = sql_list(s.mean for s in regimes.REGIMES), sql_list(s.deviation for s in regimes.REGIMES)
LIKELY = f"""list_transform(range(1, 6), lambda j: list_sum(list_transform(range(1, 6), lambda i: f.p[i] * {sql_list(regimes.TRANSITIONS)}[i][j]))
  * exp(-0.5 * pow((n.ret - {MEANS}[j]) / {DEVIATIONS}[j], 2)) / {DEVIATIONS}[j])"""
RETURNS = """{B}, r AS (SELECT symbol, bar_start_ms, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_start_ms)) AS ret FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start_ms) AS i FROM r WHERE ret IS NOT NULL)"""
NORMED = f"CASE WHEN list_sum({LIKELY}) > 0 THEN list_transform([{LIKELY}], lambda q: list_transform(q, lambda v: v / list_sum(q)))[1] ELSE [0.2, 0.2, 0.2, 0.2, 0.2] END"
HIDDEN = RETURNS + ", a AS " + recursion("SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS i, CAST([0.2, 0.2, 0.2, 0.2, 0.2] AS DOUBLE[]) AS p FROM n", NORMED) + """,
g AS (SELECT n.*, a.p, 6 - list_position(list_reverse(a.p), list_max(a.p)) AS best, list(ret) OVER (PARTITION BY n.symbol ORDER BY n.i ROWS 59 PRECEDING) AS seen FROM n JOIN a USING (symbol, i)),
h AS (SELECT *, coalesce(sum(CASE WHEN turned THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i), 0) AS run FROM (SELECT *, best <> coalesce(lag(best) OVER (PARTITION BY symbol ORDER BY i), 1) AS turned FROM g))
SELECT symbol, bar_start_ms, ['low_vol_bull', 'high_vol_bull', 'low_vol_bear', 'high_vol_bear', 'crisis'][best] AS regime, round(list_max(p), 6) AS confidence,
  row_number() OVER (PARTITION BY symbol, run ORDER BY i) + CASE WHEN run = 0 THEN 1 ELSE 0 END AS duration,
  round(sqrt(list_sum(list_transform(list_reverse(seen), lambda x, k: pow(0.94, k - 1) * x * x)) / list_sum(list_transform(seen, lambda x, k: pow(0.94, k - 1)))), 6) AS volatility,
  round(list_sum(list_transform(list_reverse(seen), lambda x, k: pow(0.9, k - 1) * x)) / list_sum(list_transform(seen, lambda x, k: pow(0.9, k - 1))), 6) + 0.0 AS trend, round(p[5], 6) AS crisis FROM h"""


@query(HIDDEN)
def regimes_hidden_states(spark, sf_dir):
    out = regimes.regimes(A.returns(hourly(spark, sf_dir)))
    return rounded(out.withColumn("crisis", F.element_at("probabilities", 5)).drop("probabilities"))


KALMAN = """{B}, y AS (SELECT x.symbol AS a, y.symbol AS b, x.symbol || '/' || y.symbol AS symbol, x.bar_start_ms, ln(x.close) - 0.9 * ln(y.close) AS spread FROM b x JOIN b y ON x.bar_start_ms = y.bar_start_ms AND x.symbol < y.symbol WHERE x.close > 0 AND y.close > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start_ms) AS i FROM y), k AS """ + recursion(
    "SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS mean, CAST(1 AS DOUBLE) AS variance, CAST(1 AS DOUBLE) AS square FROM n",
    "f.mean + (f.variance + 1e-5) / (f.variance + 1e-5 + 1e-3) * (n.spread - f.mean), (1 - (f.variance + 1e-5) / (f.variance + 1e-5 + 1e-3)) * (f.variance + 1e-5), 2.0 / 21 * (n.spread - f.mean) ** 2 + (1 - 2.0 / 21) * f.square",
) + """, z AS (SELECT n.*, mean, variance, sqrt(square) AS deviation, CASE WHEN n.i >= 20 AND sqrt(square) > 2.3e-16 THEN (spread - mean) / sqrt(square) END AS zscore FROM n JOIN k USING (symbol, i))
SELECT a, b, bar_start_ms, round(spread, 6) + 0.0 AS spread, round(mean, 6) + 0.0 AS mean, round(variance, 6) AS variance, round(deviation, 6) AS deviation, round(zscore, 6) + 0.0 AS zscore,
  round(CASE WHEN abs(zscore) >= 1.5 THEN (abs(zscore) - 1.5) * 50 END, 6) AS expected_bps, round(CASE WHEN abs(zscore) >= 1.5 THEN least((abs(zscore) - 1.5) / 1.5, 1) END, 6) AS confidence FROM z"""  # fmt: skip


@query(KALMAN)
def spread_kalman(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    x = bars.select("bar_start_ms", F.col("symbol").alias("a"), F.col("close").alias("x"))
    y = bars.select("bar_start_ms", F.col("symbol").alias("b"), F.col("close").alias("y"))
    return rounded(regimes.spread_filter(x.join(y, "bar_start_ms").where("a < b"), beta=0.9, threshold=1.5))


PAIRS = """{B}, j AS (SELECT x.symbol AS a, y.symbol AS b, x.symbol || '/' || y.symbol AS symbol, x.bar_start_ms, x.close AS x, y.close AS y FROM b x JOIN b y ON x.bar_start_ms = y.bar_start_ms AND x.symbol < y.symbol),
s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start_ms) AS i, avg(x) OVER w AS mx, avg(y) OVER w AS my, var_pop(x) OVER w AS xx, var_pop(y) OVER w AS yy, covar_pop(x, y) OVER w AS xy FROM j WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS 59 PRECEDING)),
n AS (SELECT a, b, symbol, bar_start_ms, i, CASE WHEN i >= 60 THEN xy / yy END AS beta, CASE WHEN i >= 60 THEN x - mx - xy / yy * (y - my) END AS spread, CASE WHEN i >= 60 THEN (x - mx - xy / yy * (y - my)) / sqrt(greatest(xx - xy / yy * xy, 0) * 60 / 59) END AS z FROM s),
p AS """ + recursion(
    "SELECT symbol, i, CASE WHEN z < -1.5 THEN 1 WHEN z > 1.5 THEN -1 ELSE 0 END AS held FROM n WHERE i = 1",
    "CASE WHEN z IS NULL THEN f.held WHEN f.held = 0 THEN CASE WHEN z < -1.5 THEN 1 WHEN z > 1.5 THEN -1 ELSE 0 END WHEN f.held = 1 AND z > -0.5 THEN 0 WHEN f.held = -1 AND z < 0.5 THEN 0 ELSE f.held END",
) + """, h AS (SELECT n.*, held, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY i), 0) AS before FROM n JOIN p USING (symbol, i))
SELECT a, b, bar_start_ms, round(beta, 4) + 0.0 AS beta, round(spread, 4) + 0.0 AS spread, round(z, 4) + 0.0 AS zscore, CAST(held AS BIGINT) AS position,
  CASE WHEN held = before THEN 'hold' WHEN held = 1 THEN 'enter_long' WHEN held = -1 THEN 'enter_short' WHEN before = 1 THEN 'exit_long' ELSE 'exit_short' END AS signal,
  CASE WHEN z < -1.5 THEN 'long' WHEN z > 1.5 THEN 'short' WHEN abs(z) < 0.5 THEN 'exit' WHEN z IS NOT NULL THEN 'neutral' END AS state FROM h"""  # fmt: skip


@query(PAIRS)
def pairs_traded(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    x = bars.select("bar_start_ms", F.col("symbol").alias("a"), F.col("close").alias("x"))
    y = bars.select("bar_start_ms", F.col("symbol").alias("b"), F.col("close").alias("y"))
    return rounded(pairs.traded(pairs.spreads(x.join(y, "bar_start_ms").where("a < b"), 60), entry=1.5), 4)


FITTED = RETURNS + """, g AS (SELECT symbol, 0.05 + 0.05 * x AS alpha, 0.70 + 0.05 * y AS beta, 0.000001 + 0.000001 * z AS omega, s FROM (SELECT symbol, avg(ret * ret) AS s FROM n GROUP BY 1), range(5) a(x), range(5) b(y), range(5) c(z) WHERE round(0.75 + 0.05 * (x + y), 6) < 1),
a AS (WITH RECURSIVE f AS (SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, CAST(omega AS DOUBLE) AS omega, CAST(s AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS ll, CAST(0 AS DOUBLE) AS before, CAST(0 AS DOUBLE) AS last FROM g
  UNION ALL SELECT n.symbol, n.i, alpha, beta, omega, greatest(omega + alpha * n.ret * n.ret + beta * f.v, 1e-10), f.ll - 0.5 * (ln(f.v) + n.ret * n.ret / f.v), f.v, n.ret FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1) SELECT * FROM f),
e AS (SELECT a.* FROM a JOIN (SELECT symbol, max(i) AS i FROM n GROUP BY 1) USING (symbol, i)),
m AS (SELECT *, omega / (1 - alpha - beta) AS far FROM e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ll DESC, alpha DESC, beta DESC, omega DESC) = 1)
SELECT symbol, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(omega, 6) AS omega, round(ll, 4) AS likelihood, CAST(k AS INTEGER) AS step, round(far + pow(alpha + beta, k * (k - 1) / 2) * (omega + alpha * last * last + beta * before - far), 6) AS variance FROM m, range(1, 6) r(k)"""


@query(FITTED)
def volatility_garch_fitted(spark, sf_dir):
    out = volatility.garch_forecast(volatility.garch_fit(A.returns(hourly(spark, sf_dir))), 5).drop("last_variance", "last_return")
    return rounded(out.withColumn("likelihood", F.round("likelihood", 4)))


SHOCK = "(f.ret / sqrt(greatest(exp(f.v), 1e-10)))"
EGARCH = RETURNS + ", a AS " + recursion(
    "SELECT symbol, i, ln(greatest(avg(ret * ret) OVER (PARTITION BY symbol), 1e-10)) AS v, ret FROM n QUALIFY i = 1",
    f"-0.1 + 0.2 * (abs{SHOCK} - 0.7978845608) - 0.05 * {SHOCK} + 0.9 * f.v, n.ret",
) + " SELECT symbol, bar_start_ms, round(n.ret, 6) + 0.0 AS ret, round(greatest(exp(v), 1e-20), 6) AS variance FROM n JOIN a USING (symbol, i)"


@query(EGARCH)
def volatility_egarch(spark, sf_dir):
    return rounded(volatility.egarch(A.returns(hourly(spark, sf_dir)), -0.1, 0.2, -0.05, 0.9))


COVARIANCES = RETURNS + """, s AS (SELECT x.symbol AS a, y.symbol AS b, x.bar_start_ms // 86400000 AS period, sum(x.ret) AS x, sum(y.ret) AS y, sum(x.ret * y.ret) AS xy, count(*) AS n FROM n x JOIN n y ON x.bar_start_ms = y.bar_start_ms AND x.symbol <= y.symbol GROUP BY ALL),
w AS (SELECT a, b, (period + 1) * 86400000 AS date, sum(x) OVER v AS x, sum(y) OVER v AS y, sum(xy) OVER v AS xy, sum(n) OVER v AS n FROM s WINDOW v AS (PARTITION BY a, b ORDER BY period RANGE 6 PRECEDING)),
c AS (SELECT date, a, b, (xy - x * y / n) / (n - 1) AS covariance, x / n AS mean_a FROM w WHERE n > 1),
o AS (SELECT date, a AS symbol, mean_a, row_number() OVER (PARTITION BY date ORDER BY a) AS i FROM c WHERE a = b),
l AS (SELECT date, list(row ORDER BY i) AS m FROM (SELECT p.date, p.i, list(coalesce(covariance, 0) ORDER BY q.i) AS row FROM o p JOIN o q ON p.date = q.date LEFT JOIN c ON c.date = p.date AND c.a = least(p.symbol, q.symbol) AND c.b = greatest(p.symbol, q.symbol) GROUP BY ALL) GROUP BY date),
d AS (SELECT l.date, m, list(mean_a ORDER BY i) AS mu, count(*) AS k FROM l JOIN o USING (date) GROUP BY l.date, m)"""


def contribution(w: str) -> str:
    """SQL of the contributions of weights w under the covariances m."""
    pull = f"list_transform(m, lambda row: list_dot_product(row, {w}))"
    return f"list_transform({w}, lambda x, i: x * {pull}[i] / sqrt(greatest(list_dot_product({w}, {pull}), 1e-20)))"


SHOWN = "SELECT o.date, o.symbol, round(w[o.i], 6) + 0.0 AS weight, round(rc[o.i], 6) + 0.0 AS contribution FROM (SELECT date, w, {rc} AS rc FROM f) e JOIN o USING (date)".replace("{rc}", contribution("w"))
MOVED = "list_transform(w, lambda x, i: x + 0.05 * (mu[i] - 4.0 * list_dot_product(m[i], w)))"
PROJECTED = f"list_transform([{MOVED}], lambda u: list_transform(u, lambda x: greatest(x - list_max(list_transform(range(1, len(u) + 1), lambda j: (list_sum(list_reverse_sort(u)[1:j]) - 1) / j)), 0)))[1]"
MARKOWITZ = COVARIANCES + f""", f AS (WITH RECURSIVE f AS (SELECT date, m, mu, 0 AS step, list_transform(mu, lambda x: 1 / k) AS w FROM d
  UNION ALL SELECT date, m, mu, step + 1, {PROJECTED} FROM f WHERE step < 100) SELECT * FROM f WHERE step = 100) {SHOWN}"""
REST = "(list_dot_product(m[step % k + 1], x) - m[step % k + 1][step % k + 1] * x[step % k + 1])"
SET = f"(sqrt({REST} * {REST} + 4 * m[step % k + 1][step % k + 1] / k) - {REST}) / (2 * m[step % k + 1][step % k + 1])"
PARITY = COVARIANCES.replace("WHERE n > 1)", "WHERE n > 1 AND (a <> b OR (xy - x * y / n) / (n - 1) > 0))") + f""", f AS (WITH RECURSIVE f AS (SELECT date, m, k, 0 AS step, list_transform(m, lambda row, i: 1 / sqrt(k * row[i])) AS x FROM d
  UNION ALL SELECT date, m, k, step + 1, list_transform(x, lambda v, i: CASE WHEN i = step % k + 1 THEN {SET} ELSE v END) FROM f WHERE step < 400 * k)
  SELECT date, m, list_transform(x, lambda v: v / list_sum(x)) AS w FROM f WHERE step = 400 * k) {SHOWN}"""


@query(MARKOWITZ)
def portfolio_mean_variance(spark, sf_dir):
    return rounded(portfolio.mean_variance_weights(A.returns(hourly(spark, sf_dir)), 24 * HOUR, 7))


@query(PARITY)
def portfolio_risk_parity(spark, sf_dir):
    return rounded(portfolio.risk_parity_weights(A.returns(hourly(spark, sf_dir)), 24 * HOUR, 7))
