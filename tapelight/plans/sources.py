"""Queries over what sources and sinks write and read back, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tick_files
from ..sources import ticks as S
from ..sources.shared import folder
from .catalog import query
from .ticks import ticks

FIRST, LAST = 1_704_400_000_000, 1_705_600_000_000


def written(spark, sf_dir) -> str:
    path = folder(spark)
    tick_files.write_ticks(ticks(spark, sf_dir).withColumnRenamed("ts_ms", "timestamp_ms"), path)
    return path


@query(f"""{{T}} SELECT symbol, price, quantity, ts_ms AS timestamp_ms, exchange FROM t WHERE ts_ms BETWEEN {FIRST} AND {LAST}""")
def sources_tick_files(spark, sf_dir):
    return tick_files.read_ticks(spark, written(spark, sf_dir), FIRST, LAST).drop("file", "offset")


@query("""{T} SELECT symbol, count(*) AS record_count, min(ts_ms) AS min_timestamp_ms, max(ts_ms) AS max_timestamp_ms FROM t GROUP BY 1""")
def sources_tick_index(spark, sf_dir):
    return tick_files.tick_index(tick_files.read_ticks(spark, written(spark, sf_dir))).drop("first_file", "byte_offset")


def in_cents(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("price_ticks", F.round(F.col("price") * 100).cast("long"))


CENTS = "{T}, c AS (SELECT *, CAST(round(price * 100) AS BIGINT) AS price_ticks FROM t)"


@query(CENTS + """ SELECT symbol, ts_ms, trade_id, price_ticks - lag(price_ticks) OVER w AS price_delta, CASE WHEN lag(price_ticks) OVER w IS NULL THEN price_ticks END AS baseline, side * quantity AS signed FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, trade_id)""")
def sources_delta_frames(spark, sf_dir):
    return S.delta_encode(in_cents(spark, sf_dir))


@query(CENTS + " SELECT symbol, ts_ms, trade_id, price_ticks, CASE WHEN quantity = 0 THEN 0 ELSE side END AS side, quantity FROM c")
def sources_delta_round_trip(spark, sf_dir):
    return S.delta_decode(S.delta_encode(in_cents(spark, sf_dir)))


@query("""{T}, f AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id) THEN 0 ELSE 1 END AS turned FROM t),
r AS (SELECT *, sum(turned) OVER (PARTITION BY symbol ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT symbol, CAST(run AS BIGINT) AS run, side, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def sources_run_lengths(spark, sf_dir):
    return S.run_lengths(ticks(spark, sf_dir), "symbol", ["ts_ms", "trade_id"], "side")


@query("""{T}, m AS (SELECT min(ts_ms) + 86400000 AS first FROM t) SELECT symbol, exchange, CAST(trade_id AS VARCHAR) AS trade_id, price, CASE WHEN side > 0 THEN 'buy' ELSE 'sell' END AS side, ts_ms AS received_at_ms FROM t, m WHERE ts_ms >= first""")
def sources_ndjson_replay(spark, sf_dir):
    path = folder(spark)
    named = ticks(spark, sf_dir).select("exchange", "symbol", "price", "quantity", F.when(F.col("side") > 0, "buy").otherwise("sell").alias("side"), F.col("trade_id").cast("string").alias("trade_id"), F.col("ts_ms").alias("received_at_ms"))
    S.write_ndjson(named, path)
    read = S.read_ndjson(spark, path).where("error IS NULL")
    return S.replay(read, 86_400_000).select("symbol", "exchange", "trade_id", F.col("price").cast("double").alias("price"), "side", "received_at_ms")
