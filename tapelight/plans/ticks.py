"""The canonical tick stream over the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCHANGES = ("binance", "coinbase", "alpaca", "polygon")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, exchange, price, quantity, side (1 buy, -1 sell), trade_id, ts_ms."""
    exchange = F.element_at(F.array(*map(F.lit, EXCHANGES)), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        exchange.alias("exchange"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("side"),
        F.col("event_id").alias("trade_id"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_ms"),
    )
