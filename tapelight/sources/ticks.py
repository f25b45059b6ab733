"""Tick sources and sinks: line-delimited JSON, exchange payloads, and delta frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TICK_SCHEMA = "exchange string, symbol string, price decimal(18,8), quantity decimal(18,8), side string, trade_id string, exchange_ts_ms long, received_at_ms long"
#: Names of a field in exchanges' payloads, in the order in which they are looked up.
ALIASES = {"price": ("price", "p", "last"), "quantity": ("size", "qty", "q", "s", "quantity", "amount"), "trade_id": ("trade_id", "id", "t")}


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of a file of JSON lines with `error` set on lines that don't parse; blank lines and lines that begin with # are skipped."""
    lines = spark.read.text(path).where("trim(value) != '' AND NOT startswith(trim(value), '#')")
    parsed = lines.select("value", F.from_json("value", TICK_SCHEMA).alias("tick"))
    bad = F.col("tick.price").isNull() | F.col("tick.symbol").isNull()
    return parsed.select("tick.*", F.when(bad, F.col("value")).alias("error"))


def write_ndjson(ticks: DataFrame, path: str) -> None:
    ticks.write.json(path)


def replay(ticks: DataFrame, start_offset_ms: int = 0, most: int | None = None) -> DataFrame:
    """Ticks from start_offset_ms after the first on, in order; at most `most` of them."""
    first = ticks.agg(F.min("received_at_ms").alias("first"))
    kept = ticks.crossJoin(F.broadcast(first)).where(F.col("received_at_ms") >= F.col("first") + start_offset_ms).drop("first")  # one row
    ordered = kept.orderBy("received_at_ms")
    return ordered if most is None else ordered.limit(most)


def _number(payload: Column, field: str) -> Column:
    return F.coalesce(*(F.get_json_object(payload, f"$.{name}").try_cast("decimal(18,8)") for name in ALIASES[field]))


def normalise(raw: DataFrame) -> DataFrame:
    """Canonical ticks of raw ones (exchange, symbol, payload, received_at_ms); rows without price or quantity have `error` set.

    The side is read by each exchange's own rule: binance by `m` (the buyer is the maker: sell), coinbase by `side`;
    alpaca and polygon have none.
    """
    payload = F.col("payload")
    exchange = F.lower("exchange")
    maker, word = F.get_json_object(payload, "$.m"), F.lower(F.get_json_object(payload, "$.side"))
    side = F.when(exchange == "binance", F.when(maker == "true", "sell").when(maker == "false", "buy")).when(exchange == "coinbase", F.when(word.isin("buy", "b", "bid"), "buy").when(word.isin("sell", "s", "ask"), "sell"))
    price, quantity = _number(payload, "price"), _number(payload, "quantity")
    return raw.select(exchange.alias("exchange"), F.upper("symbol").alias("symbol"), price.alias("price"), quantity.alias("quantity"), side.alias("side"), F.coalesce(*(F.get_json_object(payload, f"$.{n}") for n in ALIASES["trade_id"])).alias("trade_id"), F.get_json_object(payload, "$.T").try_cast("long").alias("exchange_ts_ms"), "received_at_ms", F.when(price.isNull() | quantity.isNull(), "no price or quantity").alias("error"))


def delta_encode(ticks: DataFrame) -> DataFrame:
    """price_delta to the symbol's tick before (null for the first) and signed volume: small numbers that columnar formats pack well."""
    by = Window.partitionBy("symbol").orderBy("ts_ms", "trade_id")
    return ticks.select("symbol", "ts_ms", "trade_id", F.lag("price_ticks").over(by).alias("before"), "price_ticks", (F.col("side") * F.col("quantity")).alias("signed")).withColumn("price_delta", F.col("price_ticks") - F.col("before")).select("symbol", "ts_ms", "trade_id", "price_delta", F.when(F.col("before").isNull(), F.col("price_ticks")).alias("baseline"), "signed")


def delta_decode(frames: DataFrame) -> DataFrame:
    by = Window.partitionBy("symbol").orderBy("ts_ms", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    return frames.select("symbol", "ts_ms", "trade_id", F.sum(F.coalesce("price_delta", "baseline")).over(by).alias("price_ticks"), F.signum("signed").cast("int").alias("side"), F.abs("signed").alias("quantity"))


def run_lengths(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values: key, run (from 1), value, n."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = rows.withColumn("changed", (~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1)).cast("int"))
    numbered = changed.withColumn("run", F.sum("changed").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run", value).agg(F.count(F.lit(1)).alias("n"))
