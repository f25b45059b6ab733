"""Market events from JSON payloads of any feed, and FIX messages: built-in functions only, each payload parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which feeds send a field, in the order in which they are looked up.
NAMES = {
    "symbol": ("symbol", "sym", "s", "product_id", "ticker"),
    "price": ("price", "p", "last"),
    "size": ("size", "qty", "q", "quantity", "amount"),
    "side": ("side", "taker_side"),
    "trade_id": ("trade_id", "id", "t"),
    "bid": ("bid", "bid_price", "bp"),
    "ask": ("ask", "ask_price", "ap"),
    "bid_size": ("bid_size", "bid_qty", "bs"),
    "ask_size": ("ask_size", "ask_qty", "as"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c"),
    "volume": ("volume", "vol", "v"),
    "vwap": ("vwap", "vw"),
    "trade_count": ("trade_count", "n"),
    "period_secs": ("period_secs", "period"),
    "sequence": ("sequence", "seq", "u"),
    "is_snapshot": ("is_snapshot", "snapshot"),
    "message": ("message", "msg"),
    "ns": ("timestamp_ns", "ts_ns"),
    "time": ("timestamp", "ts", "time", "t"),
}
#: Words for the states of a feed; all others are connected.
STATES = {"disconnected": "disconnected", "disconnect": "disconnected", "error": "error", "throttled": "throttled", "rate_limited": "throttled", "subscribed": "subscribed", "subscribe": "subscribed"}
SOH = "\x01"


def nanoseconds(time: Column) -> Column:
    """Epoch nanoseconds of a time in unknown units: above 10^15 nanoseconds, above 10^12 microseconds, else milliseconds."""
    return F.when(time > 10**15, time).when(time > 10**12, F.try_multiply(time, F.lit(1000))).otherwise(time * 1_000_000)


def parse_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows with kind (trade, quote, bar, book or status; else null), symbol, timestamp_ns and a struct for each kind.

    `type` names the kind; without it the fields that are there do. A payload that isn't a JSON object, or lacks what its
    kind needs, has a null kind, and all else is null. JSON nulls count as missing, numbers may be strings, times that
    are missing are 0. Levels of a book are pairs of price and size. Null payloads have a null kind; no rows give none.
    """
    fields = F.from_json(payload, "map<string,string>")

    def text(field: str) -> Column:
        return F.coalesce(*(F.try_element_at("_fields", F.lit(n)) for n in NAMES.get(field, (field,))))

    def number(field: str, kind: str = "double") -> Column:
        return F.coalesce(*(F.try_element_at("_fields", F.lit(n)).try_cast(kind) for n in NAMES[field]))

    def has(*keys: str) -> Column:
        found = F.lit(True)
        for key in keys:
            found = found & F.try_element_at("_fields", F.lit(key)).isNotNull()
        return found

    def pairs(field: str) -> Column:
        read = F.from_json(text(field), "array<array<string>>")
        levels = F.transform(read, lambda x: F.struct(F.get(x, 0).try_cast("double").alias("price"), F.get(x, 1).try_cast("double").alias("size")))
        return F.filter(levels, lambda x: x.price.isNotNull() & x.size.isNotNull())

    own = F.coalesce(text("type"), F.lit(""))
    bare = own == ""
    kind = (
        F.when((own == "trade") | (bare & has("price", "size")), "trade").when((own == "quote") | (bare & has("bid", "ask")), "quote")
        .when((own == "bar") | (bare & has("open", "high", "low", "close")), "bar").when((own == "book") | (bare & has("bids", "asks")), "book").when((own == "status") | (bare & has("status")), "status")
    )
    word = F.lower(text("side"))
    side = F.when(word.isin("buy", "b", "bid"), "buy").when(word.isin("sell", "s", "ask"), "sell")
    state = F.coalesce(text("status"), F.lit("connected"))
    states = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    parts = {
        "trade": F.struct(number("price").alias("price"), number("size").alias("size"), side.alias("side"), text("trade_id").alias("trade_id")),
        "quote": F.struct(number("bid").alias("bid"), number("ask").alias("ask"), F.coalesce(number("bid_size"), F.lit(0.0)).alias("bid_size"), F.coalesce(number("ask_size"), F.lit(0.0)).alias("ask_size")),
        "bar": F.struct(
            *(number(c).alias(c) for c in ("open", "high", "low", "close")), F.coalesce(number("volume"), F.lit(0.0)).alias("volume"), number("vwap").alias("vwap"),
            number("trade_count", "int").alias("trade_count"), F.coalesce(number("period_secs", "int"), F.lit(60)).alias("period_secs"),
        ),
        "book": F.struct(pairs("bids").alias("bids"), pairs("asks").alias("asks"), F.coalesce(number("sequence", "long"), F.lit(0)).alias("sequence"), F.coalesce(text("is_snapshot") == "true", F.lit(False)).alias("is_snapshot")),
        "status": F.struct(F.coalesce(F.try_element_at(states, F.lower(state)), F.lit("connected")).alias("status"), F.coalesce(text("message"), state).alias("message")),
    }
    needs = {"trade": ("price", "size"), "quote": ("bid", "ask"), "bar": ("open", "high", "low", "close"), "book": ("bids", "asks")}
    complete = F.lit(True)
    for name, columns in needs.items():
        missing = text("symbol").isNull()
        for c in columns:
            missing = missing | F.col(f"_{name}.{c}").isNull()
        complete = complete & ~((F.col("_kind") == name) & missing)
    stamp = F.coalesce(number("ns", "long"), nanoseconds(text("time").try_cast("long")), F.lit(0))
    out = raw.withColumn("_fields", fields).withColumns({"_kind": kind} | {f"_{name}": part for name, part in parts.items()})
    out = out.withColumn("_kind", F.when(complete, F.col("_kind")))
    there = F.col("_kind").isNotNull()
    return out.select(
        *(c for c in raw.columns), F.col("_kind").alias("kind"), F.when(there, text("symbol")).alias("symbol"), F.when(there, stamp).alias("timestamp_ns"),
        *(F.when(F.col("_kind") == name, F.col(f"_{name}")).alias(name) for name in parts),
    )


def byte_sum(text: Column) -> Column:
    """Sum of a text's UTF-8 bytes modulo 256."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.aggregate(pairs, F.lit(0), lambda total, x: (total + F.conv(x, 16, 10).cast("int")) % 256)


def fix_message(kind: Column, fields: Column) -> Column:
    """A FIX 4.2 message of a type and a map of tag (int) to value: tags in ascending order, with body length and checksum."""
    tags = F.array_sort(F.filter(F.map_entries(fields), lambda e: ~e.key.isin(8, 9, 10, 35)))
    body = F.concat(F.lit("35="), kind, F.lit(SOH), F.array_join(F.transform(tags, lambda e: F.concat(e.key.cast("string"), F.lit("="), e.value, F.lit(SOH))), ""))
    framed = F.concat(F.lit(f"8=FIX.4.2{SOH}9="), F.octet_length(body).cast("string"), F.lit(SOH), body)
    return F.concat(framed, F.lit("10="), F.lpad(byte_sum(framed).cast("string"), 3, "0"), F.lit(SOH))


def parse_fix(raw: DataFrame, message: str = "message") -> DataFrame:
    """The rows with fields (array of tag, value), msg_type and error, which says why a message can't be used; null if it can.

    Of a repeated tag the last value counts. Null messages have an error, as have empty ones.
    """
    parts = F.filter(F.split(F.coalesce(F.col(message), F.lit("")), SOH), lambda x: x != "")
    entries = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).try_cast("int").alias("tag"), F.when(F.instr(x, F.lit("=")) > 0, F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x))).alias("value")))
    out = raw.withColumn("_entries", entries)
    value = lambda tag: fix_value(F.col("_entries"), tag)
    before = F.substring_index(F.concat(F.lit(SOH), F.col(message)), f"{SOH}10=", 1)
    summed = byte_sum(F.concat(F.substring(before, 2, F.length(before)), F.lit(SOH)))
    error = (
        F.when(F.exists("_entries", lambda e: e.value.isNull()), "a field has no separator").when(F.exists("_entries", lambda e: e.tag.isNull()), "a tag isn't a number")
        .when(value(8).isNull(), "tag 8 is missing").when(value(8) != "FIX.4.2", "the version isn't FIX.4.2").when(value(10).isNull(), "tag 10 is missing")
        .when(value(10).try_cast("int").isNull(), "the checksum isn't a number").when(value(10).try_cast("int") != summed, "the checksum is wrong").when(value(35).isNull(), "tag 35 is missing")
    )
    return out.select(*raw.columns, F.col("_entries").alias("fields"), value(35).alias("msg_type"), error.alias("error"))


def fix_value(fields: Column, tag: int) -> Column:
    """The last value of a tag among a message's fields; null if it isn't there."""
    return F.try_element_at(F.filter(fields, lambda e: e.tag == tag), F.lit(-1)).value
