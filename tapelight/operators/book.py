"""Order books as rows (symbol, side, price, quantity): state from deltas, and measures of the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio


def state(deltas: DataFrame) -> DataFrame:
    """The levels after all deltas (symbol, side bid or ask, price, quantity, sequence): the last one of a price wins, 0 removes it."""
    last = deltas.groupBy("symbol", "side", "price").agg(F.max_by("quantity", "sequence").alias("quantity"))
    return last.where("quantity > 0")


def sequence_gaps(deltas: DataFrame) -> DataFrame:
    """Deltas whose sequence isn't the one after the delta before."""
    before = F.lag("sequence").over(Window.partitionBy("symbol").orderBy("ts_ms", "sequence"))
    return deltas.withColumn("expected", before + 1).where("sequence != expected")


def levels(book: DataFrame, n: int) -> DataFrame:
    """The n best levels of both sides, rank from 1, with cumulative quantity."""
    better = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    by = Window.partitionBy("symbol", "side").orderBy(better)
    ranked = book.withColumn("rank", F.row_number().over(by)).withColumn("cumulative", F.sum("quantity").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("rank") <= n)


def _of(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def metrics(book: DataFrame, n: int = 5) -> DataFrame:
    """Touch, mid, spread, micro-price and imbalance at the touch, over n levels and in all."""
    top = levels(book, n)
    ranked = book.groupBy("symbol").agg(*(F.sum(_of(s, F.col("quantity"))).alias(f"{s}_total") for s in ("bid", "ask")), *(F.sum(_of(s, F.col("price") * F.col("quantity"))).alias(f"{s}_notional") for s in ("bid", "ask")))
    first = F.col("rank") == 1
    touch = top.groupBy("symbol").agg(
        *(F.max(F.when(first, _of(s, F.col("price")))).alias(s) for s in ("bid", "ask")), *(F.max(F.when(first, _of(s, F.col("quantity")))).alias(f"{s}_qty") for s in ("bid", "ask")), *(F.sum(_of(s, F.col("quantity"))).alias(f"{s}_top") for s in ("bid", "ask")),
    )
    out = touch.join(ranked, "symbol")
    mid = (F.col("bid") + F.col("ask")) / 2
    imbalance = lambda a, b: ratio(F.col(a) - F.col(b), F.col(a) + F.col(b))
    return out.select(
        "symbol", "bid", "ask", mid.alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"), ((F.col("ask") - F.col("bid")) / mid * 1e4).alias("spread_bps"), (F.col("bid") >= F.col("ask")).alias("is_crossed"),
        ratio(F.col("bid") * F.col("ask_qty") + F.col("ask") * F.col("bid_qty"), F.col("bid_qty") + F.col("ask_qty")).alias("microprice"), imbalance("bid_qty", "ask_qty").alias("touch_imbalance"), imbalance("bid_top", "ask_top").alias("top_imbalance"), imbalance("bid_total", "ask_total").alias("total_imbalance"),
        (F.col("bid_notional") + F.col("ask_notional")).alias("notional"),
    )


def fill_price(book: DataFrame, side: str, quantity: float) -> DataFrame:
    """Average price of taking `quantity` from a side level by level; null if the side has less."""
    walked = levels(book.where(F.col("side") == side), 1 << 30)
    taken = F.greatest(F.least(F.col("quantity"), quantity - (F.col("cumulative") - F.col("quantity"))), F.lit(0.0))
    return walked.groupBy("symbol").agg(F.when(F.sum("quantity") >= quantity, F.sum(F.col("price") * taken) / quantity).alias("fill_price"))


def touch_flow(quotes: DataFrame) -> DataFrame:
    """Order-flow imbalance of successive best quotes: what was added at the bid less what was added at the ask; the first is 0."""
    by = Window.partitionBy("symbol").orderBy("ts_ms", "trade_id")
    b, bq, a, aq = (F.lag(c).over(by) for c in ("bid", "bid_qty", "ask", "ask_qty"))
    at_bid = F.when(F.col("bid") > b, F.col("bid_qty")).when(F.col("bid") == b, F.col("bid_qty") - bq).otherwise(-bq)
    at_ask = F.when(F.col("ask") < a, F.col("ask_qty")).when(F.col("ask") == a, F.col("ask_qty") - aq).otherwise(-aq)
    return quotes.select("symbol", "trade_id", F.coalesce(at_bid - at_ask, F.lit(0.0)).alias("ofi"))
