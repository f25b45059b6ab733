"""Measures of an order book's depth, over the levels that `book.state` leaves: one aggregate a symbol, no row for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio
from .book import levels


def _sides() -> tuple[Column, Column]:
    return F.col("side") == "bid", F.col("side") == "ask"


def with_touch(book: DataFrame) -> DataFrame:
    """The levels with their symbol's best prices, best_bid and best_ask."""
    is_bid, is_ask = _sides()
    touch = book.groupBy("symbol").agg(F.max(F.when(is_bid, F.col("price"))).alias("best_bid"), F.min(F.when(is_ask, F.col("price"))).alias("best_ask"))
    return book.join(touch, "symbol")


def _total(test: Column) -> Column:
    """Quantity of the levels that pass; 0 if none does."""
    return F.coalesce(F.sum(F.when(test, F.col("quantity"))), F.lit(0.0))


def depth_measures(book: DataFrame, at: float, distance: float, percent: float, wall: float, step: float) -> DataFrame:
    """Per symbol: counts and volumes about a price `at`, within `distance` and `percent` of the touch, walls, ranges and densities.

    A wall is the level nearest to the touch with `wall` or more. A range needs two levels of the side, and a density a
    range above 0; a symbol with one side only has nulls where the other is needed.
    """
    price, quantity = F.col("price"), F.col("quantity")
    is_bid, is_ask = _sides()
    bid, ask = F.first("best_bid"), F.first("best_ask")
    bids, asks, bid_volume, ask_volume = F.count_if(is_bid), F.count_if(is_ask), _total(is_bid), _total(is_ask)
    mid = (bid + ask) / 2
    worst_bid, worst_ask = F.min(F.when(is_bid, price)), F.max(F.when(is_ask, price))
    share = percent / 100
    measures = {
        "count_imbalance": ratio(bids - asks, bids + asks), "volume_ratio": F.when(bid_volume > 0, ratio(bid_volume, ask_volume)), "bids_above": F.count_if(is_bid & (price > at)), "asks_below": F.count_if(is_ask & (price < at)),
        "bid_range": F.when(bids >= 2, bid - worst_bid), "ask_range": F.when(asks >= 2, worst_ask - ask), "whole_range": ask - worst_bid, "spread_share": ratio(ask - bid, mid), "spread_steps": (ask - bid) / step,
        "bid_within": _total(is_bid & (price >= F.col("best_bid") - distance)), "ask_within": _total(is_ask & (price <= F.col("best_ask") + distance)), "bid_below": _total(is_bid & (price < at)), "ask_above": _total(is_ask & (price > at)),
        "bid_depth_pct": _total(is_bid & (price >= F.col("best_bid") * (1 - share))), "ask_depth_pct": _total(is_ask & (price <= F.col("best_ask") * (1 + share))), "value_at": F.sum(F.when(price == at, price * quantity)),
        "bid_wall": F.max(F.when(is_bid & (quantity >= wall), price)), "ask_wall": F.min(F.when(is_ask & (quantity >= wall), price)), "bid_density": F.when(bids >= 2, ratio(bids, bid - worst_bid)), "ask_density": F.when(asks >= 2, ratio(asks, worst_ask - ask)),
    }
    return with_touch(book).groupBy("symbol").agg(*(c.alias(name) for name, c in measures.items()))


def walked(book: DataFrame, quantity: float, fee_bps: float) -> DataFrame:
    """Per symbol and side, taking `quantity` level by level: mean price of what is there, full price and impact, and the fee.

    `full_price` and `impact` (against the best price) are null where the side has less; the fee then counts no impact.
    """
    rows = levels(book, 1 << 30)
    taken = F.greatest(F.least(F.col("quantity"), quantity - (F.col("cumulative") - F.col("quantity"))), F.lit(0.0))
    out = rows.groupBy("symbol", "side").agg(
        F.sum(taken).alias("filled"), F.sum(F.col("price") * taken).alias("cost"), F.sum("quantity").alias("depth"), F.min_by("price", "rank").alias("best")
    )
    out = out.withColumn("mean_price", ratio("cost", "filled"))
    out = out.withColumn("full_price", F.when(F.col("depth") >= quantity, F.col("mean_price")))
    out = out.withColumn("impact", F.abs(F.col("full_price") - F.col("best")))
    fee = (F.col("best") + F.coalesce("impact", F.lit(0.0))) * quantity * fee_bps / 10_000
    return out.select("symbol", "side", "filled", "mean_price", "full_price", "impact", fee.alias("fee"))


def depth_ratio(book: DataFrame, n: int) -> DataFrame:
    """Quantity of the n best bids over that of the n best asks; null without asks."""
    is_bid, is_ask = _sides()
    own = levels(book, n).groupBy("symbol").agg(_total(is_bid).alias("bid"), F.sum(F.when(is_ask, F.col("quantity"))).alias("ask"))
    return own.select("symbol", ratio("bid", "ask").alias("depth_ratio"))


def depth_chart(book: DataFrame, n: int) -> DataFrame:
    """The n best levels of both sides with the share of the side's shown quantity up to each."""
    shown = levels(book, n)
    whole = F.sum("quantity").over(Window.partitionBy("symbol", "side"))
    return shown.select("symbol", "side", "rank", "price", "cumulative", ratio(F.col("cumulative"), whole).alias("share"))
