"""Orders sent to venues: scores that follow outcomes, splits by score, slices over time, and filling by capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio
from .carried import Average, Run, folded

# What fills, fees and delays count for in a venue's score.
FILL, FEE, DELAY = 0.4, 0.3, 0.3


class Outcomes:
    """Exponential averages of a venue's fill rates and delays, from its first outcome."""

    def __init__(self, decay: float):
        self.fill, self.delay, self.n = Average(1, decay), Average(1, decay), 0

    def add(self, run: Run) -> None:
        self.fill(run["fill_rate"])
        self.delay(run["delay_ms"])
        self.n += len(run["fill_rate"])

    def rows(self) -> dict:
        return {"fill_rate": [self.fill.value], "delay_ms": [self.delay.value], "n": [self.n]}


def history(outcomes: DataFrame, decay: float, order: Sequence[str]) -> DataFrame:
    """venue, fill_rate, delay_ms, n: the averages after all of a venue's outcomes (venue, fill_rate, delay_ms) in order.

    An outcome without a rate or a delay is left out; a venue without any has no row.
    """
    there = outcomes.dropna(subset=["fill_rate", "delay_ms"]).select("venue", *order, F.col("fill_rate").cast("double").alias("fill_rate"), F.col("delay_ms").cast("double").alias("delay_ms"))
    return folded(there, "fill_rate double, delay_ms double, n long", lambda: Outcomes(decay), key=["venue"], order=order)


def scored(venues: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """venues (venue, fee_bps, fill_rate, delay_ms and others) with `score`, by `history`'s averages in place of their own where there are some.

    0 without a fee or a delay above 0.
    """
    if seen is not None:
        venues = venues.join(seen.select("venue", F.col("fill_rate").alias("seen_fill"), F.col("delay_ms").alias("seen_delay")), "venue", "left")
        use = F.col("seen_delay") > 0
        venues = venues.withColumns({"fill_rate": F.when(use, F.col("seen_fill")).otherwise(F.col("fill_rate")), "delay_ms": F.when(use, F.col("seen_delay")).otherwise(F.col("delay_ms"))}).drop("seen_fill", "seen_delay")
    score = FILL * F.col("fill_rate") + FEE * ratio(F.lit(1.0), "fee_bps") + DELAY * ratio(F.lit(1.0), "delay_ms")
    return venues.withColumn("score", F.when((F.col("fee_bps") > 0) & (F.col("delay_ms") > 0), score).otherwise(0.0))


def routed(orders: DataFrame, venues: DataFrame, market: str, threshold: float, most: int) -> DataFrame:
    """order_id, venue, place (from 1), quantity, cost_bps: each order over the venues of its market.

    An order of less than `threshold` goes to the best venue, a larger one to the `most` best in proportion to their
    scores (in equal parts if they are all 0). Of equal scores the least venue is better. cost_bps is the mean fee by
    quantity. Only the best of each market meet the orders, so a market's orders are many but its rows to join few. Orders
    without a quantity, or of a market without venues, give no row.
    """
    by = Window.partitionBy(market)
    ranked = venues.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "venue"))).where(F.col("place") <= most)
    total = F.sum("score").over(by)
    ranked = ranked.withColumn("part", F.when(total > 0, ratio("score", total)).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(by)))
    ranked = ranked.withColumn("cost", F.sum(F.col("part") * F.col("fee_bps")).over(by)).select(market, "venue", "place", "part", "fee_bps", "cost")
    small = F.col("quantity") < threshold
    met = orders.where("quantity IS NOT NULL").join(ranked, market).where(~small | (F.col("place") == 1))
    return met.select("order_id", "venue", F.col("place").cast("long").alias("place"), F.when(small, F.col("quantity")).otherwise(F.col("quantity") * F.col("part")).alias("quantity"), F.when(small, F.col("fee_bps")).otherwise(F.col("cost")).alias("cost_bps"))


def sliced(orders: DataFrame, profile: Sequence[float]) -> DataFrame:
    """order_id, slice (from 0), quantity: an order over time in proportion to a profile of volumes; equal parts where they add up to 0."""
    total = sum(profile)
    parts = [x / total for x in profile] if total > 0 else [1 / len(profile)] * len(profile)
    return orders.select("order_id", "quantity", F.posexplode(F.array(*map(F.lit, parts))).alias("slice", "part")).select("order_id", "slice", (F.col("quantity") * F.col("part")).alias("quantity"))


def _blocks(rows: DataFrame, market: str, key: Column, size: int) -> DataFrame:
    """rows with `block`: which of the runs of about `size` rows, in the order of `key`, a row of its market is in.

    The bounds are the keys that a hash picks, so equal rows always fall into the same block; they are found by bisection.
    """
    keyed = rows.withColumn("key", key)
    bounds = keyed.where(F.pmod(F.xxhash64(market, "key"), F.lit(size)) == 0).groupBy(market).agg(F.sort_array(F.collect_set("key")).alias("bounds"))
    bounds = bounds.withColumn("steps", F.filter(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), lambda step: step <= F.size("bounds")))
    below = F.aggregate("steps", F.lit(0), lambda at, step: F.when(at + step <= F.size("bounds"), F.when(F.get("bounds", at + step - 1) < F.col("key"), at + step).otherwise(at)).otherwise(at))
    return keyed.join(F.broadcast(bounds), market, "left").withColumn("block", F.when(F.col("bounds").isNull(), 0).otherwise(below)).drop("bounds", "steps")


def _laid_out(rows: DataFrame, market: str, amount: str, order: Sequence[str | Column], begin: str, end: str) -> tuple[DataFrame, DataFrame]:
    """rows with `begin` and `end` on their market's line of running amounts, and the ends of its blocks (market, block, low, high)."""
    line, inside = Window.partitionBy(market).orderBy("block"), Window.partitionBy(market, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(market, "block").agg(F.sum(amount).alias("total")).withColumn("high", F.sum("total").over(line)).select(market, "block", (F.col("high") - F.col("total")).alias("low"), "high")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartition(n, market, "block").withColumn("running", F.sum(amount).over(inside)).join(F.broadcast(ends.drop("high")), [market, "block"])
    return out.withColumn(end, F.col("low") + F.col("running")).withColumn(begin, F.col(end) - F.col(amount)).drop("running", "low"), ends


def filled(orders: DataFrame, offers: DataFrame, market: str, side: str = "buy", size: int = 1 << 15) -> DataFrame:
    """order_id, offer_id, filled, price: orders of a market served one after the other (by order_id) from its offers, the best price first.

    What an offer (offer_id, price, size) holds beyond an order is left for the next. Both are laid out on one line of
    running quantities and meet where their intervals overlap, so nothing is carried from order to order. Orders beyond all
    offers stay open; equal prices go by offer_id. Rows without a market, or a quantity or size above 0, are left out.

    Each side is cut into blocks of about `size` rows, whose totals place them on the line. A pair of blocks that overlap
    is matched on its own, so a task needs a pair and not a market, however quantities are spread.
    """
    price = F.col("price") if side == "buy" else -F.col("price")
    best = F.asc("price") if side == "buy" else F.desc("price")
    there = F.col(market).isNotNull()
    wanted = _blocks(orders.where(there & F.expr("quantity > 0")).select(market, "order_id", "quantity"), market, F.struct("order_id"), size)
    wanted, of_orders = _laid_out(wanted.drop("key"), market, "quantity", ["order_id"], "begin", "until")
    held = _blocks(offers.where(there & F.expr("size > 0")).select(market, "offer_id", "price", "size"), market, F.struct((F.lit(side == "sell") & F.col("price").isNull()).alias("last"), price.alias("price"), "offer_id"), size)
    held, of_offers = _laid_out(held.drop("key"), market, "size", [best, "offer_id"], "first", "offered")
    n = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few rows: two for each end of a block.
    a, b = of_orders.withColumnsRenamed({"block": "order_block", "low": "a", "high": "b"}), of_offers.withColumnsRenamed({"block": "offer_block", "low": "c", "high": "d"})
    pairs = a.join(b, market).where("a < d AND c < b").select(market, "order_block", "offer_block", F.greatest("a", "c").alias("low"), F.least("b", "d").alias("high"))
    left = wanted.withColumnRenamed("block", "order_block").join(F.broadcast(pairs), [market, "order_block"]).where("begin < high AND until > low")
    right = held.withColumnRenamed("block", "offer_block").join(F.broadcast(pairs), [market, "offer_block"]).where("first < high AND offered > low")
    # An interval overlap by merging: each begin finds what is open on the other side, instead of joining all with all.
    place = [market, "order_block", "offer_block"]
    order, offer = F.struct("begin", "until", "order_id"), F.struct("first", "offered", "offer_id", "price")
    merged = left.select(*place, F.greatest("begin", "low").alias("at"), order.alias("order")).unionByName(right.select(*place, F.greatest("first", "low").alias("at"), offer.alias("offer")), allowMissingColumns=True)
    line = Window.partitionBy(*place).orderBy("at")
    open_now = merged.repartition(n, *place).select(*place, "at", F.max("order").over(line).alias("order"), F.max("offer").over(line).alias("offer")).distinct()
    until = F.least(F.col("order.until"), F.col("offer.offered"))
    met = open_now.where(F.col("order").isNotNull() & F.col("offer").isNotNull() & (until > F.col("at")))
    return met.select(F.col("order.order_id").alias("order_id"), F.col("offer.offer_id").alias("offer_id"), (until - F.col("at")).alias("filled"), F.col("offer.price").alias("price"))
