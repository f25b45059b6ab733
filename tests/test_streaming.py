"""Streaming twins give what their batch twins give, over several micro-batches."""

import random

from tapelight.operators import carried
from tapelight.streaming import live, stateful

TICKS = "symbol string, trade_id long, ts_ms long, price double, quantity double, side int"
RULES = [carried.Rule("above", carried.price_above(150), "critical", cooldown_ms=600_000), carried.Rule("up", carried.price_change(50, 300_000, 1)), carried.Rule("band", carried.band_breakout(1.5, 10), "warning", "b")]


def streamed(spark, tmp_path, rows, schema, make, name):
    """The rows in order in six files, a micro-batch each."""
    for i in range(6):
        part = rows[len(rows) * i // 6 : len(rows) * (i + 1) // 6]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and len([p for p in query.recentProgress if p["numInputRows"]]) > 1
    return [tuple(r) for r in spark.table(name).collect()]


def tick_rows():
    rng = random.Random(1)
    return [(s, 2 * i + (s == "b"), i * 60_000, rng.choice([None, rng.uniform(1, 200), rng.uniform(1, 200)]), rng.uniform(0.5, 20), rng.choice([1, -1])) for i in range(120) for s in ("a", "b")]


def test_live_alerts(spark, tmp_path):
    rows = tick_rows()
    found = streamed(spark, tmp_path, rows, TICKS, lambda s: stateful.live_alerts(s, RULES, 20), "live_alerts")
    batch = [tuple(r) for r in carried.alerts(spark.createDataFrame(rows, TICKS), RULES, 20).collect()]
    assert sorted(found) == sorted(batch) and len(found) > 30


def test_live_positions(spark, tmp_path):
    rows = tick_rows()
    found = streamed(spark, tmp_path, rows, TICKS, stateful.live_positions, "live_positions")
    batch = [tuple(r) for r in carried.positions(spark.createDataFrame(rows, TICKS)).select("symbol", "trade_id", "position", "average_cost", "realised").collect()]
    assert sorted(found) == sorted(batch)


def test_live_health_and_deduplicated(spark, tmp_path):
    rows = [("f", "2024-01-01T00:00:10Z", 1), ("f", "2024-01-01T00:00:40Z", 2), ("f", "2024-01-01T00:00:41Z", 2), ("g", "2024-01-01T00:02:00Z", 3), ("f", "2024-01-01T00:10:00Z", 4), ("g", "2024-01-01T00:20:00Z", 5)]
    schema = "feed_id string, ts timestamp, n int"
    frame = spark.createDataFrame(rows, "feed_id string, ts string, n int").selectExpr("feed_id", "cast(ts AS timestamp) AS ts", "n")
    rows = [tuple(r) for r in frame.collect()]
    beats = streamed(spark, tmp_path, rows, schema, lambda s: live.health(s, "1 minute", "1 minute"), "live_health")
    assert [(f, n) for f, _, n, _ in sorted(beats)] == [("f", 3), ("f", 1), ("g", 1)]
    other = tmp_path / "other"
    unlike = streamed(spark, other, rows, schema, lambda s: live.deduplicated(s, ["feed_id", "n"], "1 minute"), "live_deduplicated")
    assert sorted((f, n) for f, _, n in unlike) == [("f", 1), ("f", 2), ("f", 4), ("g", 3), ("g", 5)]
