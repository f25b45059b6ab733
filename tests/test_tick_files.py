"""The binary tick source: round trips in splits of any size, torn bytes, ranges, overwriting, and queries' helpers."""

import random

import pytest

from tapelight.sources import tick_files as T

SCHEMA = "symbol string, price double, quantity double, timestamp_ms long, exchange string"


def rows_of(n=300, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "", "syém", "x" * 300]), rng.uniform(-1, 1), float(i), rng.randint(0, 1000), rng.choice(["nyse", "日本", ""])) for i in range(n)]


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, split):
    rows = rows_of()
    T.write_ticks(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/t")
    found = T.read_ticks(spark, f"file:{tmp_path}/t", split_bytes=split).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(rows) and T.torn_bytes(spark, f"{tmp_path}/t", split).count() == 0
    some = T.read_ticks(spark, f"{tmp_path}/t", 100, 200, split).collect()
    assert sorted(tuple(r)[:5] for r in some) == sorted(r for r in rows if 100 <= r[3] <= 200)


def test_torn_files(spark, tmp_path):
    """A cut record, noise and magic bytes inside a record, whatever the splits; every byte is in a record or reported."""
    rows = rows_of(40, seed=2)
    whole = [T.to_bytes(*r) for r in rows]
    noise = bytes(random.Random(3).randrange(256) for _ in range(500))
    broken = T.MAGIC + b"\xff\xff\xff\xff" + b"too long"
    data = noise + b"".join(whole[:20]) + whole[20][:25] + b"".join(whole[21:30]) + broken + b"".join(whole[30:39]) + whole[39][:-1]
    (tmp_path / "one.ticks").write_bytes(data)
    (tmp_path / "empty.ticks").write_bytes(b"")
    (tmp_path / "_unfinished.ticks").write_bytes(whole[0])
    want = sorted(rows[:20] + rows[21:39])
    assert sorted(t for _, t, _ in T.records(data) if t) == want
    for split in (50, 333, 1 << 20):
        read = T.read_ticks(spark, str(tmp_path), split_bytes=split).collect()
        assert sorted(tuple(r)[:5] for r in read) == want
        assert all(data[r.offset : r.offset + 8] == T.MAGIC for r in read)
        torn = sum(r.length for r in T.torn_bytes(spark, str(tmp_path), split).collect())
        assert torn + sum(len(T.to_bytes(*r)) for r in want) == len(data)


def test_records_longer_than_what_is_read_ahead(spark, tmp_path, monkeypatch):
    rows = [("s" * 200_000, 1.0, 2.0, 3, "x"), ("t", 1.0, 2.0, 4, "y" * 90_000), ("u", 0.0, 0.0, 5, "")]
    T.write_ticks(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/t")
    assert sorted(tuple(r)[:5] for r in T.read_ticks(spark, f"{tmp_path}/t", split_bytes=70_000).collect()) == sorted(rows)


def test_nulls_modes_and_index(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [("a", 1.0, 2.0, 30, "x"), (None, 1.0, 2.0, 3, "x"), ("a", None, 2.0, 3, "x"), ("a", 1.0, 2.0, -1, "x"), ("a", 1.0, 2.0, 10, "y"), ("b", 1.0, 2.0, 20, None)]
    T.write_ticks(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    T.write_ticks(spark.createDataFrame(rows[:1], SCHEMA).coalesce(1), path)
    (index,) = T.tick_index(T.read_ticks(spark, path)).collect()
    assert (index.symbol, index.record_count, index.min_timestamp_ms, index.max_timestamp_ms, index.byte_offset) == ("a", 3, 10, 30, 0)
    T.write_ticks(spark.createDataFrame(rows[:1], SCHEMA), path, "overwrite")
    assert [tuple(r)[:5] for r in T.read_ticks(spark, path).collect()] == rows[:1]
    T.write_ticks(spark.createDataFrame([], SCHEMA), path, "overwrite")
    assert T.read_ticks(spark, path).count() == 0


def test_bytes():
    data = T.to_bytes("ab", 1.5, 2.0, 7, "c")
    assert T.from_bytes(data) == (("ab", 1.5, 2.0, 7, "c"), len(data)) and len(data) == 8 + 4 + 2 + 24 + 4 + 1
    assert all(T.from_bytes(data[:n]) is None for n in range(len(data))) and T.from_bytes(b"x" + data) is None and T.from_bytes(b"x" + data, 1) is not None
    assert T.from_bytes(T.MAGIC + T.LENGTH.pack(1) + b"\xff" + bytes(28)) is None
