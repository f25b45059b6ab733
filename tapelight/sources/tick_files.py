"""Binary tick files as a data source: `spark.read.format("ticks").load(path)` and `df.write.format("ticks").save(path)`.

A file is a row of records, each eight fixed bytes, the symbol, price, quantity, time and exchange (see `to_bytes`).
Files are read in splits of bytes. A record belongs to the split in which it begins; a split starts looking BACK bytes
before its own, so that it is in step with the records once it gets there. Bytes that aren't part of a record (a torn
write, say) are passed over, and reported with the option `torn`. Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The bytes that a record begins with, and its fields (little endian; texts are UTF-8 behind their length).
MAGIC = bytes([0xDE, 0xAD, 0xBE, 0xEF, 0x01, 0x02, 0x03, 0x04])
NUMBERS, LENGTH = struct.Struct("<ddQ"), struct.Struct("<I")
FIELDS = "symbol string, price double, quantity double, timestamp_ms long, exchange string"
PLACES = "file string, offset long"
SPLIT, BACK, BATCH = 16 << 20, 1 << 16, 10_000

Tick = tuple[str, float, float, int, str]


def to_bytes(symbol: str, price: float, quantity: float, timestamp_ms: int, exchange: str) -> bytes:
    name, venue = symbol.encode(), exchange.encode()
    return MAGIC + LENGTH.pack(len(name)) + name + NUMBERS.pack(price, quantity, timestamp_ms) + LENGTH.pack(len(venue)) + venue


def from_bytes(data: bytes, at: int = 0) -> tuple[Tick, int] | None:
    """The record at a place and where the next may begin; None if there isn't a whole one."""
    if data[at : at + 8] != MAGIC or len(data) < at + 12:
        return None
    begin = at + 12
    numbers = begin + LENGTH.unpack_from(data, at + 8)[0]
    venue = numbers + NUMBERS.size + 4
    if len(data) < venue:
        return None
    end = venue + LENGTH.unpack_from(data, venue - 4)[0]
    if len(data) < end:
        return None
    try:
        symbol, exchange = data[begin:numbers].decode(), data[venue:end].decode()
    except UnicodeDecodeError:
        return None
    price, quantity, time = NUMBERS.unpack_from(data, numbers)
    return (symbol, price, quantity, time, exchange), end


def records(data: bytes) -> Iterator[tuple[int, Tick | None, int]]:
    """Place, record and end of all records; None in place of the record for bytes between them."""
    at = 0
    while at < len(data):
        torn = at
        while (found := from_bytes(data, at)) is None:
            at = data.find(MAGIC, at + 1)
            if at < 0:
                yield torn, None, len(data)
                return
        if at > torn:
            yield torn, None, at
        yield at, *found
        at = found[1]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else path)


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int
    size: int


class TickReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        self.first, self.last = int(options.get("startms", 0)), int(options.get("endms", (1 << 63) - 1))
        self.torn = options.get("torn", "false").lower() == "true"

    def partitions(self) -> list[Split]:
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Split(name, a, min(a + self.split, size), size) for name, size in files for a in range(0, size, self.split)] or [Split("", 0, 0, 0)]

    def found(self, split: Split) -> Iterator[tuple[int, Tick | None, int]]:
        """Place, record and end of what begins in the split; a piece that is no record is cut to it."""
        system, _ = opened(self.path)
        at, more = max(0, split.start - BACK), BACK
        with system.open_input_file(split.file) as file:
            while at < split.end:
                until = min(split.size, split.end + more)
                data, base, at = file.read_at(until - at, at), at, split.end
                for a, tick, b in records(data):
                    begin, end = base + a, base + b
                    if begin >= split.end:
                        break
                    if tick is None and end >= until < split.size:  # perhaps a record that runs on: look further
                        at, more = begin, more * 16
                        break
                    if tick is None and end > split.start:
                        yield max(begin, split.start), None, min(end, split.end)
                    elif tick is not None and begin >= split.start:
                        yield begin, tick, end

    def rows(self, split: Split) -> Iterator[tuple]:
        for at, tick, end in self.found(split):
            if self.torn and tick is None:
                yield split.file, at, end - at
            elif not self.torn and tick is not None and self.first <= tick[3] <= self.last:
                yield *tick, split.file, at

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64()] if self.torn else [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["file", "offset", "length"] if self.torn else ["symbol", "price", "quantity", "timestamp_ms", "exchange", "file", "offset"]
        rows = self.rows(split) if split.end > split.start else iter(())
        while part := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)


class TickWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], names, overwrite

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/part-{uuid.uuid4().hex}.ticks"
        with system.open_output_stream(f"{path}/_{name.rsplit('/', 1)[1]}") as out:
            for row in rows:
                own = dict(zip(self.names, row, strict=True))
                out.write(to_bytes(own["symbol"], own["price"], own["quantity"], own["timestamp_ms"], own["exchange"]))
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files show once all are whole: until then, and after a failure, their names begin with an underscore."""
        system, path = opened(self.path)
        new = [m.file for m in messages if m]
        if self.overwrite and system.get_file_info(path).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File and not old.base_name.startswith("_"):
                    system.delete_file(old.path)
        for name in new:
            folder, _, own = name.rpartition("/")
            system.move(f"{folder}/_{own}", name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = opened(self.path)
        for message in messages:
            if message:
                folder, _, own = message.file.rpartition("/")
                system.delete_file(f"{folder}/_{own}")


@dataclass
class Written(WriterCommitMessage):
    file: str


class TickFiles(DataSource):
    """Options: path, splitBytes, startMs and endMs (both included), torn (report passed-over bytes instead of records)."""

    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return f"{PLACES}, length long" if self.options.get("torn", "false").lower() == "true" else f"{FIELDS}, {PLACES}"

    def reader(self, schema) -> TickReader:
        return TickReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> TickWriter:
        return TickWriter({k.lower(): v for k, v in self.options.items()}, schema.names, overwrite)


def write_ticks(ticks: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of symbol, price, quantity, timestamp_ms, exchange. The format has no nulls and no times below 0: such rows are left out."""
    ticks.sparkSession.dataSource.register(TickFiles)
    ticks.select("symbol", F.col("price").cast("double"), F.col("quantity").cast("double"), F.col("timestamp_ms").cast("long"), "exchange").dropna().where("timestamp_ms >= 0").write.format("ticks").mode(mode).save(path)


def read_ticks(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """Records, with file and offset, of a time range (both ends included)."""
    spark.dataSource.register(TickFiles)
    given = {"startMs": start_ms, "endMs": end_ms, "splitBytes": split_bytes}
    return spark.read.format("ticks").options(**{k: v for k, v in given.items() if v is not None}).load(path)


def torn_bytes(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """file, offset, length of what is no part of a record; a piece over two splits is two rows."""
    spark.dataSource.register(TickFiles)
    return spark.read.format("ticks").options(torn=True, splitBytes=split_bytes).load(path)


def tick_index(records_of: DataFrame) -> DataFrame:
    """symbol, record_count, min_timestamp_ms, max_timestamp_ms, first_file, byte_offset (of the first record, by file and place)."""
    first = F.min(F.struct("file", "offset"))
    return records_of.groupBy("symbol").agg(F.count(F.lit(1)).alias("record_count"), F.min("timestamp_ms").alias("min_timestamp_ms"), F.max("timestamp_ms").alias("max_timestamp_ms"), first["file"].alias("first_file"), first["offset"].alias("byte_offset"))
