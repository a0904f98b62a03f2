"""Recorded robot bags (format 2.0): their messages as a table, point clouds in them as sessions.

A bag is cut at its chunks, which its index lists, so any number of tasks read one bag. Files are opened through
pyarrow's file systems, by the tasks that read them: local, HDFS and object stores alike.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import POINT_RECORD, POINT_SCHEMA, WIRE_TYPES, decode_points, decode_wire

#: First line of a bag, and the kinds of its records.
MAGIC = b"#ROSBAG V2.0\n"
MESSAGE, BAG_HEADER, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7
#: Limits of a cloud message: bytes, fields, characters of a name, points.
MAX_BYTES, MAX_FIELDS, MAX_NAME, MAX_POINTS = 32 << 20, 128, 4096, 1 << 24


class BagError(ValueError):
    """A bag or message that breaks its format."""


class _Cursor:
    """Reads from a buffer and never beyond its end."""

    def __init__(self, raw: bytes):
        self.raw, self.at = memoryview(raw), 0

    def take(self, n: int) -> memoryview:
        if n < 0 or self.at + n > len(self.raw):
            raise BagError("data ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def left(self) -> int:
        return len(self.raw) - self.at


def _header(raw: memoryview) -> dict[str, bytes]:
    c, out = _Cursor(raw), {}
    while c.left():
        name, eq, value = bytes(c.take(c.number("I"))).partition(b"=")
        if not eq:
            raise BagError("a header field without a name")
        out[name.decode("ascii")] = value
    return out


def _record(c: _Cursor) -> tuple[dict[str, bytes], memoryview]:
    head = _header(c.take(c.number("I")))
    if len(head.get("op", b"")) != 1:
        raise BagError("a record without a kind")
    return head, c.take(c.number("I"))


def _u32(b: bytes) -> int:
    return struct.unpack("<I", b)[0]


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _read_record(f, at: int) -> tuple[dict[str, bytes], bytes, int]:
    """Header, data and end of the record at a place of a file."""
    n = _u32(f.read_at(4, at))
    head = _header(memoryview(f.read_at(n, at + 4)))
    size = _u32(f.read_at(4, at + 4 + n))
    return head, f.read_at(size, at + 8 + n), at + 8 + n + size


def _unpacked(head: dict[str, bytes], data: bytes) -> bytes:
    kind = head.get("compression", b"none")
    if kind == b"none":
        return bytes(data)
    if kind == b"bz2":
        return bz2.decompress(data)
    if kind == b"lz4":
        return pa.decompress(bytes(data), _u32(head["size"]), "lz4").to_pybytes()
    raise BagError(f"unknown compression {kind!r}")


def chunk_places(path: str) -> list[int]:
    """Where the chunks of a bag begin, by its index; a bag that was never closed is walked from its start."""
    with _open(path) as f:
        if f.read_at(len(MAGIC), 0) != MAGIC:
            raise BagError(f"{path} is no bag of format 2.0")
        size = f.size()
        head, _, at = _read_record(f, len(MAGIC))
        index = struct.unpack("<Q", head["index_pos"])[0]
        out = []
        if index:
            at = index
            while at < size:
                head, _, at = _read_record(f, at)
                if head["op"][0] == CHUNK_INFO:
                    out.append(struct.unpack("<Q", head["chunk_pos"])[0])
            return sorted(out)
        while at + 8 <= size:
            begin = at
            n = _u32(f.read_at(4, at))
            if at + 8 + n > size:
                break  # the recording ended in this record
            head = _header(memoryview(f.read_at(n, at + 4)))
            at += 8 + n + _u32(f.read_at(4, at + 4 + n))
            if at > size:
                break
            if head["op"][0] == CHUNK:
                out.append(begin)
        return out


def _connections(path: str) -> dict[int, tuple[str, str]]:
    """Number -> topic and type, from the index; nothing for a bag without one."""
    out: dict[int, tuple[str, str]] = {}
    with _open(path) as f:
        head, _, at = _read_record(f, len(MAGIC))
        at = struct.unpack("<Q", head["index_pos"])[0] or f.size()
        while at < f.size():
            head, data, at = _read_record(f, at)
            if head["op"][0] == CONNECTION:
                inner = _header(memoryview(data))
                out[_u32(head["conn"])] = (head["topic"].decode(), inner["type"].decode())
    return out


def chunk_messages(path: str, places: list[int], known: dict[int, tuple[str, str]]) -> Iterator[tuple]:
    """(topic, type, bag_time_ns, chunk, place, data) of every message of some chunks."""
    known = dict(known)
    with _open(path) as f:
        for begin in places:
            head, data, _ = _read_record(f, begin)
            if head["op"][0] != CHUNK:
                raise BagError("the index points beside a chunk")
            c = _Cursor(_unpacked(head, data))
            k = 0
            while c.left():
                head, body = _record(c)
                kind = head["op"][0]
                if kind == CONNECTION:
                    known[_u32(head["conn"])] = (head["topic"].decode(), _header(body)["type"].decode())
                elif kind == MESSAGE:
                    sec, nano = struct.unpack("<II", head["time"])
                    topic, typ = known.get(_u32(head["conn"]), (None, None))
                    yield topic, typ, sec * 1_000_000_000 + nano, begin, k, bytes(body)
                    k += 1


MESSAGE_SCHEMA = "topic string, type string, bag_time_ns bigint, chunk bigint, place int, data binary"


class RosBag(DataSource):
    """spark.read.format("rosbag").load(path): the messages of one bag, a partition for every ``chunks`` chunks."""

    @classmethod
    def name(cls) -> str:
        return "rosbag"

    def schema(self) -> str:
        return MESSAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BagReader(self.options["path"], int(self.options.get("chunks", "16")))


class _Chunks(InputPartition):
    def __init__(self, places: list[int], known: dict):
        self.places, self.known = places, known


class _BagReader(DataSourceReader):
    def __init__(self, path: str, chunks: int):
        self.path, self.chunks = path, chunks

    def partitions(self) -> list[InputPartition]:
        places, known = chunk_places(self.path), _connections(self.path)
        if places and not known:
            return [_Chunks(places, {})]  # without an index a chunk counts on the connections of those before it
        return [_Chunks(places[k : k + self.chunks], known) for k in range(0, len(places), self.chunks)] or [_Chunks([], {})]

    def read(self, part: _Chunks) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in MESSAGE_SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0
        for row in chunk_messages(self.path, part.places, part.known):
            rows.append(row)
            held += len(row[5])
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


@dataclass
class Cloud:
    seq: int
    sec: int
    nanosec: int
    frame_id: str
    height: int
    width: int
    fields: list[tuple[str, int, int]]
    big_endian: bool
    point_step: int
    row_step: int
    data: bytes
    dense: bool

    def rows(self) -> pd.DataFrame:
        """One row a point by the cloud's own layout; rows that aren't finite stay, so row numbers hold."""
        if self.row_step != self.point_step * self.width:
            lines = [self.data[k * self.row_step : k * self.row_step + self.point_step * self.width] for k in range(self.height)]
            return decode_wire(b"".join(lines), self.fields, self.point_step, self.big_endian)
        return decode_wire(self.data, self.fields, self.point_step, self.big_endian)


def parse_cloud(raw: bytes) -> Cloud:
    """A serialized point cloud message: header (sequence, stamp, frame), height, width, fields (name, offset, type, count),
    byte order, point and row step, data, dense flag. Every length is checked against the message and the limits above."""
    if len(raw) > MAX_BYTES:
        raise BagError("message too long")
    c = _Cursor(raw)

    def text() -> str:
        n = c.number("I")
        if n > MAX_NAME:
            raise BagError("name too long")
        return bytes(c.take(n)).decode("utf-8")

    seq, sec, nano = c.number("I"), c.number("I"), c.number("I")
    frame, height, width, count = text(), c.number("I"), c.number("I"), c.number("I")
    if nano >= 1_000_000_000 or count > MAX_FIELDS or height * width > MAX_POINTS:
        raise BagError("stamp, fields or size out of range")
    fields = []
    for _ in range(count):
        name, offset, kind, many = text(), c.number("I"), c.number("B"), c.number("I")
        if kind not in WIRE_TYPES:
            raise BagError(f"unknown type {kind}")
        if many == 1:
            fields.append((name, offset, kind))
    big, step, row_step = bool(c.number("B")), c.number("I"), c.number("I")
    data = bytes(c.take(c.number("I")))
    dense = bool(c.number("B"))
    if c.left():
        raise BagError("bytes left over")
    if width * height and (step == 0 or row_step < step * width or len(data) != row_step * height):
        raise BagError("steps don't fit the data")
    return Cloud(seq, sec, nano, frame, height, width, fields, big, step, row_step, data, dense)


def pack_points(cloud: Cloud) -> tuple[bytes, int, int]:
    """Packed 28-byte records of the finite points, how many they are and how many were dropped."""
    if not cloud.width * cloud.height:
        return b"", 0, 0
    names = {n for n, _, _ in cloud.fields}
    if lacking := {"x", "y", "z", "intensity", "ring"} - names or ({"timestamp"} - names if "t" not in names else set()):
        raise BagError(f"fields missing: {', '.join(sorted(lacking))}")
    p = cloud.rows()
    ok = np.isfinite(p[["x", "y", "z"]].to_numpy("float64")).all(1)
    a = np.zeros(int(ok.sum()), POINT_RECORD)
    for name in POINT_RECORD.names:
        source = name if name != "ts" else "timestamp" if "timestamp" in names else "t"
        a[name] = p[source].to_numpy()[ok]
    return a.tobytes(), len(a), int((~ok).sum())


def busiest_topic(messages: DataFrame, message_type: str = "sensor_msgs/PointCloud2") -> str | None:
    """The topic of a type with the most messages (ties: the first by name), None without one."""
    n = messages.filter(F.col("type") == message_type).groupBy("topic").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "topic").first()
    return top["topic"] if top else None


def extract_frames(messages: DataFrame, session_id: str, topic: str | None = None) -> DataFrame:
    """A row for each cloud of the (busiest) topic in order of recording: (session_id, frame_index, seq, stamp_sec,
    stamp_nanosec, bag_time_sec, offset_points, count_points, dropped_points, packed). Points that aren't finite are dropped
    and counted; packed holds the others. Only counts are ordered in one task, not the points."""
    topic = topic or busiest_topic(messages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ns, chunk, place, raw in zip(pdf["bag_time_ns"], pdf["chunk"], pdf["place"], pdf["data"]):
                c = parse_cloud(raw)
                packed, kept, dropped = pack_points(c)
                rows.append((ns, chunk, place, c.seq, c.sec, c.nanosec, kept, dropped, packed))
            yield pd.DataFrame(rows, columns=["bag_time_ns", "chunk", "place", "seq", "stamp_sec", "stamp_nanosec", "count_points", "dropped_points", "packed"])

    schema = "bag_time_ns bigint, chunk bigint, place int, seq bigint, stamp_sec bigint, stamp_nanosec bigint, count_points bigint, dropped_points bigint, packed binary"
    clouds = messages.filter(F.col("topic") == F.lit(topic)).mapInPandas(run, schema)
    order = W.partitionBy().orderBy("bag_time_ns", "chunk", "place")
    numbers = clouds.select("bag_time_ns", "chunk", "place", "count_points").withColumns(
        {"frame_index": (F.row_number().over(order) - 1).cast("int"), "offset_points": F.coalesce(F.sum("count_points").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}
    )
    j = clouds.join(numbers.drop("count_points"), ["bag_time_ns", "chunk", "place"])
    return j.select(F.lit(session_id).alias("session_id"), "frame_index", "seq", "stamp_sec", "stamp_nanosec", (F.col("bag_time_ns") / 1e9).alias("bag_time_sec"), "offset_points", "count_points", "dropped_points", "packed")


def frame_points(frames: DataFrame) -> DataFrame:
    """Point rows of extracted frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, k, at, raw in zip(pdf["session_id"], pdf["frame_index"], pdf["offset_points"], pdf["packed"]):
                p = decode_points(raw)
                yield p.assign(session_id=s, frame_index=k, source_row=np.arange(at, at + len(p)))[[c.split()[0] for c in POINT_SCHEMA.split(", ")]]

    return frames.select("session_id", "frame_index", "offset_points", "packed").mapInPandas(run, POINT_SCHEMA)
