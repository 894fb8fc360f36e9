"""Import of binary map extracts: files of length-prefixed, compressed blocks of elements in protocol-buffer encoding.

Files are read by Spark's binary source, cut into blocks without unpacking them, and the blocks dealt out; each
is then decoded by itself. A file is read whole by one task, of 2 GB at most: larger extracts come in parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mercator import x_from_lon, y_from_lat
from .library import INDEXED, Library, derive
from .scratch import materialize

# Field numbers and features of the format.
SUPPORTED = ("OsmSchema-V0.6", "DenseNodes", "HistoricalInformation")
ELEMENTS = "kind tinyint, id bigint, lon double, lat double, tags map<string,string>, refs array<bigint>, types array<tinyint>, roles array<string>"
KINDS = (
    pa.int8(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.string()),
)


class PbfError(ValueError):
    """A damaged file, or one that needs what isn't supported."""


def varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message: integers, or bytes of nested messages and packed lists."""
    data, at = memoryview(data), 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            value, at = varint(data, at)
        elif key & 7 == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif key & 7 in (1, 5):
            size = 8 if key & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise PbfError(f"wire type {key & 7}")
        yield key >> 3, value


def packed(data) -> np.ndarray:
    """All varints of a packed list at once, as unsigned 64-bit numbers."""
    raw = np.frombuffer(data, "u1")
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.empty(0, "u8")
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    bits = (raw[: ends[-1] + 1] & 127).astype("u8") << (7 * place).astype("u8")
    return np.bitwise_or.reduceat(bits, starts)


def zigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype("i8") ^ -(values & np.uint64(1)).astype("i8")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def blobs(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(type, blob) of a file's blocks."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise PbfError("cut off")
        (size,) = struct.unpack_from(">I", data, at)
        head = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        if at + head[3] > len(data):
            raise PbfError("cut off")
        yield bytes(head[1]).decode(), data[at : at + head[3]]
        at += head[3]


def content(blob: bytes) -> bytes:
    found = dict(fields(blob))
    if 1 in found:
        return bytes(found[1])
    if 3 in found:
        return zlib.decompress(found[3])
    raise PbfError("a compression other than zlib")


def elements(block: bytes) -> Iterator[tuple]:
    """Rows of ELEMENTS of one block."""
    strings: list[str] = []
    groups, granularity, lat0, lon0 = [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(v)]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            granularity = v
        elif n == 19:
            lat0 = signed(v)
        elif n == 20:
            lon0 = signed(v)
    degrees = lambda base, v: (base + granularity * v) * 1e-9
    named = lambda f: [(strings[k], strings[v]) for k, v in zip(packed(f.get(2, b"")).tolist(), packed(f.get(3, b"")).tolist(), strict=True)]
    sint = lambda v: (v >> 1) ^ -(v & 1)
    for group in groups:
        for n, v in fields(group):
            if n == 2:
                yield from dense(dict(fields(v)), strings, degrees, lat0, lon0)
                continue
            if n not in (1, 3, 4):
                continue
            f = dict(fields(v))
            if n == 1:
                yield 0, sint(f[1]), degrees(lon0, sint(f[9])), degrees(lat0, sint(f[8])), named(f), None, None, None
            elif n == 3:
                yield 1, f[1], None, None, named(f), np.cumsum(zigzag(packed(f.get(8, b"")))).tolist(), None, None
            else:
                roles = [strings[k] for k in packed(f.get(8, b"")).tolist()]
                yield 2, f[1], None, None, named(f), np.cumsum(zigzag(packed(f.get(9, b"")))).tolist(), packed(f.get(10, b"")).astype("i1").tolist(), roles


def dense(f: dict, strings: list[str], degrees, lat0: int, lon0: int) -> Iterator[tuple]:
    ids, lats, lons = (np.cumsum(zigzag(packed(f.get(k, b"")))) for k in (1, 8, 9))
    keys, at = packed(f.get(10, b"")).tolist(), 0
    for i, lon, lat in zip(ids.tolist(), degrees(lon0, lons).tolist(), degrees(lat0, lats).tolist(), strict=True):
        pairs = []
        while at < len(keys) and keys[at]:
            pairs.append((strings[keys[at]], strings[keys[at + 1]]))
            at += 2
        at += 1
        yield 0, i, lon, lat, pairs, None, None, None


def rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ELEMENTS of one or more files: kind 0 is nodes, 1 ways, 2 relations."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for kind, blob in blobs(data.as_py()):
                    if kind == "OSMHeader":
                        needed = [bytes(v).decode() for n, v in fields(content(blob)) if n == 4]
                        if wrong := [x for x in needed if x not in SUPPORTED]:
                            raise PbfError(f"the file needs {', '.join(wrong)}")
                    elif kind == "OSMData":
                        held.append(blob)
                        size += len(blob)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["blob"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["blob"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                found = list(elements(content(blob.as_py())))
                cols = zip(*found, strict=True) if found else [[]] * len(KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], [c.split()[0] for c in ELEMENTS.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("content")
    blocks = files.mapInArrow(cut, "blob binary").repartition(F.expr("xxhash64(blob)"))
    return blocks.mapInArrow(decode, ELEMENTS)


def read(spark: SparkSession, path: str, indexed=INDEXED) -> Library:
    """The library of the elements in one or more files. Vertices and members that the files lack are left out.

    Files are decoded once, into a table of the shared folder. Locations on ways instead of nodes, and
    compressions other than zlib, aren't supported.
    """
    found = materialize(rows(spark, path), "elements")
    node = found.where("kind = 0")
    nodes = node.select("id", x_from_lon(F.col("lon")).alias("x"), y_from_lat(F.col("lat")).alias("y"), "tags")
    refs = found.where("kind = 1").select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id"))
    way_nodes = refs.join(nodes.select(F.col("id").alias("node_id"), "x", "y"), "node_id")
    rel = found.where("kind = 2").select(F.col("id").alias("rel_id"), F.posexplode(F.arrays_zip("refs", "types", "roles")).alias("seq", "m"))
    members = rel.select("rel_id", "seq", F.col("m.types").alias("m_type"), F.col("m.refs").alias("m_id"), F.col("m.roles").alias("role"))
    return derive(nodes, found.where("kind = 1").select("id", "tags"), found.where("kind = 2").select("id", "tags"), way_nodes, members, indexed)
