"""A road graph kept in one binary file, as a Spark data source.

A header of 64 bytes names magic, version and the numbers of nodes and edges; then come sections that begin at
multiples of four bytes: latitudes and longitudes of the nodes (millionths of a degree), the first edge of each node and an end,
and of the edges their targets, lengths in metres, speeds and access bits. All numbers are little-endian.

    register(spark)
    spark.read.format("roadgraph").option("part", "edges").load(path)

A partition is a range of edges (or nodes) of the same size, so a node with many edges is no hot task. It reads only its own
bytes of each section; whose edges they are is found by a binary search in the section of first edges. The header, the file's
length and both ends of that section are checked before any task starts, order and targets in the tasks.
Paths may be local, file:// or any that Arrow's file systems open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
MAGIC = 0x314B4D47
VERSION = 1
HEADER_BYTES = 64
SCALE = 1e6
#: Access bits.
CAR, FOOT, BIKE = 1, 2, 4
#: (name, type, of what) of the sections in the order of the file.
SECTIONS = (("lat", "<i4", "nodes"), ("lon", "<i4", "nodes"), ("first", "<u4", "ends"), ("target", "<u4", "edges"), ("metres", "<u4", "edges"), ("speed", "u1", "edges"), ("access", "u1", "edges"))
SCHEMAS = {"edges": "src long, dst long, metres long, speed int, access int", "nodes": "node long, lat double, lon double"}


@dataclass(frozen=True)
class Layout:
    """Where each section of a file begins."""

    nodes: int
    edges: int

    def count(self, of: str) -> int:
        return {"nodes": self.nodes, "ends": self.nodes + 1, "edges": self.edges}[of]

    @property
    def starts(self) -> dict[str, int]:
        at, out = HEADER_BYTES, {}
        for name, kind, of in SECTIONS:
            out[name] = at
            at += -(-self.count(of) * np.dtype(kind).itemsize // 4) * 4
        return out | {"end": at}


class _File:
    """Ranges of a file's bytes."""

    def __init__(self, path: str):
        from pyarrow import fs

        local = path.removeprefix("file://") if path.startswith(("/", "file:")) else None
        system, name = (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)

    def bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def section(self, layout: Layout, name: str, a: int, b: int) -> np.ndarray:
        kind = np.dtype(next(k for n, k, _ in SECTIONS if n == name))
        raw = self.bytes(layout.starts[name] + a * kind.itemsize, (b - a) * kind.itemsize)
        if len(raw) < (b - a) * kind.itemsize:
            raise ValueError("the graph file is shorter than its header claims")
        return np.frombuffer(raw, kind)

    def layout(self) -> Layout:
        head = self.bytes(0, HEADER_BYTES)
        if len(head) < HEADER_BYTES:
            raise ValueError("the graph file is shorter than a header")
        magic, version, nodes, edges = struct.unpack_from("<4I", head)
        if magic != MAGIC:
            raise ValueError("not a graph file")
        if version != VERSION:
            raise ValueError(f"graph files of version {version} are not known")
        layout = Layout(nodes, edges)
        if self.file.size() < layout.starts["end"]:
            raise ValueError("the graph file is shorter than its header claims")
        if self.section(layout, "first", 0, 1)[0] != 0 or self.section(layout, "first", nodes, nodes + 1)[0] != edges:
            raise ValueError("the first edges of the graph do not fit its number of edges")
        return layout

    def owner(self, layout: Layout, edge: int) -> int:
        """The last node whose edges begin at or before an edge."""
        low, high = 0, layout.nodes
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.section(layout, "first", middle, middle + 1)[0] <= edge else (low, middle)
        return low


@dataclass
class _Range(InputPartition):
    a: int
    b: int

    def __post_init__(self):
        super().__init__((self.a, self.b))


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: str, rows: int):
        self.path, self.part, self.rows = path, part, rows

    def partitions(self):
        layout = _File(self.path).layout()
        n = layout.edges if self.part == "edges" else layout.nodes
        return [_Range(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [_Range(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        a, b = partition.a, partition.b
        if a == b:
            return
        file = _File(self.path)
        layout = file.layout()
        if self.part == "nodes":
            lat, lon = (file.section(layout, c, a, b) / SCALE for c in ("lat", "lon"))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(lat), pa.array(lon)], names=["node", "lat", "lon"])
            return
        low, high = file.owner(layout, a), file.owner(layout, b - 1)
        first = file.section(layout, "first", low, high + 2).astype(np.int64)
        if (np.diff(first) < 0).any() or first[0] > a or first[-1] < b:
            raise ValueError("the first edges of the graph are out of order")
        target, metres, speed, access = (file.section(layout, c, a, b) for c in ("target", "metres", "speed", "access"))
        if (target >= layout.nodes).any():
            raise ValueError("an edge of the graph leads to no node")
        src = np.repeat(np.arange(low, high + 1), np.minimum(first[1:], b) - np.maximum(first[:-1], a).clip(max=np.minimum(first[1:], b)))
        columns = [src, target.astype(np.int64), metres.astype(np.int64), speed.astype(np.int32), access.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "metres", "speed", "access"])


class RoadGraph(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roadgraph"

    def _part(self) -> str:
        part = self.options.get("part", "edges")
        if part not in SCHEMAS:
            raise ValueError(f"a graph file has edges and nodes, not {part}")
        return part

    def schema(self) -> str:
        return SCHEMAS[self._part()]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._part(), int(self.options.get("rows", 1_000_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RoadGraph)


def encode(nodes: list[tuple[float, float]], edges: list[tuple[int, int, int, int, int]]) -> bytes:
    """A file's bytes, for small graphs and tests: nodes (lat, lon), edges (src, dst, metres, speed, access)."""
    edges = sorted(edges, key=lambda e: e[0])
    first = np.searchsorted([e[0] for e in edges], np.arange(len(nodes) + 1))
    columns = {"lat": [round(a * SCALE) for a, _ in nodes], "lon": [round(b * SCALE) for _, b in nodes], "first": first, "target": [e[1] for e in edges], "metres": [e[2] for e in edges], "speed": [e[3] for e in edges], "access": [e[4] for e in edges]}
    out = bytearray(struct.pack("<4I", MAGIC, VERSION, len(nodes), len(edges)).ljust(HEADER_BYTES, b"\0"))
    for name, kind, _ in SECTIONS:
        out += np.array(columns[name], kind).tobytes()
        out += b"\0" * (-len(out) % 4)
    return bytes(out)


def edge_costs(edges: DataFrame, access: int, fallback_kmh: float, by_speed: bool = True) -> DataFrame:
    """(src, dst, cost) of the edges open to an access bit: milliseconds at the edge's speed, or at a profile's own."""
    kmh: Column = F.when(F.col("speed") > 0, F.col("speed").cast("double")).otherwise(F.lit(fallback_kmh)) if by_speed else F.lit(fallback_kmh)
    cost = F.floor(F.col("metres") * 3600 / kmh + 0.5).cast("long")
    return edges.where(F.col("access").bitwiseAND(F.lit(access)) != 0).select("src", "dst", cost.alias("cost"))
