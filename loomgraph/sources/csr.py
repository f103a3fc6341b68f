"""Compressed-row graph files: u32 n, u64 m, u64 row_ptr[n + 1], u32 col_idx[m], little-endian, packed.

``spark.read.format("csr_graph").option("blocks", k).load(path)`` gives one partition a block of vertices; a
partition reads the header, its slice of row_ptr and its slice of col_idx.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.operators import etl
from loomgraph.schema import EDGES
from loomgraph.session import scratch, ship

HEAD = struct.Struct("<IQ")
STEP = 1 << 20


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _open(path: str) -> pa.NativeFile:
    fs, at = _located(path)
    return fs.open_input_file(at)


class Block(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class CsrReader(DataSourceReader):
    def __init__(self, path: str, blocks: int) -> None:
        self.path, self.blocks = path, blocks

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as f:
            n, _ = HEAD.unpack(f.read(HEAD.size))
        size = max(1, -(-n // self.blocks))
        return [Block(a, min(n, a + size)) for a in range(0, n, size)] or [Block(0, 0)]

    def read(self, block: InputPartition) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            n, _ = HEAD.unpack(f.read(HEAD.size))
            for a in range(block.start, block.end, STEP):
                b = min(block.end, a + STEP)
                f.seek(HEAD.size + 8 * a)
                ptr = np.frombuffer(f.read(8 * (b - a + 1)), "<u8").astype(np.int64)
                lo = int(ptr[0])
                while lo < int(ptr[-1]):
                    hi = min(lo + STEP, int(ptr[-1]))
                    f.seek(HEAD.size + 8 * (n + 1) + 4 * lo)
                    dst = np.frombuffer(f.read(4 * (hi - lo)), "<u4").astype(np.int64)
                    src = a + np.searchsorted(ptr, np.arange(lo, hi), "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])
                    lo = hi


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr_graph"

    def schema(self) -> str:
        return EDGES

    def reader(self, schema: object) -> DataSourceReader:
        return CsrReader(self.options["path"], int(self.options.get("blocks", "8")))


def vertices(path: str) -> int:
    """The number of vertices that a file's header names."""
    with _open(path) as f:
        return HEAD.unpack(f.read(HEAD.size))[0]


def read(spark: SparkSession, path: str, blocks: int = 8) -> DataFrame:
    ship(spark)
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr_graph").option("blocks", str(blocks)).load(path)


def _slices(folder: str, kind: str):
    """Writes a partition's numbers, which are in order, as bytes to a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, size, out = f"{folder}/{part:06d}-{uuid.uuid4().hex}", 0, None
        for batch in batches:
            if out is None:
                fs, at = _located(path)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(at, compression=None)
            raw = batch.column(0).to_numpy().astype(kind).tobytes()
            out.write(raw)
            size += len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([size], pa.int64())], ["part", "path", "size"])

    return run


def write(arcs: DataFrame, path: str) -> tuple[int, int]:
    """Writes densely numbered arcs to one file and returns (n, m).

    Tasks write the sorted slices as bytes into the shared folder, all at once; the file, which the format wants in one
    piece, is then those slices one after the other. The driver only copies bytes, never rows.
    """
    spark = arcs.sparkSession
    ship(spark)
    rows = etl.row_ptr(arcs).select("v", "row_ptr")
    n, m = rows.count(), arcs.count()
    lists = {"<u8": rows.orderBy("v").select("row_ptr"), "<u4": arcs.orderBy("src", "dst").select(F.col("dst").cast("long"))}
    fs, at = _located(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(HEAD.pack(n, m))
        for kind, numbers in lists.items():
            listed = numbers.mapInArrow(_slices(scratch(spark, "csr"), kind), "part int, path string, size long").collect()  # a row a partition
            for r in sorted(listed, key=lambda r: r["part"]):
                with _open(r["path"]) as f:
                    while raw := f.read(STEP):
                        out.write(raw)
                _located(r["path"])[0].delete_file(_located(r["path"])[1])
            if kind == "<u8":
                out.write(struct.pack("<Q", m))
    return n, m
