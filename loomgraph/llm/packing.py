"""Packing of documents into sequences of at most ``capacity`` ids by Karmarkar-Karp multiway differencing.

A document's ids are cut into full sequences; what is left over is cut into a large part (a multiple of ``grain``)
and a small one, which levels the windows. The parts of ``block`` documents are divided among k windows: each part
starts as a partial partition of its own, and the two partial partitions with the largest imbalance merge, the
fullest windows of one onto the emptiest of the other, until one is left. k starts at the least that can hold the
ids and rises by one whenever a window would exceed the capacity.

All of it happens where the documents are read: ids aren't shuffled, and a task holds one block.

Defined results: a null or empty text has the end id alone; each row is a document of its own, whatever its id;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import tokens
from loomgraph.session import ship

CAPACITY = 2048
END_ID = 1
_FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Places of ``sizes`` in k windows of nearly equal sums."""
    if k == 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(k - 1))]
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[0] = size  # from the fullest down
        heap.append((-size, i, loads, [[i]]))  # windows beyond the listed ones are empty
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        loads = a[2] + b[2][::-1]
        order = np.argsort(-loads, kind="stable")
        wins = a[3] + [[] for _ in range(k - len(a[3]))]
        for j, own in enumerate(b[3]):
            wins[k - 1 - j] = wins[k - 1 - j] + own
        wins = [wins[j] for j in order]
        while wins and not wins[-1]:
            wins.pop()
        loads = loads[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), min(a[1], b[1]), loads, wins))
    found = heap[0][3]
    return [*found, *([] for _ in range(k - len(found)))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differenced(sizes, k)
        if max((sum(sizes[i] for i in w) for w in found), default=0) <= capacity:
            return [w for w in found if w]
        k += 1


def _pieces(path: str, capacity: int, end_id: int, block: int, grain: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        sequence = TaskContext.get().partitionId() << 33
        out: list[tuple] = []  # one a piece: row, start, length, crc, document's ids, sequence, offset
        parts: list[tuple] = []
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                for key, body in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    body, n = body + end, len(body) // 4 + 1
                    at = 0
                    while n - at >= capacity:
                        out.append((key, at, capacity, zlib.crc32(body[4 * at : 4 * (at + capacity)]), n, sequence, 0))
                        at, sequence = at + capacity, sequence + 1
                    large = (n - at) // grain * grain
                    for take in (large, n - at - large):
                        if take:
                            parts.append((key, at, take, zlib.crc32(body[4 * at : 4 * (at + take)]), n))
                            at += take
                    if len(parts) >= 2 * block:
                        sequence = _placed(parts, capacity, sequence, out)
                        parts = []
            if len(out) >= 4096:
                yield _batch(out, batch.schema.field(0).type)
                out = []
        _placed(parts, capacity, sequence, out)
        if out:
            yield _batch(out, batch.schema.field(0).type)

    return run


def _placed(parts: list[tuple], capacity: int, sequence: int, out: list[tuple]) -> int:
    if not parts:
        return sequence
    for window in windows([p[2] for p in parts], capacity):
        offset = 0
        for i in sorted(window):
            out.append((*parts[i], sequence, offset))
            offset += parts[i][2]
        sequence += 1
    return sequence


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], key), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", *_FIELDS])


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY,
    end_id: int = END_ID, block: int = 256, grain: int = 128,
) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run = _pieces(path or tokens.default_path(), capacity, end_id, block, grain)
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{f} long" for f in _FIELDS)).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
