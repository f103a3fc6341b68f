"""Deterministic range shards, and files that appear whole or not at all."""

from __future__ import annotations

import contextlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = np.iinfo(np.int64).max
MOST_PARTITIONS = 100_000
#: Ranges that are cut in one task each: so many at least, of so many shards, with so many sampled places each.
LEAST_RANGES = 64
RANGE_SHARDS = 8
SAMPLE = 16
CELLS = 8192


def ties(key: Column, *content: Column | str) -> Column:
    """Orders rows of one key: 62 hashed bits of the content, beyond all others where the key is null."""
    own = F.shiftrightunsigned(F.xxhash64(*content), 2)
    return F.when(key.isNull(), own + F.lit(1 << 62)).otherwise(own)


def _codes(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """16 bytes a row, in the order of (key, tie)."""
    both = np.stack((keys, ties), 1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.astype(">u8").view("S16").ravel()


def _placing(firsts: np.ndarray):
    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, _codes(key.to_numpy(), tie.to_numpy()), "right").astype(np.int32))

    return place


def _dealt(rows: DataFrame, firsts: np.ndarray, name: str) -> DataFrame:
    """``rows`` with the number of their range in column ``name``, each range whole in one partition."""
    n = len(firsts) + 1
    place = _placing(firsts)("key", "tie") if n > 1 else F.lit(0)
    return rows.withColumn(name, place).repartitionById(min(n, MOST_PARTITIONS), F.expr(f"int({name} * {min(n, MOST_PARTITIONS)}L div {n})"))


def _cells(target: int):
    """Cuts each sorted range greedily between unequal (key, tie); first key, first tie and weight of every cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[list[int]] = []
        of = None
        for (now, key, tie), equal in itertools.groupby(rows, key=lambda r: r[:3]):
            own = sum(r[3] for r in equal)
            if now != of or out[-1][2] + own > target:
                out.append([key, tie, 0])
            of = now
            out[-1][2] += own
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in out], pa.int64()) for i in range(3)], ["key", "tie", "weight"])

    return run


def cuts(rows: DataFrame, target: int) -> np.ndarray:
    """First (key, tie), as codes, of all shards but the first, such that a shard weighs ``target`` at most.

    rows: long columns key, tie and weight of every row, best a written table, as it is read three times. The cuts
    depend on the rows alone and not on how they are partitioned: ranges of about RANGE_SHARDS shards come from a sample
    chosen by hash, each range is sorted and cut by exact sums in a task of its own, and small neighbours are joined.
    Only rows equal in key and tie are never cut. What comes to the driver, and is broadcast, is bounded by the number of
    shards: 16 bytes for each of SAMPLE places a range (SAMPLE * LEAST_RANGES at least), 24 bytes a cell, 16 bytes a shard.
    A cell weighs a CELLS-th of the rows, but no more than a shard and no less than a sixteenth of one.
    """
    total, n = rows.agg(F.sum("weight"), F.count(F.lit(1))).first()
    none = np.zeros(0, "S16")
    if not total or total <= target:
        return none
    ranges = max(LEAST_RANGES, -(-total // (RANGE_SHARDS * target)))
    chosen = rows.where(F.pmod(F.xxhash64("key", "tie"), F.lit(max(1, n // (SAMPLE * ranges)))) == 0).select("key", "tie").distinct().toArrow()
    places = np.sort(_codes(chosen["key"].to_numpy(), chosen["tie"].to_numpy()))
    bounds = np.unique(places[np.arange(1, ranges) * len(places) // ranges]) if len(places) else none
    ranged = _dealt(rows.select("key", "tie", "weight"), bounds, "of").sortWithinPartitions("of", "key", "tie")
    found = ranged.select("of", "key", "tie", "weight").mapInArrow(_cells(max(target // 16, min(target, total // CELLS))), "key long, tie long, weight long").toArrow()
    codes, weights = _codes(found["key"].to_numpy(), found["tie"].to_numpy()), found["weight"].to_numpy()
    order = np.argsort(codes, kind="stable")
    out, filled = [], 0
    for i, own in zip(order.tolist(), weights[order].tolist(), strict=True):
        if filled and filled + own > target:
            out.append(i)
            filled = 0
        filled += own
    return codes[out] if out else none


def sharded(rows: DataFrame, firsts: np.ndarray, *then: Column | str) -> DataFrame:
    """``rows`` with column ``shard``, each shard whole in one partition and sorted by key, tie and ``then``."""
    return _dealt(rows, firsts, "shard").sortWithinPartitions("shard", "key", "tie", *then)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Placed:
    """A file under a temporary name, which takes its own name when it is complete. Retried tasks write the same."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, top = store(folder)
        self.fs.create_dir(top, recursive=True)
        self.final, self.temp = f"{top}/{name}", f"{top}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def write(self, data: bytes) -> None:
        try:
            self.out.write(data)
        except BaseException:
            self.abort()
            raise

    def commit(self) -> None:
        """Takes the place of what a lost task may have left under the name, which held the same bytes."""
        try:
            self.out.close()
            self.fs.move(self.temp, self.final)
        except BaseException:
            self.abort()
            raise

    def abort(self) -> None:
        with contextlib.suppress(OSError):
            self.out.close()
            self.fs.delete_file(self.temp)
