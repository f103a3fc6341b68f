"""Seeded Kronecker graphs. An edge depends on (seed, scale, edge id) alone, so any partitioning gives the same graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions import mrg
from loomgraph.schema import KRONECKER
from loomgraph.session import ship

SEED = [3, 3, 5, 7, 11]
#: Shares of the four quadrants in ten-thousandths (.19, .19, .57, .05 in the order of the draw), and scramble constants.
EDGES_OF_DRAW = (1900, 3800, 9500)
QUADRANT_OF_DRAW = (1, 2, 0, 3)
ODD_1, ODD_2 = 0x4519840211493211, 0x3050852102C843A5
_U = np.uint64


def quadrants(u: np.ndarray) -> np.ndarray:
    """Quadrants of accepted draws."""
    return np.array(QUADRANT_OF_DRAW)[np.searchsorted(EDGES_OF_DRAW, (u % _U(10000)).astype(np.int64), "right")]


def accepted(u: np.ndarray) -> np.ndarray:
    return u >= _U(mrg.MODULUS % 10000)


def bit_reversed(v: np.ndarray) -> np.ndarray:
    for mask, shift in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4)):
        v = (v >> _U(shift)) & _U(mask) | (v & _U(mask)) << _U(shift)
    return v.byteswap()


def scramble(v: np.ndarray, scale: int, a: int, b: int) -> np.ndarray:
    """A permutation of the ids below 2**scale."""
    mask = (1 << 64) - 1
    v = v.astype(_U) + _U((a + b) & mask)
    for odd in (a | ODD_1, b | ODD_2):
        v = bit_reversed(v * _U(odd)) >> _U(64 - scale)
    return v


def scramble_values(seed: list[int]) -> tuple[int, int]:
    u = mrg.stream(mrg.skip(seed, 50, 7, 0), 4)
    mask = (1 << 64) - 1
    return (u[0] * 0xFFFFFFFF + u[1]) & mask, (u[2] * 0xFFFFFFFF + u[3]) & mask


def edges(ids: np.ndarray, scale: int, seed: list[int], values: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sources and targets of the edges with these ids."""
    z = mrg.states(seed, ids)
    source, target = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for level in range(scale):
        u = mrg.step(z)
        while len(again := np.flatnonzero(~accepted(u))):
            u[again] = mrg.step(z, again)
        square = quadrants(u)
        down, right = square >> 1, square & 1
        flip = (source == target) & (down > right)
        down, right = np.where(flip, right, down), np.where(flip, down, right)
        half = 1 << (scale - 1 - level)
        source, target = source + half * down, target + half * right
    a, b = values or scramble_values(seed)
    return scramble(source, scale, a, b).astype(np.int64), scramble(target, scale, a, b).astype(np.int64)


def kronecker(spark: SparkSession, scale: int, edge_factor: int = 16, seed: list[int] | None = None, partitions: int | None = None) -> DataFrame:
    """edge_id, src and dst of 2**scale * edge_factor edges, made where they are used."""
    ship(spark)
    own = seed or SEED
    values = scramble_values(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = edges(batch.column(0).to_numpy(), scale, own, values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(src), pa.array(dst)], ["edge_id", "src", "dst"])

    return spark.range(0, edge_factor << scale, 1, partitions).mapInArrow(run, KRONECKER)


def graph(spark: SparkSession, scale: int, n_edges: int, a: int, b: int) -> DataFrame:
    """The first ``n_edges`` edges of the graph of two 64-bit seeds."""
    factor = max(1, -(-n_edges // (1 << scale)))
    return kronecker(spark, scale, factor, mrg.seed_from(a, b)).where(f"edge_id < {n_edges}")
