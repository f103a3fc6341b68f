"""Vectorised scanning of Arrow text columns: words, spans and their hashes, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which on UTF-8 is the same as on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
STEP = U(0xD6E8FEB86659FD93)
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the lowest 0 to 8 bytes of a lane.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes; a longer row comes alone."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    ink = ~_SPACE[data]
    edge = offs[(offs > 0) & (offs < len(data))]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    first[edge] = ink[edge]
    last[edge - 1] = ink[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


class Lanes:
    """The bytes of a column as 8-byte little-endian numbers that may begin anywhere."""

    def __init__(self, data: np.ndarray) -> None:
        self.held = np.zeros((len(data) >> 3) + 2, U)
        self.held.view(np.uint8)[: len(data)] = data

    def at(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first ``size`` bytes (8 at most) from each place on, as one number."""
        word = place >> 3
        shift = (place & 7).astype(U) << U(3)
        low = self.held.take(word) >> shift
        return (low | (self.held.take(word + 1) << U(1)) << (U(63) - shift)) & _MASK.take(np.minimum(size, 8))


def _later(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of more than 8 bytes; for each of their further lanes the place of the span among them, and the lane's number."""
    long_ = np.flatnonzero(size > 8)
    count = (size[long_] - 1) >> 3
    of = np.repeat(np.arange(len(long_)), count)
    return long_, of, np.arange(len(of)) - (np.cumsum(count) - count)[of] + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands.

    Each lane of 8 bytes goes through a mixer together with its number in the span, and the results add up: there is
    no polynomial whose powers could cancel out. Spans of one length up to 8 bytes never collide.
    """
    lanes, size, key = Lanes(data), end - start, U((salt * int(STEP) + int(BASE)) & (1 << 64) - 1)
    total = mixed(lanes.at(start, size) + key)
    long_, of, number = _later(size)
    if len(long_):
        place = start[long_][of] + 8 * number
        each = mixed(mixed(lanes.at(place, end[long_][of] - place) + key) + number.astype(U) * BASE)
        total[long_] += np.add.reduceat(each, np.searchsorted(of, np.arange(len(long_))))
    return mixed(total + size.astype(U) * STEP)


def same(data: np.ndarray, start: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether spans ``one`` and ``two`` (places in start and end) hold the same bytes."""
    lanes, a, b, size = Lanes(data), start[one], start[two], end[one] - start[one]
    equal = (size == end[two] - b) & (lanes.at(a, size) == lanes.at(b, size))
    long_, of, number = _later(np.where(equal, size, 0))
    if len(long_):
        step, left = 8 * number, size[long_][of] - 8 * number
        differ = lanes.at(a[long_][of] + step, left) != lanes.at(b[long_][of] + step, left)
        equal[long_] = np.bincount(of, differ, minlength=len(long_)) == 0
    return equal


def identities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span, the same for two spans only if their bytes are: hashes propose, bytes decide."""
    h = span_hashes(data, start, end)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    number = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = number
    differ = ~same(data, start, end, order, order[np.flatnonzero(new)][number] if len(order) else order)
    if differ.any():  # one hash for several contents
        raw, seen = data.tobytes(), {}
        for i in order[np.isin(number, number[differ])].tolist():
            out[i] = len(order) + seen.setdefault(raw[start[i] : end[i]], len(seen))
    return out


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp values sum(h[i + j] * STEP**(k - 1 - j)) modulo 2^64 of all runs of k, by doubling."""
    if len(h) < k:
        return np.zeros(0, U)
    acc, have = h, 1
    for bit in bin(k)[3:]:
        factor = U(pow(int(STEP), have, 1 << 64))
        acc = acc[: len(acc) - have] * factor + acc[have:]
        have *= 2
        if bit == "1":
            acc = acc[:-1] * STEP + h[have : have + len(acc) - 1]
            have += 1
    return acc


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and mixed Rabin-Karp value of every run of k words of one row."""
    acc = rolled(h, k)
    at = np.flatnonzero(row[: len(acc)] == row[k - 1 : k - 1 + len(acc)])
    return at, mixed(acc[at])


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def summed(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of set bytes of each row."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
