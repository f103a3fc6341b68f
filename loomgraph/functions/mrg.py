"""The multiple recursive generator of the Kronecker benchmark: x[i] = 107374182 x[i-1] + 104480 x[i-5] mod 2^31 - 1.

Any number of steps is skipped by powers of the companion matrix, so each edge's stream starts at its own place.
"""

from __future__ import annotations

import numpy as np

MODULUS = (1 << 31) - 1
#: Fixed values of the generator.
FIRST, FIFTH = 107374182, 104480
_P = np.uint64(MODULUS)


def _times(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[sum(a[i][k] * b[k][j] for k in range(5)) % MODULUS for j in range(5)] for i in range(5)]


def power(n: int) -> list[list[int]]:
    """The matrix of n steps."""
    base = [[FIRST, 0, 0, 0, FIFTH], *([int(j == i) for j in range(5)] for i in range(4))]
    out = [[int(i == j) for j in range(5)] for i in range(5)]
    while n:
        if n & 1:
            out = _times(out, base)
        base = _times(base, base)
        n >>= 1
    return out


def skip(state: list[int], high: int, middle: int, low: int) -> list[int]:
    """The state after high * 2^128 + middle * 2^64 + low steps."""
    m = power((high << 128) + (middle << 64) + low)
    return [sum(m[i][k] * state[k] for k in range(5)) % MODULUS for i in range(5)]


def states(seed: list[int], index: np.ndarray, stride_bits: int = 64) -> np.ndarray:
    """States (5, n) after index * 2**stride_bits steps each."""
    out = np.repeat(np.array(seed, np.uint64)[:, None], len(index), axis=1)
    left, bit = index.astype(np.uint64), 0
    while len(left) and int(left.max()) >> bit:
        who = np.flatnonzero(left >> np.uint64(bit) & np.uint64(1))
        m = np.array(power(1 << (stride_bits + bit)), np.uint64)
        z = out[:, who]
        out[:, who] = np.stack([sum((m[i, k] * z[k]) % _P for k in range(5)) % _P for i in range(5)])
        bit += 1
    return out


def step(z: np.ndarray, who: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The next values of the chosen streams, whose states move on."""
    new = (np.uint64(FIRST) * z[0, who] + np.uint64(FIFTH) * z[4, who]) % _P
    z[1:, who] = z[:-1, who].copy()
    z[0, who] = new
    return new


def stream(seed: list[int], n: int) -> list[int]:
    z = list(seed)
    out = []
    for _ in range(n):
        z = [(FIRST * z[0] + FIFTH * z[4]) % MODULUS, *z[:4]]
        out.append(z[0])
    return out


def seed_from(a: int, b: int) -> list[int]:
    """Five state words from two 64-bit numbers: their 30-bit slices, and the rest together."""
    low = (1 << 30) - 1
    return [(a & low) + 1, (a >> 30 & low) + 1, (b & low) + 1, (b >> 30 & low) + 1, ((b >> 60) << 4) + (a >> 60) + 1]


def random_doubles(n: int, a: int, b: int, position: int = 0) -> np.ndarray:
    """n uniform doubles, two draws each, from a place in the stream of (a, b)."""
    u = stream(skip(seed_from(a, b), 2, 0, 2 * position), 2 * n)
    x = np.array(u, np.float64).reshape(n, 2)
    return x[:, 0] / MODULUS + x[:, 1] / float(MODULUS) / MODULUS


def random_floats(seed: list[int], n: int) -> np.ndarray:
    """n uniform single-precision numbers, one draw each."""
    return (np.array(stream(seed, n), np.float64) / MODULUS).astype(np.float32)
