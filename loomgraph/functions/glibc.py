"""The C library's additive-feedback ``rand``, which picks the search keys."""

from __future__ import annotations


def rand(seed: int, n: int) -> list[int]:
    r = [seed or 1]
    for _ in range(30):
        r.append(16807 * r[-1] % 2147483647)
    r += r[0:3]
    r = r[:34]
    for i in range(34, 344 + n):
        r.append((r[i - 31] + r[i - 3]) & 0xFFFFFFFF)
    return [x >> 1 for x in r[344 : 344 + n]]


def search_keys(n_vertices: int, keys: int = 64, seed: int = 11) -> list[int]:
    """Roots of the benchmark's runs, with replacement."""
    return [x % n_vertices for x in rand(seed, keys)] if n_vertices else []
