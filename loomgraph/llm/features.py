"""Hashed text features for linear models, computed on whole Arrow batches."""

from __future__ import annotations

import numpy as np

from loomgraph.llm import textscan as ts

WORD_BITS, TAIL_BITS, SHAPES = 15, 10, 64
SIZE = (1 << WORD_BITS) + (1 << TAIL_BITS) + SHAPES

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 symbol; bytes of longer characters count as lower
_KIND[33:127] = 4
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 2, 1, 1


def indices(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, features): each word has a hashed identity, a hashed two-byte ending, a shape, and whether it repeats the word before."""
    start, end, row = ts.words(data, offs)
    h = ts.span_hashes(data, start, end)
    word = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    last, before = data[end - 1].astype(np.int64), np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
    tail = (last * 31 + before * 7919) % (1 << TAIL_BITS) + (1 << WORD_BITS)
    first, final = _KIND[data[start]].astype(np.int64), _KIND[data[end - 1]].astype(np.int64)
    size = np.minimum(np.log2(end - start).astype(np.int64), 1)
    shape = (first * 5 + final) * 2 + size + (1 << WORD_BITS) + (1 << TAIL_BITS)
    again = np.zeros_like(word)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return row, np.stack([word, tail, shape, SIZE - 2 + again])


def scores(data: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean over each row's words of the sum of a word's weights; 0 without words."""
    row, found = indices(data, offs)
    n = ts.per_row(row, len(offs) - 1)
    total = np.bincount(row, weights[found].sum(axis=0), minlength=len(n))
    return total / np.maximum(n, 1)
