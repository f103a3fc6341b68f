"""Token ids by the ``tokenizers`` library, with a bounded open-addressed table of pieces.

A byte-level pre-tokenizer always breaks at certain places, whatever stands further off: before a space that a
non-space follows, between letters and the punctuation after them, before white space that follows anything else,
and after a single line break. Texts are cut there, a whole column at a time; each distinct piece is encoded by the
library once, and the ids of a text are those of its pieces in a row: the same ids as for the whole text. Characters
that aren't told apart by two bytes at most are never cut between, which only makes pieces longer. A text that holds
the string of an added token, as <|endoftext|>, is one piece, since the library looks for these before anything else.

The table's keys are the bytes of the pieces themselves with their number, so no hash decides what a piece is; longer
pieces are looked up as bytes objects.
"""

from __future__ import annotations

import os
import re
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from loomgraph.llm import textscan as ts

U = np.uint64
DEFAULT = "byte_bpe_50k.json"
SLOT_BITS = 20
ENTRIES = 600_000
POOL = 4_000_000
KEY_BYTES = 23  # of a piece that is its own key
LONGEST_KEPT = 256
_ENCODERS: dict[str, Encoder] = {}

#: Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_TO_CHARACTER = {b: chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)}
#: What a byte ends, by bits: 1 a letter, 2 a character that is no white space.
_ENDS = np.zeros(256, np.uint8)
_ENDS[0x21:0x7F] = 2
_ENDS[[*range(65, 91), *range(97, 123)]] = 3
#: What a byte opens, by bits: 1 an ASCII mark, 2 white space, 4 another character that is surely no white space, 8 one of two bytes.
_OPENS = np.zeros(256, np.uint8)
_OPENS[0x21:0x7F] = 4
_OPENS[0xC3:0xE0] = 8
_OPENS[[0x20, *range(0x09, 0x0E)]] = 2
_OPENS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 5


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places of ``data`` at which a text or a piece begins."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends, opens = _ENDS.take(data), _OPENS.take(data)
    lead = np.flatnonzero(opens[:-1] == 8)
    second = data[lead + 1]
    ends[lead + 1] = np.where((data[lead] == 0xC3) & (second != 0x97) & (second != 0xB7), 3, 2)
    solid = opens >= 4
    cut = np.zeros(len(data), bool)
    np.not_equal(ends[:-1] & opens[1:] & 3, 0, out=cut[1:])  # a mark after a letter, white space after anything else
    cut[:-1] |= (data[:-1] == 0x20) & solid[1:]
    line = np.flatnonzero(data[1:-1] == 10) + 1
    cut[line[(ends[line - 1] != 0) & solid[line + 1]] + 1] = True
    cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(cut)


class _Table:
    """Pieces of up to KEY_BYTES bytes to numbers. A slot is three numbers of key and one of value; a key's is never 0."""

    def __init__(self, bits: int) -> None:
        self.bits, self.rows, self.n = bits, np.zeros((1 << bits, 4), U), 0

    def _slots(self, key: np.ndarray) -> np.ndarray:
        h = (key[:, 0] * ts.BASE ^ key[:, 1] * ts.STEP) + key[:, 2]
        return (ts.mixed(h) >> U(64 - self.bits)).astype(np.int64)

    def found(self, key: np.ndarray) -> np.ndarray:
        """Values, 0 for what isn't in the table."""
        out = np.zeros(len(key), U)
        at, who = self._slots(key), np.arange(len(key))
        while len(who):
            rows = self.rows.take(at, axis=0)
            hit = (rows[:, :3] == key).all(axis=1)
            out[who[hit]] = rows[hit, 3]
            on = ~hit & (rows[:, 2] != 0)
            who, key, at = who[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that aren't in the table."""
        self.n += len(key)
        at = self._slots(key)
        while len(key):
            free = np.flatnonzero(self.rows[at, 2] == 0)
            _, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.rows[at[own], :3], self.rows[at[own], 3] = key[own], value[own]
            left = np.ones(len(key), bool)
            left[own] = False
            key, value, at = key[left], value[left], (at[left] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str, entries: int = ENTRIES, pool: int = POOL, slot_bits: int = SLOT_BITS) -> None:
        self.library = Tokenizer.from_file(path)
        added = sorted((t.content.encode() for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added)) or rb"(?!)")
        # letters, after a space or not, are one pre-token, which the model takes as it stands, a character a byte
        self.bytewise = self.library.normalizer is None and isinstance(self.library.pre_tokenizer, ByteLevel) and not any(t.isalpha() for t in map(bytes.decode, added))
        self.entries, self.most, self.bits = min(entries, 7 << slot_bits >> 3), pool, slot_bits
        self.forget()

    def forget(self) -> None:
        self.table, self.longer, self.used = _Table(self.bits), {}, 0
        self.pool = np.zeros(self.most, np.uint32)

    def _kept(self, ids: np.ndarray) -> int:
        """The place of ids in the pool."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : self.used] = ids
        return at

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and the number of ids of each."""
        found: list[list[int] | None] = [None] * len(pieces)
        if self.bytewise:
            words = [i for i, p in enumerate(pieces) if p.isalpha() or p[0] == " " and p[1:].isalpha()]
            mapped = "\n".join([pieces[i] for i in words]).encode().decode("latin-1").translate(_BYTE_TO_CHARACTER).split(_BYTE_TO_CHARACTER[10])
            split = self.library.model.tokenize
            for i, word in zip(words, mapped, strict=False):
                found[i] = [t.id for t in split(word)]
        rest = [i for i, x in enumerate(found) if x is None]
        if rest:
            for i, e in zip(rest, self.library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
                found[i] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _holders(self, raw: bytes, offs: np.ndarray) -> list[int]:
        """Texts that hold an added token's string."""
        found: list[int] = []
        at = 0
        while hit := self.added.search(raw, at):
            i = int(np.searchsorted(offs, hit.start(), "right")) - 1
            if hit.end() <= offs[i + 1]:
                found.append(i)
                at = int(offs[i + 1])
            else:
                at = hit.start() + 1
        return found

    def encode_bytes(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and the number of ids of each."""
        start, raw = piece_starts(data, offs), data.tobytes()
        whole = self._holders(raw, offs)
        if whole:
            inside = np.zeros(len(data), bool)
            for i in whole:
                inside[offs[i] + 1 : offs[i + 1]] = True
            start = start[~inside[start]]
        size = np.diff(np.append(start, len(data)))
        place, count, own = self._looked_up(data, raw, start, size)
        total = np.cumsum(count)
        base, n = total - count, int(total[-1]) if len(total) else 0
        ids = self.pool.take(np.repeat(place - base, count) + np.arange(n))
        for i, x in own:  # too long to keep
            ids[base[i] : total[i]] = x
        bounds = np.concatenate(([0], total))[np.searchsorted(start, offs)]
        return ids, np.diff(bounds)

    def _looked_up(self, data: np.ndarray, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Place in the pool and number of ids of each piece; ids of pieces that aren't kept, whose place is 0."""
        short = np.flatnonzero(size <= KEY_BYTES)
        lanes, key = ts.Lanes(data), np.zeros((len(short), 3), U)
        at, n = start[short], size[short]
        key[:, 0], key[:, 2] = lanes.at(at, n), n.astype(U) << U(56)
        for j in (1, 2):
            more = np.flatnonzero(n > 8 * j)
            key[more, j] |= lanes.at(at[more] + 8 * j, n[more] - 8 * j)
        value = self.table.found(key)
        new = np.flatnonzero(value == 0)
        if len(new):
            order = new[np.lexsort(key[new].T)]
            first = order[np.append(True, (key[order[1:]] != key[order[:-1]]).any(axis=1))]
            if self.table.n + len(first) > self.entries or self.used > self.most or len(self.longer) > self.entries // 8:
                self.forget()
                return self._looked_up(data, raw, start, size) if len(first) <= self.entries else self._unkept(raw, start, size)
            ids, counts = self._ids([raw[a:b].decode() for a, b in zip(at[first].tolist(), (at + n)[first].tolist(), strict=True)])
            begin = self._kept(ids) + np.cumsum(counts) - counts
            self.table.add(key[first], begin.astype(U) << U(8) | counts.astype(U))
            value[new] = self.table.found(key[new])
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        place[short], count[short] = (value >> U(8)).astype(np.int64), (value & U(255)).astype(np.int64)
        own = []
        for i in np.flatnonzero(size > KEY_BYTES).tolist():
            piece = raw[start[i] : start[i] + size[i]]
            if (known := self.longer.get(piece)) is None:
                ids = np.array(self.library.encode_batch_fast([piece.decode()], add_special_tokens=False)[0].ids, np.uint32)
                if len(piece) > LONGEST_KEPT:
                    own.append((i, ids))
                    count[i] = len(ids)
                    continue
                known = self.longer[piece] = (self._kept(ids), len(ids))
            place[i], count[i] = known
        return place, count, own

    def _unkept(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """A text of more distinct pieces than the table holds: each is encoded where it stands."""
        ids, count = self._ids([raw[a:b].decode() for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
        parts = np.split(ids, np.cumsum(count)[:-1])
        return np.zeros(len(start), np.int64), count, list(enumerate(parts))

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow column (null: none), as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for _, _, data, offs in ts.chunks(column):
            ids, n = self.encode_bytes(data, offs)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out


def encoder(path: str) -> Encoder:
    """One a process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
