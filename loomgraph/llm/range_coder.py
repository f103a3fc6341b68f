"""Context-mixing range coder for token ids, many independent blocks in lockstep.

Each step mixes three distributions into one: the order-2 prediction gets a share by its confidence, the order-1
prediction a share of the rest by its own, order 0 what is left.

* order 2 and order 1: a hashed table maps the last two ids, or the last one, to the id that followed, with a
  confidence that grows with each hit and halves with each miss. It starts empty in each block.
* order 0: the shares of ids that ``shares_of`` makes of counts, the same for all blocks, so that a block can be
  decoded alone with these. Without counts all classes of ids (narrow for small ids, which are the frequent ones)
  are equally likely, and so are the ids of a class.

The interval drives a range coder of 52 bits with output words of 24 bits. All its numbers are whole and below 2^53,
so they are exact as floating-point numbers, in which numpy multiplies and divides fastest; the floor of a quotient of
two such numbers is exact as well. An interval is never less than 2^28 wide after a step: a unit is at least 8 wide,
and no id has less than 3 units (a prediction's share is far more, order 0 leaves at least 2^19 of 2^25 to at most
2^17 parts). A carry stays the 25th bit of the next word and is added to the words before when all is coded.

numpy works on one id of every block at a time, so the cost of Python is shared by all blocks.
"""

from __future__ import annotations

import numpy as np

BITS = 25  # of the distribution
SLOT_BITS = 11
MOST_BITS = 17  # of order 0
_ONE, _LEAST, _WORD, _TOP = float(1 << BITS), float(1 << 28), float(1 << 24), float(1 << 52)
_TO_UNIT, _TO_WORD = 1 / _ONE, 1 / _LEAST
_CONF = 15
#: Share of a prediction by its confidence, none at 0; below one by a margin, so that every id keeps an interval.
_SHARE = np.array([0, *((c + 0.5) / (c + 2.0) * 0.96 for c in range(1, _CONF + 1))])
#: By 16 times the confidence of order 2 and that of order 1: the share of order 2, and those of both.
_TWO = np.repeat(np.floor(_SHARE * _ONE), _CONF + 1)
_BOTH = _TWO + np.floor(np.tile(_SHARE, _CONF + 1) * (_ONE - _TWO))
_C = np.arange(_CONF + 1)
#: Confidence after a miss and, 16 places on, after a hit; from 4 on a prediction survives a miss.
_AFTER = np.concatenate([_C >> 1, np.minimum(_C + 1, _CONF)])
_STAYS = np.concatenate([_C >= 4, _C >= 0])
#: What a table's entry, its confidence set to 15 and its id combined by XOR with the one that came, keeps: the id's bits where the prediction stays, and the new confidence.
_KEPT = np.where(_STAYS, 0xFFFFFFF0 | _AFTER, 1).astype(np.uint32)
_U1, _U4, _U15 = np.array(1, np.uint32), np.array(4, np.uint32), np.array(15, np.uint32)
_B4, _B16, _MASK = np.array(4, np.uint8), np.array(16, np.uint8), np.array((1 << SLOT_BITS) - 1)


def class_starts(n_ids: int) -> np.ndarray:
    """First ids of the classes: width 8 below 1024, 64 below 8192, 512 above."""
    top = max(n_ids, 8193)
    return np.concatenate([np.arange(0, 1024, 8), np.arange(1024, 8192, 64), np.arange(8192, top, 512)]).astype(np.int64)


def shares_of(weights: np.ndarray) -> np.ndarray:
    """Order-0 shares by id: none where the weight is 0, else at least 1; their sum is a power of two."""
    some = np.flatnonzero(weights)
    bits = min(max(12, (8 * len(some)).bit_length()), MOST_BITS)
    if len(some) > 1 << bits - 1:
        raise ValueError(f"{len(some)} ids are more than order 0 tells apart")
    part = weights[some] / weights.sum()
    low, high = 0, 1 << bits  # the largest scale at which the sum, with 1 at least for each, isn't above
    while high - low > 1:
        mid = low + high >> 1
        low, high = (mid, high) if np.maximum(np.floor(part * mid), 1).sum() <= 1 << bits else (low, mid)
    out = np.zeros(len(weights), np.int64)
    out[some] = np.maximum(np.floor(part * low), 1)
    if len(some):
        out[some[np.argmax(part)]] += (1 << bits) - out.sum()
    return out


class _Model:
    """State of all lanes. Tables hold id + 1 and, in the low four bits, its confidence; 0 is empty. A slot's entries of all lanes lie side by side."""

    def __init__(self, lanes: int, n_ids: int, shares: np.ndarray | None = None) -> None:
        self.start = class_starts(n_ids)
        widths = np.diff(np.append(self.start, self.start[-1] + 512))
        self.shift = np.log2(widths).astype(np.int64)
        self.classes = np.repeat(np.arange(len(widths)), widths)
        if shares is None:
            shares = shares_of(1.0 / widths[self.classes[:n_ids]])
        self.n_parts = int(shares.sum())
        self.shares0, self.below0 = shares.astype(float), (np.cumsum(shares) - shares).astype(float)
        self.left = np.floor((_ONE - _BOTH) / max(1, self.n_parts))
        self.tables = np.zeros(2 * lanes << SLOT_BITS, np.uint32)
        self.two, self.one = self.tables[: lanes << SLOT_BITS], self.tables[lanes << SLOT_BITS :]
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.slot = np.zeros((2, lanes), np.int64)

    def slots(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s2 = first * 40503
        s2 += second * 10007
        s2 >>= 3
        s2 &= _MASK
        s2 *= self.lanes
        s2 += self.lane
        s1 = first & _MASK
        s1 *= self.lanes
        s1 += self.lane
        return s2, s1

    def shares(self, s2: np.ndarray, s1: np.ndarray) -> None:
        self.slot[0] = s2
        np.add(s1, len(self.two), out=self.slot[1])
        self.entry = self.tables[self.slot]
        self.known = self.entry >> _U4
        self.conf = (self.entry & _U15).astype(np.uint8)
        p2, p1 = self.known
        both = self.conf[1] * (p1 != p2).view(np.uint8)
        both |= self.conf[0] << _B4
        both = both.astype(np.int64)
        self.f2, self.head, self.unit = _TWO[both], _BOTH[both], self.left[both]

    def learn(self, named: np.ndarray, classes: np.ndarray | None, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """named: id + 1, as uint32; hits: whether each prediction was right. Order 0 learns nothing, so ids' classes don't matter."""
        came = named << _U4
        entry, how = self.entry, self.conf
        for h, hit in zip(how, (hit2, hit1), strict=True):
            h += hit.view(np.uint8) * _B16
        entry |= _U15
        entry ^= came
        entry &= _KEPT[how.astype(np.int64)]
        entry ^= came
        self.tables[self.slot] = entry


def encoded(blocks: np.ndarray, n_ids: int, shares: np.ndarray | None = None) -> list[bytes]:
    """Each row of ``blocks`` (ids, one length for all) as a code of its own."""
    lanes, length = blocks.shape
    model = _Model(lanes, n_ids, shares)
    low, size = np.zeros(lanes), np.full(lanes, _TOP)
    out = np.zeros((length + 1, lanes), np.uint32)
    flat, at = out.reshape(-1), np.arange(lanes)
    first = second = np.zeros(lanes, np.int64)
    for column in np.ascontiguousarray(blocks.T):
        ids = column.astype(np.int64)
        model.shares(*model.slots(first, second))
        named = column.astype(np.uint32, copy=False) + _U1
        hit2, hit1 = model.known == named
        start = model.head + model.unit * model.below0[ids]
        freq = model.unit * model.shares0[ids]
        np.copyto(start, model.f2, where=hit1)
        np.copyto(freq, model.head - model.f2, where=hit1)
        np.copyto(start, 0, where=hit2)
        np.copyto(freq, model.f2, where=hit2)
        unit = np.floor(size * _TO_UNIT)
        low += unit * start
        size = unit * freq
        full = size < _LEAST
        who = np.flatnonzero(full)
        place, part = at[who], low[who]
        word = np.floor(part * _TO_WORD)
        flat[place] = word  # the whole number, carry included
        at[who] = place + lanes
        word *= _LEAST
        part -= word
        part *= _WORD
        low[who] = part
        size[who] *= _WORD
        model.learn(named, None, hit2, hit1)
        second, first = first, ids
    flat[at] = np.ceil(low * _TO_WORD)  # with nothing but zeros after it a number inside the interval
    used = at // lanes + 1
    out = out[: int(used.max(initial=0))]
    while (carry := out >> np.uint32(24)).any():
        out &= np.uint32(0xFFFFFF)
        out[:-1] += carry[1:]
    parts = np.ascontiguousarray(out.T.astype("<u4")).view(np.uint8).reshape(lanes, -1, 4)
    return [p[:n, :3].tobytes() for p, n in zip(parts, used.tolist(), strict=True)]


def decoded(codes: list[bytes], length: int, n_ids: int, shares: np.ndarray | None = None) -> np.ndarray:
    """The blocks again."""
    lanes = len(codes)
    parts = np.zeros((lanes, max(map(len, codes)) // 3 + 4, 4), np.uint8)
    for p, code in zip(parts, codes, strict=True):
        p[: len(code) // 3, :3] = np.frombuffer(code, np.uint8).reshape(-1, 3)
    words = np.ascontiguousarray(parts.view("<u4")[:, :, 0].T.astype(np.uint32))
    # 52 bits are two words and 4 bits, so what comes in is 20 bits of one and 4 of the next
    value = words[0] * _LEAST + words[1] * 16.0 + (words[2] >> np.uint32(20))
    flat = ((words[2:-1] & np.uint32(0xFFFFF)) << _U4 | words[3:] >> np.uint32(20)).reshape(-1)
    model = _Model(lanes, n_ids, shares)
    some = np.flatnonzero(model.shares0)
    owner = np.repeat(np.arange(len(some)), model.shares0[some].astype(np.int64))
    share, below, name = model.shares0[some], model.below0[some], (some + 1).astype(np.uint32)
    size, at = np.full(lanes, _TOP), np.arange(lanes)
    out = np.zeros((length, lanes), np.uint32)
    first = second = np.zeros(lanes, np.int64)
    for t in range(length):
        model.shares(*model.slots(first, second))
        unit = np.floor(size * _TO_UNIT)
        two, both, each = unit * model.f2, unit * model.head, unit * model.unit
        rest = value - both
        known, in2 = rest < 0, value < two
        who = owner.take((rest / each).astype(np.int64), mode="clip")
        named = name[who]
        start, size = both + each * below[who], each * share[who]
        p2, p1 = model.known
        for low, wide, guess, where in ((two, both - two, p1, known), (0, two, p2, in2)):
            np.copyto(start, low, where=where)
            np.copyto(size, wide, where=where)
            np.copyto(named, guess, where=where)
        value -= start
        moved = np.flatnonzero(size < _LEAST)
        place = at[moved]
        value[moved] = value[moved] * _WORD + flat[place]
        size[moved] *= _WORD
        at[moved] = place + lanes
        model.learn(named, None, *(model.known == named))
        out[t] = named
        second, first = first, named.astype(np.int64) - 1
    out -= _U1
    return out.T
