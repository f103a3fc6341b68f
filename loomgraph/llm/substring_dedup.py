"""Removal of repeated passages: Rabin-Karp values of every window of ``size`` words, counted over all documents.

A window goes when its word sequence also starts in a document with a smaller id; what the removed windows cover
merges into maximal intervals.

The values of all windows are the bulk of the data, so they move as compressed blobs of entries (hash, document,
position) bucketed by the top bits of the hash, never as a row a window:

* map: each block of windows is combined first. Of equal windows only those of the smallest id are sent on; the
  others are already known to go. A window that a third of all documents hold is thus sent once a block.
* radix levels: at most ``LEVEL_BITS`` bits of the hash a shuffle, so blobs stay large at any input size; levels
  are added until a bucket has about ``BUCKET`` windows.
* count: in each bucket equal hashes meet, and all but those of the smallest id are removed. What a block already
  knows to go passes by as a group of its own, no larger than a block and without hashes.

Two Rabin-Karp values of independent word hashes, 96 bits together, tell windows apart: of w different windows about
w*w / 2**97 pairs agree by chance, 0.002 for the 17 trillion windows of 100 TB.

Defined results: null and empty texts have no words; texts of under ``size`` words lose nothing; rows with equal ids
don't remove one another's windows; a null id counts as the largest, 2**63 - 1; a text of any length is read whole,
by one task, whose memory grows with it (README); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import textscan as ts
from loomgraph.session import release, ship, written

BLOCK = 3 << 19
BUCKET = 2_000_000
LEVEL_BITS = 10
LAST = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 56) - 1)
_BLOB = "bucket long, hashes binary, rest binary"
_CUT = "k1 long, k2 long, pos int"


def _packed(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, h: np.ndarray | None = None, check: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """Entries in the order of documents and positions, with hashes or without. The top byte of a hash is not stored: the bucket has it."""
    first = np.ones(len(k1), bool)
    first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    at = np.flatnonzero(first)
    gaps = pos.astype(np.int64)
    gaps[1:] -= np.where(first[1:], 0, pos[:-1])
    gaps = gaps.astype(np.uint16 if gaps.max() < 1 << 16 else np.uint32)
    counts = np.diff(np.append(at, len(k1))).astype(np.uint32)
    head = np.array([len(k1), len(at), gaps.itemsize], np.int64)
    raw = b"".join(x.tobytes() for x in (head, np.diff(k1[at], prepend=0), k2[at], counts, gaps))
    hashes = b"" if h is None else np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes() + check.tobytes()
    return hashes, zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(hashes: bytes, rest: bytes) -> tuple[np.ndarray, ...]:
    """k1, k2 and pos, and with hashes also h and check."""
    raw = zstandard.ZstdDecompressor().decompress(rest)
    n, docs, width = np.frombuffer(raw, np.int64, 3)
    k1 = np.cumsum(np.frombuffer(raw, np.int64, docs, 24))
    k2 = np.frombuffer(raw, np.int64, docs, 24 + 8 * docs)
    counts = np.frombuffer(raw, np.uint32, docs, 24 + 16 * docs).astype(np.int64)
    gaps = np.frombuffer(raw, {2: np.uint16, 4: np.uint32}[int(width)], n, 24 + 20 * docs).astype(np.int64)
    total, start = np.cumsum(gaps), np.cumsum(counts) - counts
    pos = total - np.repeat(total[start] - gaps[start], counts)
    entries = np.repeat(k1, counts), np.repeat(k2, counts), pos
    if not hashes:
        return entries
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :7] = np.frombuffer(hashes, np.uint8, 7 * n).reshape(-1, 7)
    return *entries, wide.view(np.uint64).ravel(), np.frombuffer(hashes, np.uint32, n, 7 * n)


def _grouped(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, entries of one window as they were, and where each window begins in it."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if (same & (check[order[1:]] != check[order[:-1]])).any():  # two windows of one h
        order = np.lexsort((check, h))
        same = (h[order[1:]] == h[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    return order, np.append(np.ones(min(1, len(h)), bool), ~same)


def _split(bucket: np.ndarray, entries: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """A blob for each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(order) else np.zeros(0, int)
    for i in range(0, len(at), 64):
        rows = []
        for lo, hi in zip(at[i : i + 64], np.append(at, len(order))[i + 1 : i + 65], strict=True):
            own = np.sort(order[lo:hi])
            rows.append((int(sorted_[lo]), *_packed(*(x[own] for x in entries))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "hashes", "rest"])


class _Block:
    """Windows of some documents, combined before they are sent."""

    def __init__(self) -> None:
        self.k1, self.k2, self.parts, self.docs, self.n = [], [], [], 0, 0

    def add(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, pos: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        self.k1.append(k1)
        self.k2.append(k2)
        self.parts.append(((doc + self.docs).astype(np.int32), pos.astype(np.int32), h, check))
        self.docs, self.n = self.docs + len(k1), self.n + len(h)

    def sent(self, bits: int, number: int) -> Iterator[pa.RecordBatch]:
        """number: of this block, among all."""
        if not self.n:
            return
        k1, k2 = np.concatenate(self.k1), np.concatenate(self.k2)
        doc, pos, h, check = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        rank = np.empty(len(k1), np.int64)
        rank[np.lexsort((k2, k1))] = np.arange(len(k1))
        by_id = np.argsort(rank[doc], kind="stable")
        doc, pos, h, check = doc[by_id], pos[by_id], h[by_id], check[by_id]
        order, first = _grouped(h, check)
        least = k1[doc[order[first]]][np.cumsum(first) - 1]
        goes = k1[doc[order]] > least
        on, off = np.sort(order[~goes]), np.sort(order[goes])
        bucket = (h[on] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(on), np.int64)
        yield from _split(bucket, (k1[doc[on]], k2[doc[on]], pos[on], h[on], check[on]))
        if len(off):  # known already: a negative bucket of its own, which only passes it on
            yield _one(-1 - number, *_packed(k1[doc[off]], k2[doc[off]], pos[off]))


def _one(bucket: int, hashes: bytes, rest: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([hashes], pa.binary()), pa.array([rest], pa.binary())], ["bucket", "hashes", "rest"])


def _blobs(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offs in ts.chunks(batch.column(2)):
                start, end, row = ts.words(data, offs)
                at, value = ts.windows(ts.span_hashes(data, start, end), row, size)
                check = (ts.windows(ts.span_hashes(data, start, end, salt=1), row, size)[1] >> np.uint64(32)).astype(np.uint32)
                before = np.searchsorted(row, np.arange(hi - lo))
                block.add(k1[lo:hi], k2[lo:hi], row[at], at - before[row[at]], value, check)
                if block.n >= BLOCK:
                    yield from block.sent(bits, number)
                    block, number = _Block(), number + 1
        yield from block.sent(bits, number)

    return run


def _finer(low: int, bits: int):
    """Buckets of ``low`` bits to buckets of ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                k1, k2, pos, h, check = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((pos, k2, k1))
                k1, k2, pos, h, check = k1[order], k2[order], pos[order], h[order], check[order]
                top = np.uint64(now) << np.uint64(64 - low) if low else np.uint64(0)
                full = (h & (np.uint64((1 << (64 - low)) - 1))) | top
                yield from _split((full >> np.uint64(64 - bits)).astype(np.int64), (k1, k2, pos, full, check))

        for batch in batches:
            for bucket, hashes, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now or n >= 4 * BLOCK:
                    yield from flush()
                    held, n, now = [], 0, bucket
                if bucket < 0:
                    yield _one(bucket, hashes, rest)
                    continue
                held.append(_unpacked(hashes, rest))
                n += len(held[-1][0])
        yield from flush()

    return run


def _counted(table: pa.Table) -> pa.Table:
    """The entries of one bucket that go."""
    parts = [_unpacked(a, b) for a, b in zip(table["hashes"].to_pylist(), table["rest"].to_pylist(), strict=True)]
    k1, k2, pos, *hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    if hashes:
        order, first = _grouped(*hashes)
        least = np.minimum.reduceat(k1[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        gone = np.sort(order[k1[order] > least])
        k1, k2, pos = k1[gone], k2[gone], pos[gone]
    return pa.table({"k1": k1, "k2": k2, "pos": pos.astype(np.int32)})


def _merged(size: int):
    """Sorted window starts to maximal intervals [from, to) of words, as a flat list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(2)
            values, offs = starts.flatten().to_numpy(), starts.offsets.to_numpy() - starts.offsets[0].as_py()
            row = np.repeat(np.arange(len(starts)), np.diff(offs))
            order = np.lexsort((values, row))
            values = values[order]
            opens = np.ones(len(values), bool)
            opens[1:] = (row[1:] != row[:-1]) | (values[1:] > values[:-1] + size)
            at = np.flatnonzero(opens)
            flat = np.empty(2 * len(at), np.int32)
            flat[::2], flat[1::2] = values[at], values[np.append(at[1:], len(values)) - 1] + size
            ends = np.searchsorted(row[at], np.arange(len(starts) + 1)) * 2
            cuts = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cuts], ["k1", "k2", "cuts"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1 and k2 tell rows apart, except where id and text are equal."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(int(LAST))).alias("k1"),
        F.xxhash64(docs[text_col]).alias("k2"),
        docs[text_col].alias("text"), docs[id_col].alias("id"),
    )


def removal_intervals(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, level_bits: int = LEVEL_BITS) -> DataFrame:
    """k1, k2 and ``cuts``, the flat list of word intervals to remove, of every document that loses words."""
    spark = docs.sparkSession
    ship(spark)
    rows = _keyed(docs, id_col, text_col).select("k1", "k2", "text")
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (chars // 6 // bucket).bit_length())
    low = min(bits, level_bits)
    blobs = rows.mapInArrow(_blobs(size, low), _BLOB)
    while low < bits:
        high = min(bits, low + level_bits)
        blobs = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_finer(low, high), _BLOB)
        low = high
    gone = blobs.groupBy("bucket").applyInArrow(_counted, _CUT)
    starts = gone.groupBy("k1", "k2").agg(F.collect_list("pos").alias("starts"))
    cuts = written(starts.mapInArrow(_merged(size), "k1 long, k2 long, cuts array<int>"), "substring-cuts")
    release(spark)
    return cuts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            counts, gone, kept = [], [], []
            for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                stay = words
                if cuts:
                    edges = [0, *cuts, len(words)]
                    stay = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                counts.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), part.column(2)], ["id", "n_words", "n_removed", "kept_text", "cuts"])


def substring_dedup(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row a row: id, n_words, n_removed, kept_text (kept words joined by one space), cuts (null: none)."""
    cuts = removal_intervals(docs, size, id_col, text_col, **options)
    rows = _keyed(docs, id_col, text_col)
    both = rows.join(cuts, ["k1", "k2"], "left").select("id", "text", "cuts")
    kind = both.schema["id"].dataType.simpleString()
    return both.mapInArrow(_cut, f"id {kind}, n_words long, n_removed long, kept_text string, cuts array<int>").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM wins) WHERE doc_id > m
), cover AS (
  SELECT DISTINCT doc_id, i + j AS p FROM gone, (SELECT unnest(range(0, 13)) AS j)
), kept AS (
  SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.p) AS s, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) u ANTI JOIN cover c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY u.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
