"""Token ids in files: range-coded blocks that are reset and checksummed one by one.

File: ``HEAD`` (magic, version, ids a block, number of ids in the vocabulary, blocks, documents, ids), then the
document index (zlib: document ids and lengths), the order-0 shares of the coder (zlib: the file's distinct ids and the
share of each), the table of blocks (ids, bytes, crc32 of the ids, crc32 of the code), the codes, and a crc32 of all
that. With the shares any block can be decoded alone; a last block that isn't full is coded in step with the others, its
last id repeated. Documents are in ascending order of id, in shards cut by ``shards.cuts``; the manifest, written last,
lists the files that count.

Defined results: a null or empty text has the end id alone; a null document id sorts last; rows with equal ids each
have their own entry, in the order of a hash of their texts; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import range_coder, shards, tokens
from loomgraph.session import release, scratch, ship, written

END_ID = 2
N_IDS = 50_257
BLOCK_IDS = 4096
LANES = 3072
SHARD_BYTES = 24 << 20
MAGIC, VERSION = b"LOOMTOK1", 2
HEAD = struct.Struct("<8sIIIIQQ")
_COUNTED = 1 << 20  # ids counted at once
_MANIFEST = "shard int, roll int, path string, n_docs long, n_ids long, bytes long"


def to_bytes(doc_ids: list[int | None], bodies: list[bytes], n_ids: int = N_IDS, block_ids: int = BLOCK_IDS) -> bytes:
    """One file's bytes."""
    ids = np.frombuffer(b"".join(bodies), "<u4")
    if len(ids) and int(ids.max()) >= n_ids:
        raise ValueError("an id is outside the vocabulary")
    counts = np.zeros(n_ids, np.int64)
    for lo in range(0, len(ids), _COUNTED):
        counts += np.bincount(ids[lo : lo + _COUNTED], minlength=n_ids)
    shares = range_coder.shares_of(counts)
    some = np.flatnonzero(shares)
    order0 = zlib.compress(np.stack([np.diff(some, prepend=0), shares[some]]).astype("<u4").tobytes(), 6)
    length = min(block_ids, len(ids))
    spans = [ids[lo : lo + block_ids] for lo in range(0, len(ids), block_ids)]
    codes: list[bytes] = []
    for lo in range(0, len(spans), LANES):
        blocks = ids[lo * block_ids : (lo + LANES) * block_ids]
        if short := -len(blocks) % length:
            blocks = np.append(blocks, np.repeat(blocks[-1], short))
        codes += range_coder.encoded(blocks.reshape(-1, length), n_ids, shares)
    docs = np.array([(x is not None, x or 0) for x in doc_ids], np.int64).reshape(-1, 2)
    lengths = np.array([len(b) // 4 for b in bodies], np.int64)
    index = zlib.compress(np.concatenate([docs[:, 0], docs[:, 1], lengths]).astype("<i8").tobytes(), 1)
    table = np.array([(len(s), len(c), zlib.crc32(s.tobytes()), zlib.crc32(c)) for s, c in zip(spans, codes, strict=True)], "<u4").reshape(-1, 4)
    out = HEAD.pack(MAGIC, VERSION, block_ids, n_ids, len(codes), len(doc_ids), len(ids)) + struct.pack("<QQ", len(index), len(order0)) + index + order0 + table.tobytes() + b"".join(codes)
    return out + struct.pack("<I", zlib.crc32(out))


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids; raises ValueError where a checksum fails."""
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("the file's checksum fails")
    magic, version, block_ids, n_ids, n_blocks, n_docs, total = HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file")
    size, size0 = struct.unpack_from("<QQ", raw, HEAD.size)
    at = HEAD.size + 16
    index = np.frombuffer(zlib.decompress(raw[at : at + size]), "<i8").reshape(3, n_docs)
    at += size
    steps, own = np.frombuffer(zlib.decompress(raw[at : at + size0]), "<u4").reshape(2, -1).astype(np.int64)
    shares = np.zeros(n_ids, np.int64)
    shares[np.cumsum(steps)] = own
    at += size0
    table = np.frombuffer(raw, "<u4", 4 * n_blocks, at).reshape(-1, 4)
    at += 16 * n_blocks
    codes = []
    for _, length, _, crc in table.tolist():
        codes.append(raw[at : at + length])
        at += length
        if zlib.crc32(codes[-1]) != crc:
            raise ValueError("a block's checksum fails")
    parts, length = [], min(block_ids, total)
    for lo in range(0, n_blocks, LANES):
        parts.append(range_coder.decoded(codes[lo : lo + LANES], length, n_ids, shares).reshape(-1))
    ids = np.concatenate(parts).astype("<u4")[:total] if parts else np.zeros(0, "<u4")
    for i, (length, _, crc, _) in enumerate(table.tolist()):
        if zlib.crc32(ids[i * block_ids : i * block_ids + length].tobytes()) != crc:
            raise ValueError("a block's ids differ from those written")
    if len(ids) != total or int(table[:, 0].sum()) != total:
        raise ValueError("ids are missing")
    return [int(x) if has else None for has, x in zip(index[0], index[1], strict=True)], index[2], ids


def _writer(path: str, folder: str, end_id: int, n_ids: int, most_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        now, roll, doc_ids, bodies, held = None, 0, [], [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            if now is not None:
                raw = to_bytes(doc_ids, bodies, n_ids)
                name = f"shard-{now:06d}-{roll:05d}.ltk"
                file = shards.Placed(folder, name)
                file.write(raw)
                file.commit()
                row = (now, roll, f"{folder}/{name}", len(doc_ids), held // 4, len(raw))
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["shard", "roll", "path", "n_docs", "n_ids", "bytes"])

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                coded = encode(part.column(1))
                for key, body, shard in zip(part.column(0).to_pylist(), coded, part.column(2).to_pylist(), strict=True):
                    if shard != now:
                        yield from closed()
                        now, roll, doc_ids, bodies, held = shard, 0, [], [], 0
                    elif held + len(body) + len(end) > 4 * most_ids:
                        yield from closed()
                        roll, doc_ids, bodies, held = roll + 1, [], [], 0
                    doc_ids.append(key)
                    bodies.append(body + end)
                    held += len(bodies[-1])
        yield from closed()

    return run


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, n_ids: int = N_IDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the files and then their manifest, ``folder``/manifest; returns the manifest with each file's number and first place.

    A text has no more ids than bytes, so a shard is one file of ``shard_bytes`` ids at most; only one that can't be cut
    further, of a very long text or many equal rows, goes on in a next file (``roll``) beyond that.
    """
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.col("id"), F.lit(int(shards.LAST))).alias("key")
    tie = shards.ties(F.col("id"), "text").alias("tie")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).select("id", "text", key, tie)
    slim = written(rows.select("key", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("weight")), "token-sizes")
    ranged = shards.sharded(rows, shards.cuts(slim, shard_bytes))
    run = _writer(path or tokens.default_path(), f"{folder}/files", end_id, n_ids, shard_bytes)
    ranged.select("id", "text", "shard").mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    release(spark)
    listed = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    order = Window.orderBy("shard", "roll")  # a row a file
    before = F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return listed.select("*", (F.row_number().over(order) - 1).alias("number"), F.coalesce(before, F.lit(0)).alias("first"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, at = shards.store(path)
            with fs.open_input_stream(at, compression=None) as f:
                doc_ids, lengths, ids = from_bytes(f.read())
            raw, ends = memoryview(ids.tobytes()), np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read(listed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document in the listed files, from the files alone."""
    n = max(1, listed.count())
    parts = min(n, shards.MOST_PARTITIONS)
    spread = listed.select("path", "first", "number").repartitionById(parts, F.expr(f"int(number % {parts})")).select("path", "first")
    return spread.mapInArrow(_reader, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(written(write(docs, scratch(spark, "tokens")), "token-files"))
