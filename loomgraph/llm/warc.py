"""WARC archives from a deterministic sharded writer, and their reader.

Pages are range-sorted by id, and by a hash of the payload's digest within an id, into shards that depend on the rows alone (``shards.cuts``). A task writes a shard's
records in order and starts a new file when the compressed size passes ``roll_bytes``; each record is a gzip member
of its own. Headers and digests are made anew from the payload. A file is written under a temporary name, moved to its own when complete,
and counts only once the manifest, written last, lists it; a repeated task writes the same bytes again.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is the response; the others
are revisits that carry no payload and name it. Smaller payloads are all responses.

Defined results: a null payload is empty; a null url is written as an empty target; a null id sorts last; of rows
with the same id and payload, one is the response and the others revisit it; an empty table gives no files.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import shards
from loomgraph.session import release, scratch, ship, written

LEAST = 100
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # fixed, so that reruns give the same bytes
_MANIFEST = "shard int, roll int, path string, n_records long, bytes long, sha256 string"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def _urn(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def _id(urn: str) -> int | None:
    own = urn.strip("<>").removeprefix("urn:page:")
    return None if own == "none" else int(own)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record as one gzip member."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of every record of a file; ValueError where a digest fails."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        member, parts, fed = zlib.decompressobj(31), [], at
        while not member.eof and fed < len(raw):
            parts.append(member.decompress(view[fed : fed + 16384]))
            fed = min(fed + 16384, len(raw))
        text = b"".join(parts)
        if not member.eof:
            raise ValueError(f"a record is cut off at {at}")
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise ValueError(f"a record's block differs from its digest at {at}")
        yield at, fields, block
        at = fed - len(member.unused_data)


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"file": None, "shard": None, "roll": 0}
        marked, taken = None, False

        def close() -> Iterator[pa.RecordBatch]:
            if (file := state["file"]) is not None:
                file.commit()
                row = (state["shard"], state["roll"], f"{folder}/{state['name']}", state["n"], state["bytes"], state["sha"].hexdigest())
                state["file"] = None
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["shard", "roll", "path", "n_records", "bytes", "sha256"])

        for batch in batches:
            for lo in range(0, len(batch), 64):
                rows = batch.slice(lo, 64).to_pylist()
                for r in rows:
                    if r["mark"]:
                        marked, taken = r, False
                        continue
                    revisit, refers_to = False, None
                    if marked is not None and (marked["id"], marked["digest"]) == (r["id"], r["digest"]):
                        refers_to = marked["refers_to"]
                        revisit = taken or r["id"] != refers_to
                        taken = True
                    if r["shard"] != state["shard"]:
                        yield from close()
                        state |= {"shard": r["shard"], "roll": 0}
                    elif state["file"] is not None and state["bytes"] >= roll_bytes:
                        yield from close()
                        state["roll"] += 1
                    if state["file"] is None:
                        state["name"] = f"shard-{state['shard']:06d}-{state['roll']:05d}.warc.gz"
                        state |= {"file": shards.Placed(folder, state["name"]), "n": 0, "bytes": 0, "sha": hashlib.sha256()}
                    raw = record(r["id"], r["url"], r["payload"], r["digest"], refers_to, revisit)
                    state["file"].write(raw)
                    state["sha"].update(raw)
                    state["n"] += 1
                    state["bytes"] += len(raw)
        yield from close()

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives and then ``folder``/manifest, which it returns."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(pages[html_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    key = F.coalesce(F.col("id"), F.lit(int(shards.LAST))).alias("key")
    tie = shards.ties(F.col("id"), "digest").alias("tie")
    slim = written(rows.select("id", "digest", F.octet_length("payload").cast("long").alias("size")), "pages")
    firsts = shards.cuts(slim.select(key, tie, (F.col("size") + 400).alias("weight")), shard_bytes)
    # a mark before each page whose payload occurs elsewhere: payloads move once, to their shard
    long_ = slim.where(F.col("size") >= least).select("id", "digest")
    several = long_.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = long_.join(several, "digest").groupBy("id", "digest").agg(F.min("refers_to").alias("refers_to"))
    marks = marks.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", F.lit(True).alias("mark"))
    stream = marks.unionByName(rows.select("id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("mark"))).select("*", key, tie)
    ranged = shards.sharded(stream, firsts, "digest", F.col("mark").desc(), "url")
    ranged.select("id", "url", "payload", "digest", "refers_to", "mark", "shard").mapInArrow(_writer(f"{folder}/files", roll_bytes), _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    release(spark)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, at = shards.store(path)
            with fs.open_input_stream(at, compression=None) as f:
                raw = f.read()
            if hashlib.sha256(raw).hexdigest() != sha:
                raise ValueError(f"{path} differs from the manifest")
            out = []
            for offset, fields, block in records(raw):
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"a payload differs from its digest: {path} at {offset}")
                refers = _id(fields["WARC-Refers-To"]) if kind == "revisit" else None
                out.append((_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, refers, path, offset))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [x.split()[0] for x in _READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read(listed: DataFrame) -> DataFrame:
    """The records of the listed archives; every digest is checked."""
    n = max(1, listed.count())
    parts = min(n, shards.MOST_PARTITIONS)
    spread = listed.select("path", "sha256", F.expr(f"int(pmod(xxhash64(path), {parts}))").alias("part"))
    if n <= shards.MOST_PARTITIONS:
        order = F.row_number().over(Window.orderBy("path")) - 1
        spread = spread.withColumn("part", order.cast("int"))
    return spread.repartitionById(parts, "part").select("path", "sha256").mapInArrow(_reader, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read(write(pages, scratch(spark, "warc")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id > m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id > m THEN m END AS refers_to
FROM q
"""
