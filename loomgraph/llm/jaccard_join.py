"""Similarity join of word n-gram sets by Jaccard, with prefixes under several global token orders.

Rows with equal sets form a class first; what follows works on classes. Two sets of similarity t or more share a
token among the first n - ceil(t * n) + 1 of each under any global order of tokens, so the filters intersect:

* order A, by the exact counts of a sketch of document frequencies and then by hash, makes the candidates. Sets meet in
  the bucket of a prefix token, subject to the length filter and the positional filter;
* orders B and C, by the counts' rough logarithm and two other hashes, must each find a common prefix token too. The
  prefixes of all three orders come from one pass over the texts; those of B and C, 32 bits a token, decide before any
  full set is made: sets exist only for candidates that all three orders let pass, and are then intersected.

In each bucket, every set is matched with the bucket's pivot (the set in which the token stands first). Verified links
make components, and of what is left only sets of one bucket in different components and of similar length are matched
with each other: pairs inside a component can't change the result. Pivots and tokens of many sets are dealt over many
tasks (``skew``). The orders and the sketch decide how much work there is, never which links are found.

Defined results: nulls and texts without words have no set and are linked with nothing; texts of fewer words than an
n-gram have their whole word sequence as the only element; texts of any length are read whole, each by one task; rows
with equal ids but different texts are sets of their own; a component has the smallest id in it, null only if all are;
an empty table gives an empty result; further columns may have any names and are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import skew
from loomgraph.llm import textscan as ts
from loomgraph.llm.columns import Plain
from loomgraph.session import release, ship, written

U = np.uint64
CELL_BITS = 24
_SEGMENT_BITS = 18
_SALTS = (U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25), U(0xD1B54A32D192ED03))


def shingles(data: np.ndarray, offs: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the distinct n-grams of each row, in that order."""
    data = ts.lowered(data)
    start, end, row = ts.words(data, offs)
    h = ts.span_hashes(data, start, end)
    if seed:
        h = ts.mixed(h + U(seed) * ts.BASE)
    at, value = ts.windows(h, row, size)
    rows, values = [row[at]], [value]
    n = ts.per_row(row, len(offs) - 1)
    for m in range(1, size):
        at, value = ts.windows(h, row, m)
        short = n[row[at]] == m
        rows.append(row[at][short])
        values.append(ts.mixed(value[short] + U(m)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _cells(value: np.ndarray) -> np.ndarray:
    return (value >> U(64 - CELL_BITS)).astype(np.int64)


def _sketch(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << CELL_BITS, np.uint16)  # counts end at 65535
        for batch in batches:
            for _, _, data, offs in ts.chunks(batch.column(0)):
                cell, n = np.unique(_cells(shingles(data, offs, size, seed)[1]), return_counts=True)
                seen[cell] = np.minimum(seen[cell] + n, 65535)
        part = TaskContext.get().partitionId() % 32
        for segment, own in enumerate(seen.reshape(-1, 1 << _SEGMENT_BITS)):
            if own.any():
                yield _segment(part, segment, own)

    return run


def _segment(part: int, segment: int, counts: np.ndarray) -> pa.RecordBatch:
    """The cells of a segment that aren't zero."""
    at = np.flatnonzero(counts)
    raw = np.diff(at, prepend=0).astype(np.uint32).tobytes() + np.minimum(counts[at], 65535).astype(np.uint16).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(raw)], pa.binary())], ["part", "segment", "counts"])


def _counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, np.uint32, n)), np.frombuffer(raw, np.uint16, n, 4 * n)


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << _SEGMENT_BITS, np.uint32)
    for blob in table["counts"]:
        at, own = _counts(blob.as_py())
        total[at] += own
    return pa.Table.from_batches([_segment(0, table["segment"][0].as_py(), total)])


def frequency_sketch(docs: DataFrame, size: int, seed: int, text_col: str = "text") -> np.ndarray:
    """Documents that hold an n-gram of each cell, about: one byte a cell, rising with the count. 16 MB at any input size."""
    counts = docs.select(docs[text_col].alias("text")).mapInArrow(_sketch(size, seed), "part int, segment int, counts binary")
    kind = "part int, segment int, counts binary"
    summed = counts.groupBy("segment", "part").applyInArrow(_added, kind).groupBy("segment").applyInArrow(_added, kind)
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for row in summed.select("segment", "counts").toLocalIterator():
        at, own = _counts(bytes(row["counts"]))
        out[(row["segment"] << _SEGMENT_BITS) + at] = np.minimum(255, np.where(own < 128, own, 16 * np.log2(own + 1.0) + 16)).astype(np.uint8)
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefix(value: np.ndarray, level: np.ndarray, order: int, p: int) -> np.ndarray:
    """The first p tokens under an order, in that order."""
    level = level.astype(U) if order == 0 else np.log2(level.astype(np.float64) + 1).astype(U)
    key = level << U(56) | ts.mixed(value ^ _SALTS[order]) >> U(8)
    if p < len(key):
        first = np.argpartition(key, p - 1)[:p]
        return value[first[np.argsort(key[first])]]
    return value[np.argsort(key)]


def _marks(value: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of each row's set."""
    ends = np.cumsum(n)
    sums = [np.concatenate(([U(0)], np.cumsum(ts.mixed(value ^ s), dtype=U))) for s in _SALTS[:2]]
    return [ts.mixed(x[ends] - x[ends - n] + n.astype(U)).view(np.int64) for x in sums]


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


_PREFIXES = "id long, text_hash long, cid long, mark long, n long, pa array<long>, pb array<int>, pc array<int>"


def _prefixes(size: int, seed: int, num: int, den: int, sketch):
    """Name, size and the prefixes under all orders of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            for lo, hi, data, offs in ts.chunks(batch.column(1)):
                row, value = shingles(data, offs, size, seed)
                n = ts.per_row(row, hi - lo)
                marks, level = _marks(value, n), cells[_cells(value)]
                own = [(value[e - k : e], level[e - k : e], prefix_length(int(k), num, den)) for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
                first = [[_prefix(v, c, order, p) if len(v) else v for v, c, p in own] for order in range(3)]
                lists = [_lists([x.view(np.int64) for x in first[0]], np.int64), *(_lists([(x >> U(32)).astype(np.uint32).view(np.int32) for x in parts], np.int32) for parts in first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(marks[0]), pa.array(marks[1]), pa.array(n), *lists], ["id", "text_hash", "cid", "mark", "n", "pa", "pb", "pc"])

    return run


def _sets(size: int, seed: int):
    """Name and set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in ts.chunks(batch.column(1)):
                row, value = shingles(data, offs, size, seed)
                n = ts.per_row(row, hi - lo)
                full = [_short(value[e - k : e]) for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_marks(value, n)[0]), pa.array(full, pa.binary())], ["cid", "full"])

    return run


def _short(value: np.ndarray) -> bytes:
    """The upper 48 bits of sorted tokens: enough to compare two sets."""
    return np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8)
    wide = np.zeros((len(flat) // 6, 8), np.uint8)
    wide[:, 2:] = flat.reshape(-1, 6)
    return wide.view(U).ravel()


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *parts = batch.columns
            keep = np.zeros(len(batch), bool)
            for i, (one, two) in enumerate(zip(*parts, strict=True)):
                x, y = _long(one.as_buffer()), _long(two.as_buffer())
                both = _common(x, y)
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def components(edges: DataFrame) -> DataFrame:
    """v and the smallest v in its component, by least neighbours and pointer jumping; tables cut the lineage."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "join-edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")).select("v", F.least("v", "l").alias("l"))
    labels = written(labels, "join-labels")
    while True:
        near = both.join(labels, both["a"] == labels["v"]).groupBy(both["b"].alias("w")).agg(F.min("l").alias("m"))
        one = labels.join(near, labels["v"] == near["w"]).select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        up = labels.select(F.col("v").alias("p"), F.col("l").alias("pl"))
        new = written(one.join(up, one["l"] == up["p"]).select("v", "old", F.least("l", "pl").alias("l")), "join-labels")
        done = new.where("l <> old").isEmpty()
        labels = new.select("v", "l")
        if done:
            return labels


def _filtered(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Length and positional filters on n1, i1, n2, i2."""
    long_enough = F.least("n1", "n2") * den >= F.greatest("n1", "n2") * num
    room = F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2"))
    return pairs.where(long_enough & (room * (num + den) >= (F.col("n1") + F.col("n2")) * num))


def _both_sides(pairs: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """a and b with columns of ``table`` (by cid) for a, ending in 1, and for b, ending in 2; ids of many pairs are dealt out."""
    out = pairs.select("a", "b")
    total = out.count()
    for side, other, k in (("a", "b", 1), ("b", "a", 2)):
        own = table.select(F.col("cid").alias(side), *(F.col(c).alias(f"{c}{k}") for c in names))
        out = skew.join_salted(out, own, side, other, skew.hot_keys(pairs, side, total))
    return out


def _passing(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs that share a prefix token under orders B and C too."""
    asked = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    own = marked.where("n > 0").select("cid", "pb", "pc").join(asked, "cid", "left_semi").groupBy("cid").agg(F.first("pb").alias("pb"), F.first("pc").alias("pc"))
    both = _both_sides(pairs, own, ["pb", "pc"])
    return both.where(F.arrays_overlap("pb1", "pb2") & F.arrays_overlap("pc1", "pc2")).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar."""
    return _both_sides(pairs, sets, ["full"]).select("a", "b", "full1", "full2").mapInArrow(_verified(num, den), "a long, b long")


def jaccard_join(
    docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", seed: int = 0
) -> DataFrame:
    """One row a row of ``docs``: id, text_hash, n_shingles, component_id, class_id (rows with equal sets) and component, for similarity num/den or more."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(rows, size, seed).tobytes())
    release(spark)
    marked = written(rows.mapInArrow(_prefixes(size, seed, num, den, sketch), _PREFIXES), "join-prefixes")
    held = marked.where("n > 0")
    classes = written(held.groupBy("cid").agg(F.min("id").alias("least"), F.min("mark").alias("m1"), F.max("mark").alias("m2")), "join-classes")
    if not classes.where("m1 <> m2").isEmpty():  # two sets with one 64-bit class id
        return jaccard_join(docs, size, num, den, id_col, text_col, seed + 1)

    one_each = held.groupBy("cid").agg(F.first("n").alias("n"), F.first("pa").alias("prefix"))
    postings = one_each.select("cid", F.posexplode("prefix").alias("pos", "token"), "n")
    postings = postings.select("token", "cid", (F.col("pos").cast("long") * (1 << 32) + F.col("n")).alias("key"))
    pivots = written(postings.groupBy("token").agg(F.min_by("cid", "key").alias("pivot"), F.min("key").alias("pkey"), F.count(F.lit(1)).alias("n")).where("n > 1"), "join-pivots")
    total = pivots.agg(F.sum("n")).first()[0] or 0
    often = pivots.where(F.col("n") >= max(skew.LEAST_HOT, -(-total // skew.MOST_HOT))).select("token", "n")
    shared = written(skew.join_salted(postings, pivots.drop("n"), "token", "cid", often), "join-shared")
    del one_each, postings
    release(spark)

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of all classes in ``pairs``, made again from the text of one row each."""
        ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cid")
        reps = ids.join(classes, "cid").select(F.col("least").alias("rep")).distinct()
        texts = rows.select("id", "text").join(reps, F.col("id").eqNullSafe(F.col("rep")), "left_semi")
        made = written(texts.mapInArrow(_sets(size, seed), "cid long, full binary"), "join-sets")
        release(spark)
        twice = made.groupBy("cid").count().where("count > 1")
        return made if twice.isEmpty() else made.dropDuplicates(["cid"])  # ids that repeat with other texts

    def linked(pairs: DataFrame) -> DataFrame:
        left = written(_passing(pairs, marked), "join-passing")
        release(spark)
        links = written(_links(left, sets_of(left), num, den), "join-links")
        release(spark)
        return links

    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    stars = shared.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b"), low("key").alias("n1"), F.shiftright("key", 32).alias("i1"), low("pkey").alias("n2"), F.shiftright("pkey", 32).alias("i2"))
    tried = written(_filtered(stars, num, den).select("a", "b").distinct(), "join-tried")
    links = linked(tried)
    labels = components(links)

    # in each bucket, sets of similar length (in one band or neighbouring ones, a little wider than den / num) that are still in different components
    named = shared.select("token", "cid", "key").join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("l", F.coalesce("l", "cid"))
    named = written(named, "join-named")
    several = named.groupBy("token").agg(F.min("l").alias("l1"), F.max("l").alias("l2")).where("l1 < l2").select("token")
    open_ = named.join(several, "token").withColumn("band", F.floor(F.log(low("key")) / F.lit(1.000001 * math.log(den / num))).cast("int") if num < den else low("key"))
    x = open_.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("cid").alias("a"), F.col("l").alias("la"), low("key").alias("n1"), F.shiftright("key", 32).alias("i1"))
    y = open_.select("token", "band", F.col("cid").alias("b"), F.col("l").alias("lb"), low("key").alias("n2"), F.shiftright("key", 32).alias("i2"))
    rest = _filtered(x.join(y, ["token", "band"]).where("la < lb"), num, den).select("a", "b").distinct()
    known = tried.select("a", "b").union(tried.select(F.col("b"), F.col("a")))
    rest = written(rest.join(known, ["a", "b"], "left_anti"), "join-rest")
    if not rest.isEmpty():
        more = linked(rest)
        if not more.isEmpty():
            labels = components(links.union(more))
    release(spark)

    of = classes.join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("cid", "least", F.coalesce("l", "cid").alias("l"))
    tops = of.groupBy("l").agg(F.min("least").alias("component_id"))
    of = of.join(tops, "l").select("cid", "l", "component_id")
    nothing = F.lit(None).cast("long")
    alone = marked.where("n = 0").select("id", "text_hash", "n", F.col("id").alias("component_id"), nothing.alias("cid"), nothing.alias("l"))
    found = held.select("id", "text_hash", "n", "cid").join(of, "cid").select(*alone.columns).unionByName(alone)
    return found.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("cid").alias("class_id"), F.col("l").alias("component"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, one each, and all rows without a set."""
    own = Plain(docs)
    id_, text = own.name(id_col), own.name(text_col)
    found = jaccard_join(own.df, size, num, den, id_, text).select(F.col(id_).alias("k_id"), F.col("text_hash").alias("k_text"), F.col("component").alias("k"))
    found = written(found, "join-found")
    last = F.coalesce("k_id", F.lit(2**63 - 1))
    best = found.where("k IS NOT NULL").groupBy("k").agg(F.min(F.struct(last.alias("at"), "k_text", "k_id")).alias("one")).select("one.k_id", "one.k_text")
    best = best.union(found.where("k IS NULL").select("k_id", "k_text"))
    marked = own.df.withColumn("own_text", F.xxhash64(text))
    stay = marked.join(best, F.col(id_).cast("long").eqNullSafe(F.col("k_id")) & (F.col("own_text") == F.col("k_text")), "left_semi").select(*own.df.columns)
    if not found.where("k IS NOT NULL").groupBy("k_id", "k_text").count().where("count > 1").isEmpty():  # equal rows
        held = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        stay = stay.where(held).dropDuplicates([id_, text]).unionByName(stay.where(~held))
    return stay.select(*own.back())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, num=85)
    return found.select("doc_id", "n_shingles", "component_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
"""
