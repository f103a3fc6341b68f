"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt by a seeded hash into blocks. Its target is met by copies of whole blocks and a part of
one: every block floor(target / size) times, and the blocks of a permuted order once more until the words run out.
That gives each source an exact quota of block copies. The tree divides the quotas of all sources between the output
shards: at each node, the left half's share of every source is one draw from the multivariate hypergeometric
distribution, so that any shard is a sample of the whole mix without replacement. Each leaf draws disjoint runs of
every source's permuted block copies; a document is taken once for each draw of its block, and documents are shuffled
within their shard by a hash.

The block in which a target falls is split by further hashes until ``LAST_ROWS`` documents or fewer are left in
question; of these the subset is taken whose words come nearest to what is missing.

Driver and broadcasts hold a row a source and ``BLOCKS`` block rows besides, whatever the number of documents; beyond
``BROADCAST`` rows they are joined by a shuffle instead.

Defined results: sources in code-point order with the null source last; a null text or one without words has size 0
and isn't taken; equal rows are taken one by one; texts of any length count whole; an empty table gives an empty
result; columns may have any names; reruns agree, however the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.columns import Plain
from loomgraph.session import ship, written

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST_TIMES = 2
#: Words of a shard, about, and the least number of shards.
SHARD_WORDS = 1 << 26
SHARDS = 64
SEED = 17
#: Blocks of all sources together, besides one a source, and the documents of a block where there are fewer.
BLOCKS = 65_536
DOCS_A_BLOCK = 64
LAST_ROWS = 256
BROADCAST = 250_000
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST_TIMES) -> list[Fraction]:
    """Words to take from each source: in proportion to the weights, ``most`` times its size at the most."""
    found: list[Fraction | None] = [None] * len(sizes)
    left = share * sum(sizes)
    while True:
        free = [i for i, x in enumerate(found) if x is None]
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > most * sizes[i] * total]
        if not over:
            for i in free:
                found[i] = left * weights[i] / total
            return [Fraction(x) for x in found]
        for i in over:
            found[i] = Fraction(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Block copies of each source (columns) for each shard (rows)."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def divide(own: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid, total = (lo + hi) // 2, int(own.sum())
        take = round(total * (mid - lo) / (hi - lo))
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, take, method="marginals") if total else own
        divide(left, lo, mid)
        divide(own - left, mid, hi)

    divide(np.array(quotas, np.int64), 0, shards)
    return out


def nearest_subset(sizes: list[int], counts: list[int], goal: int, most: int = 1 << 18) -> list[int]:
    """How many of ``counts[i]`` things of ``sizes[i]`` to take for a sum nearest to goal, ties to the smaller sum.

    Where more than ``most`` is missing, things in their order go first until no more is left; what remains is exact.
    """
    taken, left, at = [0] * len(sizes), goal, 0
    while left > most and at < len(sizes):
        if sizes[at]:
            taken[at] = min(counts[at], left // sizes[at])
            left -= taken[at] * sizes[at]
        at += 1
    reach, steps = 1, []  # bit s: a sum of s is reached
    for i in range(at, len(sizes)):
        n, chunk = min(counts[i], 2 * left // sizes[i]) if sizes[i] else 0, 1
        while n:
            k = min(n, chunk)
            steps.append((i, k, reach))
            reach |= (reach << k * sizes[i]) & (1 << 2 * left + 1) - 1
            n, chunk = n - k, 2 * chunk
    best = next((s for off in range(left + 1) for s in (left - off, left + off) if reach >> s & 1), 0)
    for i, k, before in reversed(steps):
        if not before >> best & 1:
            taken[i] += k
            best -= k * sizes[i]
    return taken


def _by(df: DataFrame, small: DataFrame, n: int, on: Column | list[str]) -> DataFrame:
    """``df`` with the columns of ``small``, a table of n rows, which is broadcast up to BROADCAST rows."""
    return df.join(F.broadcast(small) if n <= BROADCAST else small, on)


def _table(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    kinds = {"int": "int32", "long": "int64", "double": "float64", "boolean": "bool"}
    frame = pd.DataFrame({name: pd.Series(values, dtype=kinds.get(kind, object)) for name, (kind, values) in columns.items()})
    return spark.createDataFrame(frame, ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items()))


class Draws:
    """What the tree decides: the blocks of every source and the shards that draw them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: Fraction, most: int, shards: int | None, seed: int) -> None:
        self.spark, self.seed, self.names = docs.sparkSession, seed, (id_col, text_col, source_col)
        ship(self.spark)
        rows = written(self.keyed(docs, True).select("k_id", "k_text", "k_source", "k_size", "k_h"), "mix-sizes")
        self.rows = rows
        found = rows.groupBy("k_source").agg(F.sum("k_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        found.sort(key=lambda r: (r["k_source"] is None, r["k_source"] or ""))
        sizes, count = [r["size"] for r in found], sum(r["n"] for r in found)
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most) if found else []
        base = [int(g // s) if s else 0 for g, s in zip(goal, sizes, strict=True)]
        extra = [int(round(g - b * s)) for g, b, s in zip(goal, base, sizes, strict=True)]
        shards = shards or min(BLOCKS // 8, max(SHARDS, int(share * sum(sizes)) // SHARD_WORDS))
        blocks = [max(1, min(r["n"] // DOCS_A_BLOCK, BLOCKS * r["n"] // count)) for r in found]
        self.n = len(found)
        self.sources = _table(self.spark, {
            "of": ("int", list(range(self.n))), "s": ("string", [r["k_source"] for r in found]), "source_size": ("long", sizes),
            "target": ("double", [float(g) for g in goal]), "base": ("int", base), "blocks": ("int", blocks),
        })

        # a permuted order of each source's blocks; the extra words end within one of them
        placed = self._placed(rows)
        words = {(r["of"], r["block"]): r["w"] for r in placed.groupBy("of", "block").agg(F.sum("k_size").alias("w")).collect()}
        whole: set[tuple[int, int]] = set()
        part: dict[tuple[int, int], int] = {}  # block: words of it to take
        for s in range(self.n):
            self._walk([(s, b) for b in np.random.default_rng([seed, s, 1]).permutation(blocks[s]).tolist()], words, extra[s], whole, part)

        # the tree: quotas of block copies, and each leaf's run of the permuted copies
        copies = [[(b, c) for b in range(blocks[s]) for c in range(base[s] + ((s, b) in whole or (s, b) in part))] for s in range(self.n)]
        self.quota = split_quotas([len(c) for c in copies], shards, seed) if found else np.zeros((shards, 0), np.int64)
        places: dict[tuple[int, int], list[int]] = {(s, b): [] for s in range(self.n) for b in range(blocks[s])}
        for s, own in enumerate(copies):
            order, leaf = np.random.default_rng([seed, s]).permutation(len(own)).tolist(), np.repeat(np.arange(shards), self.quota[:, s]).tolist()
            for shard, i in sorted(zip(leaf, order, strict=True), key=lambda x: x[1]):  # by copy
                places[s, own[i][0]].append(shard)
        keys = list(places)
        self.n_marks = len(keys)
        self.marks = _table(self.spark, {
            "of": ("int", [s for s, _ in keys]), "block": ("int", [b for _, b in keys]), "open": ("boolean", [k in part for k in keys]), "places": ("array<int>", list(places.values())),
        })
        self.taken = self._partial(placed, part)

    @staticmethod
    def _walk(keys: list, words: dict, left: int, whole: set, part: dict) -> None:
        """Keys in order until the words run out: those that are taken whole, and the one in which the words end."""
        for key in keys:
            own = words.get(key, 0)
            if left <= 0:
                return
            if own <= left:
                whole.add(key)
            else:
                part[key] = left
            left -= own

    def keyed(self, df: DataFrame, sized: bool = False) -> DataFrame:
        """Rows with k_id, k_text, k_source, k_h and, on demand, k_size; k_any tells whether there are words."""
        id_, text, source = (F.col(c) for c in self.names)
        out = df.withColumns({"k_id": id_, "k_text": F.xxhash64(text), "k_source": source.cast("string")}).withColumn("k_h", F.xxhash64(F.lit(self.seed), "k_id", "k_text"))
        return out.withColumn("k_size", F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")) if sized else out.withColumn("k_size", F.coalesce(text.rlike(_WORD), F.lit(False)).cast("long"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        found = _by(rows, self.sources, self.n, F.col("k_source").eqNullSafe(F.col("s"))).drop("s")
        return found.withColumn("block", F.pmod("k_h", "blocks").cast("int"))

    def _partial(self, placed: DataFrame, part: dict[tuple[int, int], int]) -> DataFrame:
        """of, k_h and the number of rows to take once more, in the blocks that are taken in part."""
        asked = _table(self.spark, {"of": ("int", [s for s, _ in part]), "block": ("int", [b for _, b in part]), "left": ("long", list(part.values()))})
        rows = written(_by(placed, asked, len(part), ["of", "block"]).where("k_size > 0").select("of", "k_h", "k_id", "k_text", "k_size", "left"), "mix-part")
        kept, level = None, 0
        while True:
            sizes = rows.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k_h").alias("d"), F.first("left").alias("left"))
            large = {r["of"]: r for r in sizes.where(f"n > {LAST_ROWS} AND d > 1").collect()}
            if not large:
                break
            level += 1
            finer = {of: max(2, min(BLOCKS, r["n"] // DOCS_A_BLOCK)) for of, r in large.items()}
            few = _table(self.spark, {"of": ("int", list(finer)), "m": ("int", list(finer.values()))})
            split = _by(rows, few, len(finer), ["of"]).withColumn("sub", F.pmod(F.xxhash64(F.lit(level), "k_h"), F.col("m")).cast("int"))
            words: dict = {}
            for r in split.groupBy("of", "sub").agg(F.sum("k_size").alias("w")).orderBy("of", "sub").collect():
                words[r["of"], r["sub"]] = r["w"]
            whole: set = set()
            open_: dict = {}
            own: dict = {}
            for of, sub in sorted(words):
                own.setdefault(of, []).append((of, sub))
            for of, r in large.items():
                self._walk(own[of], words, r["left"], whole, open_)
            cuts = [(*k, True, 0) for k in whole] + [(*k, False, x) for k, x in open_.items()]
            cuts = _table(self.spark, dict(zip(("of", "sub", "all", "rest"), zip(("int", "int", "boolean", "long"), map(list, zip(*cuts, strict=True)), strict=True), strict=True)))
            settled = _by(split, cuts, self.n_marks, ["of", "sub"])
            more = settled.where("all").groupBy("of", "k_h").agg(F.count(F.lit(1)).alias("n"))
            kept = more if kept is None else kept.unionByName(more)
            smaller = settled.where("NOT all").select("of", "k_h", "k_id", "k_text", "k_size", F.col("rest").alias("left"))
            rest = rows.join(F.broadcast(few) if len(finer) <= BROADCAST else few, "of", "left_anti")
            rows = written(smaller.unionByName(rest), "mix-part")
        last = rows.groupBy("of", "k_h", "k_size").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left")).groupBy("of").applyInArrow(_nearest, "of int, k_h long, n long")
        return written(last if kept is None else last.unionByName(kept), "mix-taken")

    def drawn(self, df: DataFrame) -> DataFrame:
        """Keyed rows with ``of``, the columns of their source, and ``shards``: one for each draw of the row."""
        found = _by(self._placed(df), self.marks, self.n_marks, ["of", "block"])
        none = F.array().cast("array<int>")
        settled = found.where("NOT open").withColumn("shards", F.when(F.col("k_size") > 0, F.col("places")).otherwise(none))
        again = found.where("open").join(self.taken.withColumnRenamed("n", "again"), ["of", "k_h"], "left")
        nth = F.row_number().over(Window.partitionBy("of", "k_h").orderBy("k_id", "k_text"))
        more = (F.coalesce("again", F.lit(0)) >= nth).cast("int")
        again = again.withColumn("more", more).withColumn("shards", F.when(F.col("k_size") > 0, F.slice("places", F.lit(1), F.col("base") + F.col("more"))).otherwise(none))
        return settled.unionByName(again.select(*settled.columns))


def _nearest(table: pa.Table) -> pa.Table:
    """Of the last rows in question of one source, those whose words come nearest to what is missing."""
    order = np.argsort(table["k_h"].to_numpy(), kind="stable")
    h, size, n = (table[c].to_numpy()[order] for c in ("k_h", "k_size", "n"))
    take = nearest_subset(size.tolist(), n.tolist(), table["left"][0].as_py())
    return pa.table({"of": pa.array([table["of"][0].as_py()] * len(h), pa.int32()), "k_h": h, "n": np.array(take, np.int64)})


def _options(weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_TIMES, shards: int | None = None, seed: int = SEED) -> Iterator[object]:
    yield from (weights, share, most, shards, seed)


def _place(copy: Column, seed: int) -> Column:
    """By this a shard is sorted."""
    return F.xxhash64(F.lit(seed + 1), "k_h", copy)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """One row a row of ``docs``: id, text_hash, mix_source, size, source_size, target, and what the leaves of the tree drew: shards, their orders, copies and taken words."""
    draws = Draws(docs, id_col, text_col, source_col, *_options(**options))
    found = draws.drawn(draws.rows)
    return found.select(
        F.col("k_id").alias(id_col), F.col("k_text").alias("text_hash"), F.col("k_source").alias("mix_source"), F.col("k_size").alias("size"), "source_size", "target",
        "shards", F.transform("shards", lambda _, i: _place(i, draws.seed)).alias("orders"), F.size("shards").alias("copies"),
        F.aggregate("shards", F.lit(0).cast("long"), lambda sum_, _: sum_ + F.col("k_size")).alias("taken"),
    )


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, options: dict) -> tuple[Plain, DataFrame, int]:
    own = Plain(docs)
    draws = Draws(own.df, *(own.name(c) for c in (id_col, text_col, source_col)), *_options(**options))
    found = draws.drawn(draws.keyed(own.df)).select(*own.df.columns, "k_h", F.posexplode("shards").alias("copy", "shard"))
    return own, found.withColumn("order", _place(F.col("copy"), draws.seed)).drop("k_h", "copy"), len(draws.quota)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself: the columns of ``docs``, with ``mix_shard`` and ``mix_order`` (the place by which a shard is sorted)."""
    own, found, _ = _mixed(docs, id_col, text_col, source_col, options)
    return found.select(*own.back(), F.col("shard").alias("mix_shard"), F.col("order").alias("mix_order"))


def shuffled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix with the columns of ``docs``: a partition a shard, shuffled within."""
    own, found, n = _mixed(docs, id_col, text_col, source_col, options)
    return found.repartitionById(n, "shard").sortWithinPartitions("shard", "order").select(*own.back())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "shards", "orders")
