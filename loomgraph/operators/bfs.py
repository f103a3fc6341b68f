"""Level-synchronous breadth-first search from any number of roots at once.

A level joins the frontier with the arcs, keeps the least parent of each (run, vertex) and drops what was reached
before. Arcs are a table bucketed by source, so each level moves only the frontier and its discoveries. Arcs of a hub
are dealt over several tasks, and its place in the frontier with them.

One run works on rows (v, parent), whose least parent the map side already merges. More runs share words of 64 bits: a
row (word, v, parent, bits) stands for all runs of the word that reach v from that parent at that level, so a level
moves a row an arc, not a row an arc and run. A vertex's rows, what was reached before first and then by parent, pass a
running OR: what a row adds to it are the runs whose least parent it names. Rows for a hub are thinned the same way in
several tasks before, to 64 a task.

On symmetric arcs a neighbour of level d lies in level d - 1, d or d + 1, so a level's discoveries are compared with
two levels, never with all that was reached. Whether arcs are symmetric is told by sums of hashes over both
directions; directed graphs compare with all levels.

Each level's discoveries are a table in the shared folder, which cuts the lineage and survives lost executors; the
driver only sees their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgraph.operators.skew import hot_keys
from loomgraph.session import MANY, erase, release, scratch

_COMPACT = 16


def is_symmetric(arcs: DataFrame) -> bool:
    """Whether arcs and their reverses are the same multiset, by sums of 64-bit hashes."""
    one, two = arcs.agg(*(F.sum(F.xxhash64(a, b).cast("decimal(20,0)")) for a, b in (("src", "dst"), ("dst", "src")))).first()
    return one == two


def bfs(arcs: DataFrame, roots: DataFrame, partitions: int | None = None, max_levels: int | None = None, symmetric: bool | None = None, compact: bool = False) -> DataFrame:
    """run, v, d and parent of every reached vertex; a root is its own parent.

    The parent is the smallest neighbour one level nearer, so the result doesn't depend on how data are partitioned.
    symmetric: None to find out. compact: runs stay together, as words of ``numbered``: ``run`` is then the word and
    ``bits`` tells its runs, each of them in one row of a vertex; ``expanded`` gives the rows of the runs.
    """
    if not compact and roots.select("run").distinct().limit(2).count() > 1:
        return expanded(bfs(arcs, roots, partitions, max_levels, symmetric, True), numbered(roots)).select("run", "v", "d", "parent")
    first = roots.select(F.col("run").cast("int").alias("run"), F.col("source").alias("v"))

    def of_one(held: _Arcs, frontier: DataFrame, seen: DataFrame, level: int) -> DataFrame:
        found = held.neighbours(frontier.select("run", "v")).groupBy("run", F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
        return found.join(seen.select("run", "v"), ["run", "v"], "left_anti").select("run", "v", F.lit(level).alias("d"), "parent")

    def of_words(held: _Arcs, frontier: DataFrame, seen: DataFrame, level: int) -> DataFrame:
        near = frontier.repartition(held.parts, "v").groupBy("v", "run").agg(F.bit_or("bits").alias("bits"))
        found = held.neighbours(near).select("run", F.col("dst").alias("v"), F.col("src").alias("parent"), "bits")
        if held.hubs is not None:
            dealt = found.join(F.broadcast(held.hubs.withColumnRenamed("src", "v")), "v", "left").withColumn("salt", F.pmod(F.xxhash64("parent"), F.coalesce("parts", F.lit(1))).cast("int"))
            found = _least(dealt, "run", "v", "salt").select("run", "v", "parent", "bits")
        before = seen.select("run", "v", F.lit(None).cast("long").alias("parent"), "bits")
        return _least(found.unionAll(before), "run", "v").where("parent IS NOT NULL").select("run", "v", F.lit(level).alias("d"), "parent", "bits")

    if compact:
        words = first.join(F.broadcast(numbered(roots)), "run").groupBy(F.col("word").alias("run"), "v").agg(F.bit_or("bit").alias("bits"))
        return _searched(arcs, words.select("run", "v", F.lit(0).alias("d"), F.col("v").alias("parent"), "bits"), of_words, partitions, max_levels, symmetric)
    return _searched(arcs, first.select("run", "v", F.lit(0).alias("d"), F.col("v").alias("parent")).distinct(), of_one, partitions, max_levels, symmetric)


def numbered(roots: DataFrame) -> DataFrame:
    """run, word and bit of each run, a row a run: 64 runs in the order of their numbers are a word, which bears the first one's number."""
    runs = sorted(r[0] for r in roots.select(F.col("run").cast("int")).distinct().collect())
    bit = [1 << i for i in range(63)] + [-(1 << 63)]
    return roots.sparkSession.createDataFrame([(run, runs[i - i % 64], bit[i % 64]) for i, run in enumerate(runs)], "run int, word int, bit long")


def expanded(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows with a word as ``run`` and ``bits`` as one row a run; runs: of ``numbered``."""
    return rows.withColumnRenamed("run", "word").join(F.broadcast(runs), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bits", "bit")


def _least(rows: DataFrame, *by: str) -> DataFrame:
    """Of each row the bits that no row of a smaller parent has (null is the smallest); rows without any left go."""
    earlier = Window.partitionBy(*by).orderBy(F.asc_nulls_first("parent")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(earlier), F.lit(0).cast("long"))))
    return rows.withColumn("bits", left).where("bits != 0")


class _Arcs:
    """Arcs as a table in ``parts`` buckets by source, with a hub's arcs dealt over several of them."""

    def __init__(self, arcs: DataFrame, parts: int) -> None:
        self.spark, self.parts, self.path, self.name = arcs.sparkSession, parts, scratch(arcs.sparkSession, "arcs"), f"arcs_{uuid.uuid4().hex}"
        hubs = hot_keys(arcs, "src").select("src", F.ceil(F.col("n") / F.lit(1000)).cast("int").alias("parts")).collect()  # a bounded number
        self.hubs = self.spark.createDataFrame(hubs, "src long, parts int") if hubs else None
        plain, self.by = arcs.select("src", "dst"), ["src"]
        if hubs:
            dealt = plain.join(F.broadcast(self.hubs), "src", "left").withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int"))
            plain, self.by = dealt.select("src", "salt", "dst"), ["src", "salt"]
        plain.repartition(parts, *self.by).write.bucketBy(parts, *self.by).sortBy("src").option("path", self.path).saveAsTable(self.name, format="parquet")
        self.table = self.spark.table(self.name)

    def neighbours(self, frontier: DataFrame) -> DataFrame:
        """The frontier's columns with src and dst of its vertices' arcs, v as src."""
        more = [c for c in frontier.columns if c != "v"]
        if self.hubs is None:
            return self.table.join(frontier.withColumnRenamed("v", "src").hint("shuffle_hash"), "src")
        dealt = frontier.join(F.broadcast(self.hubs.withColumnRenamed("src", "v")), "v", "left")
        dealt = dealt.select(*more, F.col("v").alias("src"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        return self.table.join(dealt, ["src", "salt"])

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        erase(self.spark, self.path)


def _searched(arcs: DataFrame, first: DataFrame, step: Callable[[_Arcs, DataFrame, DataFrame, int], DataFrame], partitions: int | None, max_levels: int | None, symmetric: bool | None) -> DataFrame:
    """All levels that ``step`` gives from the one before and what it may meet again, until one is empty."""
    spark = arcs.sparkSession
    held = _Arcs(arcs, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if symmetric is None:
        symmetric = is_symmetric(held.table)
    top = scratch(spark, "bfs")
    reached = [f"{top}/level-0"]
    first.write.parquet(reached[0])
    schema = spark.read.parquet(reached[0]).schema
    frontier, level, last = reached[0], 0, [reached[0]]
    read = lambda *paths: spark.read.schema(schema).parquet(*paths)
    if held.table.count() >= MANY:
        release(spark)
    while max_levels is None or level < max_levels:
        level += 1
        count, path = Observation(), f"{top}/level-{level}"
        step(held, read(frontier), read(*(last if symmetric else reached)), level).observe(count, F.count(F.lit(1)).alias("n")).write.parquet(path)
        n = count.get["n"]
        if n >= MANY:
            release(spark)
        if not n:
            break
        frontier = path
        reached.append(path)
        last = [*last, path][-2:]
        if len(reached) >= _COMPACT and not symmetric:
            whole = f"{top}/upto-{level}"
            read(*reached).write.parquet(whole)
            reached = [whole]
    held.drop()
    return read(*reached)


def bfs_from(arcs: DataFrame, source: int, **options: int | None) -> DataFrame:
    """v, d and parent of what ``source`` reaches."""
    roots = arcs.sparkSession.createDataFrame([(0, source)], "run int, source long")
    return bfs(arcs, roots, **options).drop("run")


def expand_one_hop(frontier: DataFrame, arcs: DataFrame) -> DataFrame:
    """v and its least parent, for all targets of the frontier's arcs outside the frontier."""
    found = arcs.join(frontier, arcs["src"] == frontier["v"]).groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
    return found.join(frontier, "v", "left_anti")


def level_profile(tree: DataFrame, degrees: DataFrame) -> DataFrame:
    """Frontier size and scanned arcs of each level."""
    sized = tree.join(degrees, "v", "left")
    return sized.groupBy("d").agg(F.count(F.lit(1)).alias("frontier_size"), F.sum(F.coalesce("degree", F.lit(0))).alias("scanned_arcs"))


def bitset_words(ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A set of ids, or one for each ``by``, as 64-bit words: word w holds the ids 64 * w to 64 * w + 63."""
    word = F.expr("v div 64")
    bit = F.expr("shiftleft(1L, int(v % 64))")
    return ids.select(*(by or []), word.alias("word"), bit.alias("bit")).groupBy(*(by or []), "word").agg(F.bit_or("bit").alias("bits"))
