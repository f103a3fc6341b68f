"""Checks of breadth-first trees (v, d, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import bfs
from loomgraph.session import MANY, release


def bad_roots(tree: DataFrame, source: int) -> DataFrame:
    """The source without itself as a parent or with a distance, and a source that is missing (v null)."""
    own = tree.where(F.col("v") == source)
    wrong = own.where((F.col("parent") != source) | (F.col("d") != 0)).select("v", "d", "parent")
    missing = own.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("long").alias("v"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("long").alias("parent"))
    return wrong.union(missing)


def bad_parents(tree: DataFrame, source: int, vertices: DataFrame) -> DataFrame:
    """Others whose parent is missing, unknown or the vertex itself."""
    own = tree.where(F.col("v") != source)
    unknown = own.join(vertices.select(F.col("v").alias("parent")), "parent", "left_anti").select("v", "d", "parent")
    return own.where(F.col("parent") == F.col("v")).select("v", "d", "parent").union(unknown)


def bad_edges(tree: DataFrame, arcs: DataFrame, source: int) -> DataFrame:
    """Tree edges that aren't arcs."""
    own = tree.where((F.col("v") != source) & (F.col("v") != F.col("parent"))).select("v", "d", "parent")
    return own.join(arcs.select(F.col("src").alias("v"), F.col("dst").alias("parent")), ["v", "parent"], "left_anti").select("v", "d", "parent")


def bad_levels(tree: DataFrame, source: int) -> DataFrame:
    """Vertices that aren't one level below their parent, wherever the parent is kept."""
    up = tree.select(F.col("v").alias("parent"), F.col("d").alias("parent_d"))
    own = tree.where((F.col("v") != source) & (F.col("v") != F.col("parent"))).select("v", "d", "parent").join(up, "parent")
    return own.where(F.col("d") != F.col("parent_d") + 1).select("v", "d", "parent", "parent_d")


def uneven_arcs(tree: DataFrame, arcs: DataFrame) -> DataFrame:
    """Arcs of a symmetric graph whose ends differ by more than a level, or of which only one end is reached."""
    one = tree.select(F.col("v").alias("src"), F.col("d").alias("d_src"))
    two = tree.select(F.col("v").alias("dst"), F.col("d").alias("d_dst"))
    both = arcs.join(one, "src", "left").join(two, "dst", "left")
    return both.where(F.col("d_src").isNull() != F.col("d_dst").isNull()).union(both.where(F.abs(F.col("d_src") - F.col("d_dst")) > 1)).select("src", "dst", "d_src", "d_dst")


def summary(tree: DataFrame, arcs: DataFrame, source: int, vertices: DataFrame) -> DataFrame:
    """Rows that fail each check. A vertex with a bad parent counts once, as its edge isn't looked up."""
    parts = {
        "root": bad_roots(tree, source), "parent": bad_parents(tree, source, vertices), "edge": bad_edges(tree.join(vertices.select(F.col("v").alias("parent")), "parent", "left_semi"), arcs, source),
        "level": bad_levels(tree, source), "arc": uneven_arcs(tree, arcs),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("errors")).select(F.lit(name).alias("check_name"), "errors")
        out = one if out is None else out.union(one)
    return out


def errors_by_run(trees: DataFrame, arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """run and errors of trees (run, v, d, parent) of many runs: rows that fail a check, 0 for a run without.

    Trees may be compact, with ``bits``. The checks go over words of runs, one after the other, and bring a row a run
    to the driver; a vertex that a run has twice fails one of them.
    """
    spark, runs = trees.sparkSession, bfs.numbered(roots)
    if "bits" not in trees.columns:
        trees = trees.join(F.broadcast(runs), "run").select(F.col("word").alias("run"), "v", "d", "parent", F.col("bit").alias("bits"))
    few = F.broadcast(roots.join(runs, "run").groupBy(F.col("word").alias("run"), F.col("source").alias("v")).agg(F.bit_or("bit").alias("own")))  # at most a row a root
    none, bits = F.lit(0).cast("long"), F.col("bits")
    without = lambda other: bits.bitwiseAND(F.bitwise_not(F.coalesce(other, none)))
    placed = trees.join(few, ["run", "v"], "left").withColumn("own", F.coalesce("own", none))
    others = placed.withColumn("bits", without(F.col("own"))).where("bits != 0").select("run", "v", "d", "parent", "bits")
    up = trees.groupBy("run", F.col("v").alias("parent"), (F.col("d") + 1).alias("d")).agg(F.bit_or("bits").alias("up"))
    each = trees.groupBy("run", "v").agg(F.bit_or("bits").alias("any"), F.bit_xor("bits").alias("odd"), F.sum(F.bit_count("bits")).alias("n"))
    even = F.col("any").bitwiseAND(F.bitwise_not(F.col("odd")))
    found_roots = placed.where("own != 0").select("run", "v", bits.bitwiseAND(F.col("own")).alias("got")).groupBy("run", "v").agg(F.bit_or("got").alias("got"))
    wrong = [
        placed.where((F.col("parent") != F.col("v")) | (F.col("d") != 0) | F.col("parent").isNull()).select("run", bits.bitwiseAND(F.col("own")).alias("bits")),
        few.withColumnRenamed("own", "bits").join(found_roots, ["run", "v"], "left").select("run", without(F.col("got")).alias("bits")),
        others.join(up, ["run", "parent", "d"], "left").select("run", without(F.col("up")).alias("bits")),
        others.join(arcs.select(F.col("src").alias("parent"), F.col("dst").alias("v")), ["parent", "v"], "left_anti").select("run", "bits"),
        each.where(F.col("n") != F.bit_count("any")).select("run", F.when(even != 0, even).otherwise(F.col("any")).alias("bits")),
    ]
    errors: dict[int, int] = {}
    large = trees.count() >= MANY
    for part in wrong:
        for run, n in bfs.expanded(part.where("bits != 0"), runs).groupBy("run").count().collect():  # a row a run
            errors[run] = errors.get(run, 0) + n
        if large:
            release(spark)
    found = spark.createDataFrame(list(errors.items()), "run int, n long")
    return roots.select("run").join(found, "run", "left").select("run", F.coalesce("n", F.lit(0)).cast("long").alias("errors"))
