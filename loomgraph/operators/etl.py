"""Edge lists to symmetrised, densely numbered, sorted adjacency. Graphs are multigraphs: nothing is deduplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scan import prefix


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; a self-loop gives two equal arcs. One pass over the edges."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(both).alias("arc")).select("arc.src", "arc.dst")


def directed_arcs(edges: DataFrame, directed: int) -> DataFrame:
    """Arcs of an edge list: as they are where its file holds both directions (1), else both ways (0)."""
    return edges.select("src", "dst") if directed else symmetrize(edges)


def vertices(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def edge_stats(arcs: DataFrame) -> DataFrame:
    """Arcs, largest id, distinct endpoints and the bytes of a compressed-row form."""
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("v"))
    sizes = arcs.agg(F.count(F.lit(1)).alias("n_arcs"), F.max(F.greatest("src", "dst")).alias("max_id"))
    count = ends.agg(F.countDistinct("v").alias("n_vertices"))
    return sizes.crossJoin(count).select("n_arcs", "max_id", "n_vertices", ((F.col("n_vertices") + 1) * 8).alias("row_ptr_bytes"), (F.col("n_arcs") * 4).alias("col_idx_bytes"))  # one row each


def out_degree(arcs: DataFrame) -> DataFrame:
    """v and its arcs out, 0 for ids that only occur as a target. One aggregation, no join."""
    ends = F.array(F.struct(F.col("src").alias("v"), F.lit(1).cast("long").alias("k")), F.struct(F.col("dst").alias("v"), F.lit(0).cast("long").alias("k")))
    return arcs.select(F.explode(ends).alias("e")).groupBy(F.col("e.v").alias("v")).agg(F.sum("e.k").alias("degree"))


def degree_stats(arcs: DataFrame) -> DataFrame:
    d = out_degree(arcs)
    return d.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"))


def sorted_edges(arcs: DataFrame) -> DataFrame:
    """Arcs with their place in the order (src, dst)."""
    return prefix(arcs.select("src", "dst"), ["src", "dst"])


def remap_table(edges: DataFrame) -> DataFrame:
    """v and id: ids count up in the order in which edges (by ``pos``) first mention a vertex, source before target."""
    ends = F.array(F.struct(F.col("src").alias("v"), (2 * F.col("pos")).alias("at")), F.struct(F.col("dst").alias("v"), (2 * F.col("pos") + 1).alias("at")))
    first = edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.v").alias("v")).agg(F.min("e.at").alias("first"))
    return prefix(first, ["first"]).select("v", F.col("position").alias("id"))


def remap_sorted(edges: DataFrame) -> DataFrame:
    """``remap_table`` of edges taken in the order of src and dst, without numbering the edges.

    A vertex is first mentioned as a source next to its least target, or as a target next to its least source.
    """
    one, two = F.struct(F.col("src").alias("v"), F.col("dst").alias("a"), F.lit(None).cast("long").alias("b")), F.struct(F.col("dst").alias("v"), F.lit(None).cast("long").alias("a"), F.col("src").alias("b"))
    least = edges.select(F.explode(F.array(one, two)).alias("e")).groupBy(F.col("e.v").alias("v")).agg(F.min("e.a").alias("a"), F.min("e.b").alias("b"))
    late = F.coalesce(F.col("b") < F.col("v"), F.lit(False)) | F.col("a").isNull()  # as a target
    first = least.select("v", F.when(late, F.col("b")).otherwise(F.col("v")).alias("x"), F.when(late, F.col("v")).otherwise(F.col("a")).alias("y"), late.cast("int").alias("z"))
    return prefix(first, ["x", "y", "z"]).select("v", F.col("position").alias("id"))


def renumbered(arcs: DataFrame, table: DataFrame) -> DataFrame:
    """Arcs in the dense ids of a remap table."""
    one = table.select(F.col("v").alias("src"), F.col("id").alias("s"))
    two = table.select(F.col("v").alias("dst"), F.col("id").alias("t"))
    return arcs.join(one, "src").join(two, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


def shuffled_positions(edges: DataFrame, seed: int) -> DataFrame:
    """``edges`` with ``pos`` in a seeded random order, which changes the dense ids and nothing else."""
    keyed = edges.withColumn("_key", F.xxhash64(F.lit(seed), "src", "dst"))
    return prefix(keyed, ["_key", "src", "dst"]).withColumnRenamed("position", "pos").drop("_key")


def row_ptr(arcs: DataFrame) -> DataFrame:
    """v, degree and the number of arcs of smaller ids."""
    d = out_degree(arcs)
    return prefix(d, ["v"], F.col("degree")).select("v", "degree", F.col("before").alias("row_ptr"))


def adjacency(arcs: DataFrame) -> DataFrame:
    """src and its sorted targets, the compressed-row view as rows."""
    return arcs.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"), F.count(F.lit(1)).alias("degree"))
