"""Graphs and run metrics derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import etl
from loomgraph.operators.scan import prefix
from loomgraph.session import MANY, release, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_part(spark: SparkSession, sf_dir: str, quantity: int = 0) -> DataFrame:
    """Edges between orders (even ids) and parts (odd ids), one a line item; with a quantity, of line items of that or more."""
    items = table(spark, sf_dir, "lineitem")
    if quantity:
        items = items.where(F.col("l_quantity") >= quantity)
    return items.select((2 * F.col("l_orderkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"))


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multigraph: parts (even ids) and suppliers (odd ids), an edge a line item."""
    return table(spark, sf_dir, "lineitem").select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"))


def customer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars: each customer (even ids) with its orders (odd ids)."""
    return table(spark, sf_dir, "orders").select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("o_orderkey") + 1).alias("dst"))


def user_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges from each event's user to the next event's, with self-loops."""
    seen = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    placed = prefix(seen, ["ts", "event_id"])
    after = placed.select((F.col("position") - 1).alias("position"), F.col("user_id").alias("dst"))
    return placed.join(after, "position").select(F.col("user_id").alias("src"), "dst")


def first_vertex(arcs: DataFrame) -> int:
    return arcs.agg(F.min(F.least("src", "dst"))).first()[0]


def dense(spark: SparkSession, sf_dir: str, quantity: int = 0) -> tuple[DataFrame, int]:
    """order_part symmetrised in dense ids (edges taken in the order of src and dst), and its number of vertices."""
    ids = written(etl.remap_sorted(order_part(spark, sf_dir, quantity)), "remap")
    n = ids.count()
    if n >= MANY:
        release(spark)
    edges = written(etl.renumbered(order_part(spark, sf_dir, quantity), ids), "edges")
    if n >= MANY:
        release(spark)
    return etl.symmetrize(edges), n


def results(spark: SparkSession, sf_dir: str, teps: str = "l_quantity") -> DataFrame:
    """Run metrics made of line items: graph is the return flag (R stands for weak_scaling), variant the status, cores 1 to 64 by line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "weak_scaling").otherwise(F.col("l_returnflag")).alias("graph"), F.when(F.col("l_linestatus") == "O", "basic").otherwise("hybrid").alias("variant"),
        F.expr("shiftleft(1, int(l_linenumber) - 1)").alias("cores"), (F.col("l_extendedprice") / 1e4).alias("total_time"), F.col("l_tax").alias("comm_time"),
        F.col(teps).alias("teps"), (2 + F.col("l_discount")).alias("max_over_mean"), (1 + F.col("l_tax")).alias("cv"),
    )


def rank_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ranks made of line items: a run a line number, 16 ranks by supplier."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("run"), (F.col("l_suppkey") % 16).alias("rank"), "l_extendedprice", "l_tax", "l_quantity")
    return items.groupBy("run", "rank").agg(F.max("l_extendedprice").alias("total_time"), F.max("l_tax").alias("comm_time"), F.sum(F.col("l_quantity").cast("long")).alias("traversed"))
