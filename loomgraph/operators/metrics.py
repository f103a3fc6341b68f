"""Load balance and throughput over ``p`` logical partitions: contiguous blocks of ceil(n / p) ids.

Two definitions stand side by side. In the ``_ref`` ones a rank's local count has each arc twice and the mean once,
so that perfect balance reads 2 and 1; the others are the ordinary ratio and coefficient, 1 and 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import bfs


def owner(v: Column, n: int, p: int) -> Column:
    return F.call_function("div", v, F.lit(max(1, -(-n // p))).cast("long"))  # in whole numbers


def message_matrix(arcs: DataFrame, n: int, p: int) -> DataFrame:
    """Arcs from each owner to each owner: what one owner sends is what the other receives."""
    return arcs.groupBy(owner(F.col("src"), n, p).alias("sender"), owner(F.col("dst"), n, p).alias("receiver")).agg(F.count(F.lit(1)).alias("messages"))


def displacements(matrix: DataFrame) -> DataFrame:
    """Where each message block starts in the buffers of its sender and of its receiver. At most p * p rows."""
    out = Window.partitionBy("sender").orderBy("receiver").rowsBetween(Window.unboundedPreceding, -1)
    into = Window.partitionBy("receiver").orderBy("sender").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return matrix.select("sender", "receiver", "messages", F.coalesce(F.sum("messages").over(out), zero).alias("send_start"), F.coalesce(F.sum("messages").over(into), zero).alias("receive_start"))


def misrouted(arcs: DataFrame, routed_to: Column, n: int, p: int) -> DataFrame:
    """Arcs that went to another rank than their target's owner."""
    return arcs.where(routed_to != owner(F.col("dst"), n, p)).agg(F.count(F.lit(1)).alias("misrouted"))


def traversed_by_rank(tree: DataFrame, degrees: DataFrame, n: int, p: int, runs: DataFrame | None = None) -> DataFrame:
    """Twice the arcs out of a rank's reached vertices, for each of ``runs`` if given; ranks that reach nothing have 0.

    With runs the tree may be compact, with ``bits``.
    """
    keys = ["rank"] if runs is None else ["run", "rank"]
    own = tree.join(degrees, "v").withColumn("rank", owner(F.col("v"), n, p))
    if "bits" in tree.columns:
        own = bfs.expanded(own.groupBy("run", "rank", "bits").agg(F.sum("degree").alias("degree")), bfs.numbered(runs))
    own = own.groupBy(*keys).agg(F.sum("degree").alias("k"))
    ranks = tree.sparkSession.range(p).select(F.col("id").alias("rank"))
    if runs is not None:  # a row a run and rank
        ranks = runs.select("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long"))).alias("rank"))
    return ranks.join(own, keys, "left").select(*keys, (2 * F.coalesce("k", F.lit(0))).cast("long").alias("traversed"))


def imbalance(local: DataFrame, by: list[str] | None = None, column: str = "traversed") -> DataFrame:
    """max_over_mean and cv of a local count, -1 where the mean is 0."""
    x = F.col(column)
    agg = local.groupBy(*(by or [])).agg(F.max(x).alias("top"), F.sum(x).alias("total"), F.count(F.lit(1)).alias("p"), F.sum(x * x).alias("squares"))
    mean, half = F.col("total") / F.col("p"), F.floor(F.col("total") / 2) / F.col("p")
    guarded = lambda by, value: F.when(by > 0, value).otherwise(F.lit(-1.0))
    spread = lambda m: F.greatest(F.col("squares") / F.col("p") - 2 * m * mean + m * m, F.lit(0.0))
    safe = lambda m: F.when(m > 0, m).otherwise(F.lit(1.0))
    return agg.select(
        *(by or []), "p", "total",
        guarded(half, F.col("top") / safe(half)).alias("max_over_mean_ref"), guarded(half, F.sqrt(spread(half)) / safe(half)).alias("cv_ref"),
        guarded(mean, F.col("top") / safe(mean)).alias("max_over_mean"), guarded(mean, F.sqrt(spread(mean)) / safe(mean)).alias("cv"),
    )


def run_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """total_time and comm_time are the slowest rank's; teps is half the local counts over the time."""
    agg = ranks.groupBy(*by).agg(F.max("total_time").alias("total_time"), F.max("comm_time").alias("comm_time"), F.sum("traversed").alias("k"))
    return agg.select(*by, "total_time", "comm_time", (F.expr("k div 2") / F.col("total_time")).alias("teps"))
