"""Global numbering and prefix sums without a single-task window.

Rows are range-partitioned by the order, sorted and written, a file a partition. The parts' totals (one row a part)
give the offsets; within a file the row index is the place, and running sums come from a window over the same parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import written


def prefix(df: DataFrame, order: list[str], value: Column | None = None) -> DataFrame:
    """``df`` with ``position`` (0-based place in the order) and, given a value, ``before`` (sum over earlier rows)."""
    own = F.lit(0).cast("long") if value is None else value.cast("long")
    ranged = df.withColumn("_value", own).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(ranged.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "scan")
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), zero).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), zero).alias("_s0"))
    here = parts.join(F.broadcast(totals), "_part").withColumn("position", F.col("_n0") + F.col("_at"))  # a row a partition
    if value is not None:
        here = here.withColumn("before", F.col("_s0") + F.coalesce(F.sum("_value").over(inside), zero))
    return here.drop("_part", "_at", "_value", "_n0", "_s0")
