"""Joins of many rows with a table of distinct keys, where a few keys may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on, or from a share of all rows, so that at most MOST_HOT keys are.
LEAST_HOT = 2000
MOST_HOT = 20_000


def hot_keys(rows: DataFrame, key: str, count: int | None = None) -> DataFrame:
    """key and n of the keys that hold many rows: at most MOST_HOT."""
    total = rows.count() if count is None else count
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(LEAST_HOT, -(-total // MOST_HOT)))


def join_salted(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the one row of ``table`` for their key. Rows of a hot key are dealt by ``by`` over tasks of LEAST_HOT rows, with a copy of the table's row each.

    hot: ``hot_keys`` of the rows, which is broadcast.
    """
    parts = F.ceil(F.col("n") / LEAST_HOT).cast("int")
    few = F.broadcast(hot.select(F.col(key).alias("hot_key"), parts.alias("parts")))
    one = F.lit(1)
    dealt = rows.join(few, F.col(key) == F.col("hot_key"), "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("parts", one)).cast("int")).drop("hot_key", "parts")
    copies = table.join(few, F.col(key) == F.col("hot_key"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1))).drop("hot_key", "parts")
    return dealt.join(copies, [key, "salt"]).drop("salt")
