"""Edge lists as text: two ids a line, further columns ignored, lines with # in the first place are comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TWO = r"^\s*([+-]?\d+)\s+([+-]?\d+)"


def read(spark: SparkSession, path: str) -> DataFrame:
    """src and dst of all lines that begin with two integers; others are skipped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    ids = [F.expr(f"try_cast(regexp_extract(value, r'{_TWO}', {i}) AS bigint)").alias(c) for i, c in ((1, "src"), (2, "dst"))]
    return lines.select(*ids).where("src IS NOT NULL AND dst IS NOT NULL")


def write(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def missing(spark: SparkSession, names: list[str], raw: str, built: str) -> list[str]:
    """Names whose built file doesn't exist yet; a name without a raw file is an error."""
    jvm = spark.sparkContext._jvm
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(p))
    todo = [n for n in names if not there(f"{built}/{n}.bin")]
    for n in todo:
        if not there(f"{raw}/{n}.txt"):
            raise FileNotFoundError(f"{raw}/{n}.txt")
    return todo
