"""Summaries of run metrics by graph, variant and cores, and the data of each plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("graph", "variant", "cores")


def harmonic_mean(x: Column) -> Column:
    """NaN where any value is 0 or less."""
    return F.when(F.min(x) <= 0, F.lit(float("nan"))).otherwise(F.count(x) / F.sum(F.try_divide(F.lit(1.0), x)))


def teps_harmonic(results: DataFrame) -> DataFrame:
    return results.groupBy(*KEYS).agg(harmonic_mean(F.col("teps")).alias("teps"))


def times_p90(results: DataFrame) -> DataFrame:
    """Exact 90th percentiles with linear interpolation."""
    return results.groupBy(*KEYS).agg(F.percentile("total_time", 0.9).alias("total_time_p90"), F.percentile("comm_time", 0.9).alias("comm_time_p90"))


def mean_of(results: DataFrame, column: str) -> DataFrame:
    return results.groupBy(*KEYS).agg(F.avg(column).alias(column))


def title(graph: Column) -> Column:
    return F.when(graph == "weak_scaling", F.lit("Kronecker generated")).otherwise(graph)


def plot_data(results: DataFrame, kind: str) -> DataFrame:
    """Series of one of the plot families, without the rows its filter leaves out."""
    done = {
        "teps": lambda: teps_harmonic(results.where("teps > 0")),
        "total_time": lambda: times_p90(results.where("total_time > 0")).drop("comm_time_p90"),
        "times": lambda: times_p90(results.where("total_time > 0")),
        "max_over_mean": lambda: mean_of(results.where("max_over_mean > 0"), "max_over_mean"),
        "cv": lambda: mean_of(results.where("cv >= 0"), "cv"),
    }[kind]()
    return done.withColumn("title", title(F.col("graph"))).orderBy(*KEYS)
