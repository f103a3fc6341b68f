"""Which edge lists already hold both directions, and where results of a graph go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public graphs and whether their files hold both directions.
CATALOG = {"com-dblp": 0, "com-lj.ungraph": 0, "as-skitter": 0, "com-orkut": 0}


def catalog(spark: SparkSession, more: dict[str, int] | None = None) -> DataFrame:
    """The public graphs and those of ``more``, which come first."""
    return spark.createDataFrame(list((CATALOG | (more or {})).items()), "graph string, directed int")


def directed_flag(names: DataFrame, known: DataFrame) -> DataFrame:
    """graph and directed, 0 for graphs the catalog doesn't know."""
    return names.join(known, "graph", "left").select("graph", F.coalesce("directed", F.lit(0)).alias("directed"))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def result_path(path: Column, variant: Column, cores: Column) -> Column:
    folder = F.when(stem(path).startswith("kronecker"), F.lit("weak_scaling")).otherwise(stem(path))
    return F.concat(F.lit("results/"), folder, F.lit("/"), variant, cores.cast("string"), F.lit(".txt"))


def run_spec(name: Column) -> tuple[Column, Column]:
    """Variant and cores of a file stem such as basic16; null where it is neither."""
    variant = F.regexp_extract(name, r"^(basic|hybrid)(\d+)$", 1)
    cores = F.regexp_extract(name, r"^(basic|hybrid)(\d+)$", 2)
    return F.when(variant != "", variant), F.when(variant != "", cores).cast("int")
