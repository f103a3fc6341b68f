"""Files of run metrics: <root>/<graph>/<variant><cores>.txt, five numbers a line."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources import catalog

log = logging.getLogger(__name__)
FIELDS = ("total_time", "comm_time", "teps", "max_over_mean", "cv")


def _parsed(lines: DataFrame, *more: Column) -> DataFrame:
    part = F.split(F.trim(F.regexp_replace("value", r"#.*$", "")), r"\s+")
    fields = [F.try_element_at(part, F.lit(i + 1)).cast("double").alias(f) for i, f in enumerate(FIELDS)]
    return lines.where(F.trim(F.regexp_replace("value", r"#.*$", "")) != "").select(*fields, *more)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of the files at ``path``."""
    return _parsed(spark.read.text(path))


def load(spark: SparkSession, root: str) -> DataFrame:
    """All metrics under ``root`` with graph, variant, cores and filename; files of other names are left out, with a message."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "")  # a file, or a folder of parts from ``append``
    lines = spark.read.text(f"{root}/*/*.txt").select("value", path.alias("path"))
    variant, cores = catalog.run_spec(catalog.stem(F.col("path")))
    graph = F.element_at(F.split("path", "/"), -2)
    found = _parsed(lines, graph.alias("graph"), variant.alias("variant"), cores.alias("cores"), F.element_at(F.split("path", "/"), -1).alias("filename"))
    for r in found.where("variant IS NULL").select("graph", "filename").distinct().sort("graph", "filename").collect():  # a row a file
        log.warning("skipped %s/%s: not a result file's name", r["graph"], r["filename"])
    found = found.where("variant IS NOT NULL")
    if found.isEmpty():
        raise FileNotFoundError(f"no result files under {root}")
    return found


def append(metrics: DataFrame, root: str, graph: str, variant: str, cores: int) -> None:
    """Adds a line a run to ``root``/graph/<variant><cores>.txt, a folder of parts that ``load`` and ``scan`` read."""
    lines = metrics.select(F.concat_ws(" ", *(F.col(f).cast("double").cast("string") for f in FIELDS)).alias("value"))
    lines.write.mode("append").text(f"{root}/{graph}/{variant}{cores}.txt")


def coverage(results: DataFrame) -> DataFrame:
    """The graphs of some results with their variants, numbers of cores and runs."""
    return results.groupBy("graph").agg(F.concat_ws(",", F.sort_array(F.collect_set("variant"))).alias("variants"), F.concat_ws(",", F.transform(F.sort_array(F.collect_set("cores")), lambda x: x.cast("string"))).alias("cores"), F.count(F.lit(1)).alias("n"))


def clear(spark: SparkSession, root: str, prefix: str) -> int:
    """Deletes the result files that begin with a prefix, which must not be empty; returns how many."""
    if not prefix:
        raise ValueError("a prefix is needed")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/*/{prefix}*")
    fs = path.getFileSystem(conf)
    found = fs.globStatus(path) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)
