"""The benchmark from a compressed-row file to its lines of results: search, validate, measure, append."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import glibc
from loomgraph.operators import bfs, etl, metrics, validate
from loomgraph.session import written
from loomgraph.sources import csr, results


class InvalidTree(ValueError):
    """A search gave a tree that fails a check."""


def run(spark: SparkSession, path: str, root: str, graph: str, variant: str = "basic", cores: int = 1, keys: int = 64, seed: int = 11, ranks: int = 4) -> DataFrame:
    """One row a run: run, source, reached, depth, errors, traversed and the metrics; their lines are appended under ``root``.

    All runs share one search and one validation on words of 64 runs; nothing is appended if any tree is wrong. A
    run's time is its share of the measured wall clock of the search by the arcs it scans, and comm_time that of the
    written levels is part of it, so it is 0.
    """
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arcs = written(csr.read(spark, path, blocks), "benchmark-arcs")
    degrees = written(etl.out_degree(arcs), "benchmark-degrees")
    n = csr.vertices(path)
    roots = spark.createDataFrame(list(enumerate(glibc.search_keys(n, keys, seed))), "run int, source long")
    began = time.perf_counter()
    trees = bfs.bfs(arcs, roots, compact=True)  # its levels are written
    took = time.perf_counter() - began
    errors = validate.errors_by_run(trees, arcs, roots)
    bad = errors.where("errors > 0").orderBy("run").limit(1).collect()
    if bad:
        raise InvalidTree(f"run {bad[0]['run']} has {bad[0]['errors']} errors")
    local = metrics.traversed_by_rank(trees, degrees, n, ranks, roots)
    sizes = bfs.expanded(trees.groupBy("run", "d", "bits").agg(F.count(F.lit(1)).alias("n")), bfs.numbered(roots)).groupBy("run").agg(F.sum("n").alias("reached"), F.max("d").alias("depth"))
    spread = metrics.imbalance(local, ["run"])
    found = written(roots.join(sizes, "run").join(errors, "run").join(spread, "run"), "benchmark-runs")
    arcs_of_all = found.agg(F.sum("total")).first()[0] or 1
    share = F.col("total") / F.lit(float(arcs_of_all))
    done = found.withColumn("total_time", F.lit(took) * share).withColumn("teps", F.when(F.col("total") > 0, F.expr("total div 2") / F.col("total_time")).otherwise(0.0))
    done = written(done.withColumn("comm_time", F.lit(0.0)), "benchmark-lines")
    results.append(done.select("total_time", "comm_time", "teps", F.col("max_over_mean_ref").alias("max_over_mean"), F.col("cv_ref").alias("cv")), root, graph, variant, cores)
    return done.select("run", "source", "reached", "depth", "errors", F.col("total").alias("traversed"), "total_time", "comm_time", "teps", F.col("max_over_mean_ref").alias("max_over_mean"), F.col("cv_ref").alias("cv"))
