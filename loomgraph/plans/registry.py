"""Queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import glibc, mrg
from loomgraph.operators import bfs, etl, metrics, summary, validate
from loomgraph.operators.scan import prefix
from loomgraph.plans import benchmark, graphs
from loomgraph.session import scratch, written
from loomgraph.sources import catalog, csr, edge_list, kronecker, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RANKS = 4
DRAWS = 1000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return named


_EDGES = "edges AS (SELECT 2 * l_orderkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem)"
_ARCS = f"{_EDGES}, arcs AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
_ROOT = "root AS (SELECT min(src) AS s FROM arcs)"
_BFS = """lv(v, d) USING KEY (v) AS (
  SELECT s, 0 FROM root UNION
  SELECT e.dst, min(b.d) + 1 FROM lv b JOIN arcs e ON e.src = b.v ANTI JOIN recurring.lv r ON r.v = e.dst GROUP BY e.dst
)"""
_TREE = f"""{_ARCS}, {_ROOT}, {_BFS}, tree AS (
  SELECT b.v, b.d::INTEGER AS d, CASE WHEN b.d = 0 THEN b.v ELSE min(p.v) END AS parent
  FROM lv b LEFT JOIN arcs e ON e.dst = b.v LEFT JOIN lv p ON p.v = e.src AND p.d = b.d - 1 GROUP BY b.v, b.d
)"""
_DENSE = f"""{_EDGES}, pos AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS p FROM edges),
seen AS (SELECT v, min(place) AS place FROM (SELECT src AS v, 2 * p AS place FROM pos UNION ALL SELECT dst, 2 * p + 1 FROM pos) GROUP BY v),
ids AS (SELECT v, (row_number() OVER (ORDER BY place) - 1)::BIGINT AS id FROM seen),
darcs AS (SELECT a.id AS src, b.id AS dst FROM edges e JOIN ids a ON a.v = e.src JOIN ids b ON b.v = e.dst),
arcs AS (SELECT src, dst FROM darcs UNION ALL SELECT dst, src FROM darcs),
size AS (SELECT count(*) AS n, ceil(count(*) / {RANKS}.0)::BIGINT AS block FROM ids)"""
_DEGREE = "deg AS (SELECT v, sum(k)::BIGINT AS degree FROM (SELECT src AS v, 1 AS k FROM arcs UNION ALL SELECT dst, 0 FROM arcs) GROUP BY v)"
_RESULTS = """r AS (SELECT CASE l_returnflag WHEN 'R' THEN 'weak_scaling' ELSE l_returnflag END AS graph, CASE WHEN l_linestatus = 'O' THEN 'basic' ELSE 'hybrid' END AS variant, (1 << (l_linenumber - 1))::INTEGER AS cores,
  l_extendedprice / 1e4 AS total_time, l_tax AS comm_time, l_quantity AS teps, l_tax AS tax, 2 + l_discount AS max_over_mean, 1 + l_tax AS cv FROM lineitem)"""


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.symmetrize(graphs.order_part(spark, sf_dir))


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    arcs = _arcs(spark, sf_dir)
    source = graphs.first_vertex(arcs)
    return bfs.bfs_from(arcs, source), arcs, source


# Edge lists and adjacency


@query(f"WITH {_ARCS} SELECT src, dst FROM arcs")
def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arcs(spark, sf_dir)


@query(f"""WITH {_ARCS}, v AS (SELECT src AS v FROM arcs UNION SELECT dst FROM arcs)
SELECT count(*)::BIGINT AS n_arcs, max(greatest(src, dst))::BIGINT AS max_id, (SELECT count(*) FROM v)::BIGINT AS n_vertices,
  ((SELECT count(*) FROM v) + 1)::BIGINT * 8 AS row_ptr_bytes, count(*)::BIGINT * 4 AS col_idx_bytes FROM arcs""")
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.edge_stats(_arcs(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events), arcs AS (SELECT * FROM e WHERE dst IS NOT NULL),
""" + _DEGREE + " SELECT v, degree FROM deg")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.out_degree(graphs.user_transitions(spark, sf_dir))


@query(f"""WITH e AS (SELECT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem), arcs AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), {_DEGREE}
SELECT min(degree)::BIGINT AS min_degree, max(degree)::BIGINT AS max_degree, avg(degree) AS avg_degree FROM deg""")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.degree_stats(etl.symmetrize(graphs.part_supplier(spark, sf_dir)))


@query(f"WITH {_ARCS} SELECT src, dst, (row_number() OVER (ORDER BY src, dst) - 1)::BIGINT AS position FROM arcs")
def sorted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.sorted_edges(_arcs(spark, sf_dir))


@query(f"WITH {_DENSE} SELECT v, id FROM ids")
def dense_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graphs.order_part(spark, sf_dir)
    return etl.remap_table(prefix(edges, ["src", "dst"]).withColumnRenamed("position", "pos"))


@query(f"WITH {_DENSE}, {_DEGREE} SELECT v, degree, coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_ptr FROM deg")
def csr_row_ptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.row_ptr(graphs.dense(spark, sf_dir)[0])


@query(f"WITH {_DENSE} SELECT (row_number() OVER (ORDER BY src, dst) - 1)::BIGINT AS position, dst AS col_idx FROM arcs")
def csr_col_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.sorted_edges(graphs.dense(spark, sf_dir)[0]).select("position", F.col("dst").alias("col_idx"))


@query("""WITH e AS (SELECT 2 * o_custkey AS src, 2 * o_orderkey + 1 AS dst FROM orders), arcs AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)
SELECT src, count(*)::BIGINT AS degree, array_to_string(list_sort(list(dst)), ',') AS neighbors FROM arcs GROUP BY src""")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = etl.adjacency(etl.symmetrize(graphs.customer_order(spark, sf_dir)))
    return lists.select("src", "degree", F.concat_ws(",", F.transform("neighbors", lambda x: x.cast("string"))).alias("neighbors"))


@query("""SELECT graph, CASE WHEN graph IN ('ASIA', 'EUROPE') THEN 1 ELSE 0 END AS directed
FROM (SELECT DISTINCT r_name AS graph FROM region UNION SELECT 'com-dblp' UNION SELECT 'as-skitter')""")
def catalog_directed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = graphs.table(spark, sf_dir, "region").select(F.col("r_name").alias("graph")).union(spark.createDataFrame([("com-dblp",), ("as-skitter",)], "graph string"))
    return catalog.directed_flag(names.distinct(), catalog.catalog(spark, {"ASIA": 1, "EUROPE": 1}))


@query("""WITH RECURSIVE e AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events), arcs AS (SELECT * FROM e WHERE dst IS NOT NULL), root AS (SELECT min(least(src, dst)) AS s FROM arcs),
""" + _BFS + """ SELECT b.v, b.d::INTEGER AS d, CASE WHEN b.d = 0 THEN b.v ELSE min(p.v) END AS parent
FROM lv b LEFT JOIN arcs e ON e.dst = b.v LEFT JOIN lv p ON p.v = e.src AND p.d = b.d - 1 GROUP BY b.v, b.d""")
def bfs_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search along the arcs of a graph whose file is taken as it is."""
    arcs = etl.directed_arcs(graphs.user_transitions(spark, sf_dir), 1)
    return bfs.bfs_from(arcs, graphs.first_vertex(arcs))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def edge_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges written as text, with comments and lines that hold no edge, and read again."""
    path = scratch(spark, "edge-list")
    edge_list.write(graphs.order_part(spark, sf_dir), path)
    spark.createDataFrame([("# a comment",), ("x y",), ("7",), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    return edge_list.read(spark, path)


@query(f"""WITH {_ARCS}, {_DEGREE} SELECT degree, count(*)::BIGINT AS n FROM deg GROUP BY degree""")
def shuffle_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees after a shuffle of the edges and renumbering: the same as before it."""
    edges = graphs.order_part(spark, sf_dir)
    ids = written(etl.remap_table(etl.shuffled_positions(edges, 5)), "remap")
    return etl.out_degree(etl.renumbered(etl.symmetrize(edges), ids)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DENSE} SELECT src, dst FROM arcs")
def csr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense arcs written as a compressed-row file and read back by blocks of vertices."""
    path = f"{scratch(spark, 'csr')}/graph.bin"
    csr.write(graphs.dense(spark, sf_dir)[0], path)
    return csr.read(spark, path)


# Breadth-first search


@query(f"""WITH {_ARCS}, {_ROOT}, f AS (SELECT s AS v FROM root UNION SELECT dst FROM arcs JOIN root ON src = s)
SELECT dst AS v, min(src)::BIGINT AS parent FROM arcs WHERE src IN (FROM f) AND dst NOT IN (FROM f) GROUP BY dst""")
def bfs_expand_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the root and its neighbours reach in one step."""
    arcs = _arcs(spark, sf_dir)
    source = graphs.first_vertex(arcs)
    near = arcs.where(F.col("src") == source).select(F.col("dst").alias("v")).union(spark.createDataFrame([(source,)], "v long")).distinct()
    return bfs.expand_one_hop(near, arcs)


@query(f"WITH RECURSIVE {_TREE} SELECT v, d FROM tree")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[0].select("v", "d")


@query(f"WITH RECURSIVE {_TREE} SELECT v, d, parent FROM tree")
def bfs_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_TREE}, {_DEGREE} SELECT d, count(*)::BIGINT AS frontier_size, sum(degree)::BIGINT AS scanned_arcs FROM tree JOIN deg USING (v) GROUP BY d")
def bfs_level_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, arcs, _ = _tree(spark, sf_dir)
    return bfs.level_profile(tree, etl.out_degree(arcs))


_KEYS = ", ".join(f"({i}, {x})" for i, x in enumerate(glibc.rand(11, 64)))


@query(f"WITH {_DENSE} SELECT k.run::INTEGER AS run, (k.x % (SELECT n FROM size))::BIGINT AS source FROM (VALUES {_KEYS}) k(run, x)")
def search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = etl.vertices(graphs.order_part(spark, sf_dir)).count()
    return spark.createDataFrame(list(enumerate(glibc.search_keys(n))), "run int, source long")


@query(f"""WITH RECURSIVE {_DENSE}, roots AS (SELECT k.run, (k.x % (SELECT n FROM size))::BIGINT AS s FROM (VALUES {_KEYS}) k(run, x)),
lv(run, v, d) USING KEY (run, v) AS (
  SELECT run, s, 0 FROM roots UNION
  SELECT b.run, e.dst, min(b.d) + 1 FROM lv b JOIN arcs e ON e.src = b.v ANTI JOIN recurring.lv r ON r.v = e.dst AND r.run = b.run GROUP BY b.run, e.dst
)
SELECT b.run::INTEGER AS run, b.v, b.d::INTEGER AS d, CASE WHEN b.d = 0 THEN b.v ELSE min(p.v) END AS parent
FROM lv b LEFT JOIN arcs e ON e.dst = b.v LEFT JOIN lv p ON p.run = b.run AND p.v = e.src AND p.d = b.d - 1 GROUP BY b.run, b.v, b.d""")
def bfs_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 runs of the benchmark in one search."""
    arcs, n = graphs.dense(spark, sf_dir)
    roots = spark.createDataFrame(list(enumerate(glibc.search_keys(n))), "run int, source long")
    return bfs.bfs(arcs, roots)


@query(f"""WITH RECURSIVE {_TREE} SELECT d, v // 64 AS word, bit_or(CASE WHEN v % 64 = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (v % 64)::INTEGER END) AS bits
FROM tree GROUP BY d, v // 64""")
def frontier_bitset_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier of every level as 64-bit words."""
    return bfs.bitset_words(_tree(spark, sf_dir)[0].select("d", "v"), ["d"])


# Validation, on a tree in which some parents are moved: to the root, to the vertex itself, to an id that no vertex has

_BAD = f"""{_TREE}, bad AS (SELECT v, d, CASE WHEN d = 0 THEN -2 WHEN d >= 2 AND v % 7 = 0 THEN s WHEN d >= 1 AND v % 11 = 0 THEN v WHEN d >= 1 AND v % 13 = 0 THEN -1 ELSE parent END AS parent FROM tree, root),
others AS (SELECT * FROM bad, root WHERE v <> s)"""


def _damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    tree, arcs, source = _tree(spark, sf_dir)
    d, v = F.col("d"), F.col("v")
    moved = F.when(d == 0, F.lit(-2)).when((d >= 2) & (v % 7 == 0), F.lit(source)).when((d >= 1) & (v % 11 == 0), v).when((d >= 1) & (v % 13 == 0), F.lit(-1)).otherwise(F.col("parent"))
    return tree.withColumn("parent", moved.cast("long")), arcs, source


@query(f"WITH RECURSIVE {_BAD} SELECT v, d, parent FROM others b WHERE v <> parent AND NOT EXISTS (SELECT 1 FROM arcs e WHERE e.src = b.v AND e.dst = b.parent)")
def validate_tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, arcs, source = _damaged(spark, sf_dir)
    return validate.bad_edges(tree, arcs, source)


@query(f"WITH RECURSIVE {_BAD} SELECT b.v, b.d, b.parent, p.d AS parent_d FROM others b JOIN bad p ON p.v = b.parent WHERE b.v <> b.parent AND b.d <> p.d + 1")
def validate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _, source = _damaged(spark, sf_dir)
    return validate.bad_levels(tree, source)


@query(f"""WITH RECURSIVE {_BAD}
SELECT 'root' AS check_name, count(*)::BIGINT AS errors FROM bad, root WHERE v = s AND (parent <> s OR d <> 0) UNION ALL
SELECT 'parent', count(*) FROM others WHERE parent = v OR parent NOT IN (SELECT src FROM arcs) UNION ALL
SELECT 'edge', count(*) FROM others b WHERE v <> parent AND parent IN (SELECT src FROM arcs) AND NOT EXISTS (SELECT 1 FROM arcs e WHERE e.src = b.v AND e.dst = b.parent) UNION ALL
SELECT 'level', count(*) FROM others b JOIN bad p ON p.v = b.parent WHERE b.v <> b.parent AND b.d <> p.d + 1 UNION ALL
SELECT 'arc', count(*) FROM arcs LEFT JOIN tree a ON a.v = src LEFT JOIN tree b ON b.v = dst WHERE (a.v IS NULL) <> (b.v IS NULL) OR abs(a.d - b.d) > 1""")
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, arcs, source = _damaged(spark, sf_dir)
    return validate.summary(tree, arcs, source, etl.vertices(arcs))


@query(f"WITH {_DENSE} SELECT count(*)::BIGINT AS misrouted FROM arcs, size WHERE dst % {RANKS} <> dst // block")
def routing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs that a cyclic instead of a block distribution would bring to another rank than their owner."""
    arcs, n = graphs.dense(spark, sf_dir)
    return metrics.misrouted(arcs, F.col("dst") % RANKS, n, RANKS)


# Logical ranks and metrics


@query(f"WITH {_DENSE} SELECT id AS v, (id // block)::BIGINT AS rank FROM ids, size")
def vertex_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, n = graphs.dense(spark, sf_dir)
    return etl.vertices(arcs).select("v", metrics.owner(F.col("v"), n, RANKS).alias("rank"))


_MATRIX = f"{_DENSE}, matrix AS (SELECT (src // block)::BIGINT AS sender, (dst // block)::BIGINT AS receiver, count(*)::BIGINT AS messages FROM arcs, size GROUP BY ALL)"


@query(f"WITH {_MATRIX} SELECT sender, receiver, messages FROM matrix")
def message_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, n = graphs.dense(spark, sf_dir)
    return metrics.message_matrix(arcs, n, RANKS)


@query(f"""WITH {_MATRIX} SELECT sender, receiver, messages,
  coalesce(sum(messages) OVER (PARTITION BY sender ORDER BY receiver ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS send_start,
  coalesce(sum(messages) OVER (PARTITION BY receiver ORDER BY sender ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS receive_start FROM matrix""")
def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, n = graphs.dense(spark, sf_dir)
    return metrics.displacements(metrics.message_matrix(arcs, n, RANKS))


_LOCAL = f"""{_DENSE}, root AS (SELECT 0::BIGINT AS s), {_BFS}, {_DEGREE},
local AS (SELECT r.rank, (2 * coalesce(k, 0))::BIGINT AS traversed FROM (SELECT unnest(range({RANKS})) AS rank) r
  LEFT JOIN (SELECT v // block AS rank, sum(degree) AS k FROM lv JOIN deg USING (v), size GROUP BY ALL) USING (rank))"""


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, n = graphs.dense(spark, sf_dir)
    return metrics.traversed_by_rank(bfs.bfs_from(arcs, 0), etl.out_degree(arcs), n, RANKS)


@query(f"WITH RECURSIVE {_LOCAL} SELECT rank::BIGINT AS rank, traversed FROM local")
def traversed_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir)


@query(f"""WITH RECURSIVE {_LOCAL}, a AS (SELECT max(traversed) AS top, sum(traversed)::BIGINT AS total, count(*)::BIGINT AS p, sum(traversed * traversed)::BIGINT AS squares FROM local),
b AS (SELECT *, total / p AS mean, (total // 2) / p AS half FROM a)
SELECT p, total, round(top / half, 9) AS max_over_mean_ref, round(sqrt(squares / p - 2 * half * mean + half * half) / half, 9) AS cv_ref,
  round(top / mean, 9) AS max_over_mean, round(sqrt(squares / p - mean * mean) / mean, 9) AS cv FROM b""")
def imbalance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.imbalance(_local(spark, sf_dir))
    return found.select("p", "total", *(F.round(c, 9).alias(c) for c in ("max_over_mean_ref", "cv_ref", "max_over_mean", "cv")))


@query("""WITH t AS (SELECT l_linenumber::INTEGER AS run, l_suppkey % 16 AS rank, max(l_extendedprice) AS total_time, max(l_tax) AS comm_time, sum(l_quantity::BIGINT)::BIGINT AS traversed
  FROM lineitem GROUP BY ALL)
SELECT run, max(total_time) AS total_time, max(comm_time) AS comm_time, round((sum(traversed)::BIGINT // 2) / max(total_time), 9) AS teps FROM t GROUP BY run""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_metrics(graphs.rank_times(spark, sf_dir), ["run"]).withColumn("teps", F.round("teps", 9))


_RUNS = f"""{_DENSE}, {_DEGREE}, roots AS (SELECT k.run, (k.x % (SELECT n FROM size))::BIGINT AS s FROM (VALUES {_KEYS}) k(run, x)),
lv(run, v, d) USING KEY (run, v) AS (
  SELECT run, s, 0 FROM roots UNION
  SELECT b.run, e.dst, min(b.d) + 1 FROM lv b JOIN arcs e ON e.src = b.v ANTI JOIN recurring.lv r ON r.v = e.dst AND r.run = b.run GROUP BY b.run, e.dst
), local AS (SELECT run, v // block AS rank, (2 * sum(degree))::BIGINT AS k, count(*)::BIGINT AS n, max(d)::INTEGER AS d FROM lv JOIN deg USING (v), size GROUP BY ALL),
a AS (SELECT run, sum(n)::BIGINT AS reached, max(d) AS depth, max(k) AS top, sum(k)::BIGINT AS total, sum(k * k)::BIGINT AS squares FROM local GROUP BY run),
b AS (SELECT *, total / {RANKS} AS mean, (total // 2) / {RANKS} AS half FROM a)"""


@query(f"""WITH RECURSIVE {_RUNS} SELECT b.run::INTEGER AS run, s AS source, reached, depth, 0::BIGINT AS errors, total AS traversed,
  CASE WHEN half > 0 THEN round(top / half, 9) ELSE -1 END AS max_over_mean, CASE WHEN half > 0 THEN round(sqrt(greatest(squares / {RANKS} - 2 * half * mean + half * half, 0)) / half, 9) ELSE -1 END AS cv,
  64::BIGINT AS n_lines FROM b JOIN roots USING (run)""")
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a compressed-row file to 64 validated runs, whose lines are appended and loaded again; without the times."""
    path, root = f"{scratch(spark, 'benchmark')}/graph.bin", scratch(spark, "benchmark-results")
    csr.write(graphs.dense(spark, sf_dir)[0], path)
    done = benchmark.run(spark, path, root, "order-part", "basic", RANKS, ranks=RANKS)
    lines = results.load(spark, root).where(f"variant = 'basic' AND cores = {RANKS} AND total_time >= 0").count()
    return done.select("run", "source", "reached", "depth", "errors", "traversed", *(F.round(c, 9).alias(c) for c in ("max_over_mean", "cv")), F.lit(lines).cast("long").alias("n_lines"))


# Summaries of results


@query(f"""WITH {_RESULTS}, a AS (SELECT graph, variant, cores, 'quantity' AS measure, teps AS x FROM r UNION ALL SELECT graph, variant, cores, 'tax', tax FROM r)
SELECT graph, variant, cores, measure, round(CASE WHEN min(x) <= 0 THEN 'NaN'::DOUBLE ELSE count(x) / sum(1.0::DOUBLE / nullif(x, 0)) END, 9) AS teps FROM a GROUP BY ALL""")
def teps_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic means of a measure that is positive everywhere and of one that isn't."""
    parts = [summary.teps_harmonic(graphs.results(spark, sf_dir, c)).withColumn("measure", F.lit(name)) for c, name in (("l_quantity", "quantity"), ("l_tax", "tax"))]
    return parts[0].unionByName(parts[1]).withColumn("teps", F.round("teps", 9))


@query(f"WITH {_RESULTS} SELECT graph, variant, cores, round(quantile_cont(total_time, 0.9), 9) AS total_time_p90, round(quantile_cont(comm_time, 0.9), 9) AS comm_time_p90 FROM r GROUP BY ALL")
def times_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = summary.times_p90(graphs.results(spark, sf_dir))
    return done.withColumns({c: F.round(c, 9) for c in ("total_time_p90", "comm_time_p90")})


@query(f"WITH {_RESULTS} SELECT graph, variant, cores, round(avg(max_over_mean), 9) AS max_over_mean FROM r GROUP BY ALL")
def max_over_mean_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.mean_of(graphs.results(spark, sf_dir), "max_over_mean").withColumn("max_over_mean", F.round("max_over_mean", 9))


@query(f"WITH {_RESULTS} SELECT graph, variant, cores, round(avg(cv), 9) AS cv FROM r GROUP BY ALL")
def cv_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.mean_of(graphs.results(spark, sf_dir), "cv").withColumn("cv", F.round("cv", 9))


@query(f"""WITH {_RESULTS} SELECT graph, variant, cores, round(quantile_cont(total_time, 0.9), 9) AS total_time_p90, CASE graph WHEN 'weak_scaling' THEN 'Kronecker generated' ELSE graph END AS title FROM r WHERE total_time > 0 GROUP BY ALL""")
def plot_total_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.plot_data(graphs.results(spark, sf_dir), "total_time").withColumn("total_time_p90", F.round("total_time_p90", 9))


@query(f"WITH {_RESULTS} SELECT graph, variant, cores, round(count(teps) / sum(1.0::DOUBLE / teps), 9) AS teps, CASE graph WHEN 'weak_scaling' THEN 'Kronecker generated' ELSE graph END AS title FROM r WHERE teps > 0 GROUP BY ALL")
def plot_teps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.plot_data(graphs.results(spark, sf_dir), "teps").withColumn("teps", F.round("teps", 9))


@query(f"""WITH {_RESULTS} SELECT graph, variant, cores, round(quantile_cont(total_time, 0.9), 9) AS total_time_p90, round(quantile_cont(comm_time, 0.9), 9) AS comm_time_p90,
  CASE graph WHEN 'weak_scaling' THEN 'Kronecker generated' ELSE graph END AS title FROM r WHERE total_time > 0 GROUP BY ALL""")
def plot_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.plot_data(graphs.results(spark, sf_dir), "times").withColumns({c: F.round(c, 9) for c in ("total_time_p90", "comm_time_p90")})


@query(f"WITH {_RESULTS} SELECT graph, variant, cores, round(avg(max_over_mean), 9) AS max_over_mean, CASE graph WHEN 'weak_scaling' THEN 'Kronecker generated' ELSE graph END AS title FROM r WHERE max_over_mean > 0 GROUP BY ALL")
def plot_max_over_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.plot_data(graphs.results(spark, sf_dir), "max_over_mean").withColumn("max_over_mean", F.round("max_over_mean", 9))


@query(f"WITH {_RESULTS} SELECT graph, variant, cores, round(avg(cv), 9) AS cv, CASE graph WHEN 'weak_scaling' THEN 'Kronecker generated' ELSE graph END AS title FROM r WHERE cv >= 0 GROUP BY ALL")
def plot_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.plot_data(graphs.results(spark, sf_dir), "cv").withColumn("cv", F.round("cv", 9))


@query(f"""WITH {_EDGES}, both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), arcs AS (SELECT * FROM both_ways), {_DEGREE},
t AS (SELECT v, degree, row_number() OVER (ORDER BY v) AS k FROM deg) SELECT v, degree FROM t WHERE k <= 15""")
def debug_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degrees of the first 15 ids, as a debug dump shows them."""
    return etl.out_degree(_arcs(spark, sf_dir)).orderBy("v").limit(15)


@query(f"""WITH {_RESULTS} SELECT graph, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants, string_agg(DISTINCT cores, ',' ORDER BY cores) AS cores, count(*)::BIGINT AS n FROM r GROUP BY graph""")
def results_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of the results, and which variants and numbers of cores each has."""
    return results.coverage(graphs.results(spark, sf_dir))


_NAMES = """n AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'other' ELSE 'basicx' END || CAST(o_custkey % 128 AS VARCHAR) AS stem, o_orderkey FROM orders)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "basic").when(k == 1, "hybrid").when(k == 2, "other").otherwise("basicx")
    return graphs.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(kind, (F.col("o_custkey") % 128).cast("string")).alias("stem"))


@query(f"""WITH {_NAMES} SELECT o_orderkey, stem, CASE WHEN regexp_matches(stem, '^(basic|hybrid)[0-9]+$') THEN regexp_extract(stem, '^[a-z]+') END AS variant,
  CASE WHEN regexp_matches(stem, '^(basic|hybrid)[0-9]+$') THEN regexp_extract(stem, '[0-9]+$')::INTEGER END AS cores FROM n""")
def parse_run_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant, cores = catalog.run_spec(F.col("stem"))
    return _names(spark, sf_dir).select("o_orderkey", "stem", variant.alias("variant"), cores.alias("cores"))


@query("""SELECT p_partkey, 'results/' || CASE WHEN p_partkey % 3 = 0 THEN 'weak_scaling' ELSE 'graph' || p_partkey || '.v1' END || '/basic' || (p_partkey % 64)::VARCHAR || '.txt' AS path FROM part""")
def result_path_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit("data/csr/kronecker"), key.cast("string"), F.lit(".bin"))).otherwise(F.concat(F.lit("data/csr/graph"), key.cast("string"), F.lit(".v1.bin")))
    return graphs.table(spark, sf_dir, "part").select("p_partkey", catalog.result_path(raw, F.lit("basic"), key % 64).alias("path"))


def _result_files(spark: SparkSession, sf_dir: str) -> str:
    """Files of two graphs and three configurations made of nations, and one file of another name."""
    root = scratch(spark, "results")
    fs, top = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    rows = [r[0] for r in graphs.table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    for graph in ("com-dblp", "weak_scaling"):
        fs.create_dir(f"{top}/{graph}", recursive=True)
        for name in ("basic8", "hybrid16", "basic32", "notes"):
            lines = "".join(f"{k + 1:e} {k / 8:e} {1000 * (k + 1):e} {2 + k / 64:f} {1 + k / 128:f}\n" for k in rows)
            with fs.open_output_stream(f"{top}/{graph}/{name}.txt", compression=None) as out:
                out.write(f"# runs\n{lines}".encode())
    return root


_FILE = "SELECT n_nationkey + 1.0::DOUBLE AS total_time, n_nationkey / 8.0::DOUBLE AS comm_time, 1000.0::DOUBLE * (n_nationkey + 1) AS teps, 2 + n_nationkey / 64.0::DOUBLE AS max_over_mean, 1 + n_nationkey / 128.0::DOUBLE AS cv FROM nation"


@query(f"SELECT total_time, comm_time, teps, round(max_over_mean, 5) AS max_over_mean, round(cv, 5) AS cv FROM ({_FILE})")
def results_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results.scan(spark, f"{_result_files(spark, sf_dir)}/com-dblp/basic8.txt")
    return found.withColumns({c: F.round(c, 5) for c in ("max_over_mean", "cv")})


@query(f"""SELECT total_time, comm_time, teps, round(max_over_mean, 5) AS max_over_mean, round(cv, 5) AS cv, graph, variant, cores::INTEGER AS cores, variant || cores || '.txt' AS filename
FROM ({_FILE}), (VALUES ('com-dblp'), ('weak_scaling')) g(graph), (VALUES ('basic', 8), ('hybrid', 16), ('basic', 32)) c(variant, cores)""")
def results_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.load(spark, _result_files(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("max_over_mean", "cv")})


# Generator


@query(f"""WITH RECURSIVE s(i, z1, z2, z3, z4, z5) AS (SELECT 0::BIGINT, 3::BIGINT, 3::BIGINT, 5::BIGINT, 7::BIGINT, 11::BIGINT UNION ALL
  SELECT i + 1, ((107374182::HUGEINT * z1 + 104480::HUGEINT * z5) % 2147483647)::BIGINT, z1, z2, z3, z4 FROM s WHERE i < {DRAWS})
SELECT i - 1 AS i, z1 AS value FROM s WHERE i > 0""")
def mrg_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first draws of the generator, each by a skip of its own from the seed."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            z = mrg.states(kronecker.SEED, batch.column(0).to_numpy(), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mrg.step(z).astype("int64"))], ["i", "value"])

    kronecker.ship(spark)
    return spark.range(DRAWS).select(F.col("id").alias("i")).mapInArrow(run, "i long, value long")


_A, _B = kronecker.scramble_values(kronecker.SEED)
_REV = "list_sum(list_transform(range(64), lambda i: ((({x})::UBIGINT >> i::UBIGINT) & 1::UBIGINT)::HUGEINT * (1::HUGEINT << (63 - i)::HUGEINT)))::UHUGEINT"
_MOD = "18446744073709551616::UHUGEINT"


@query(f"""WITH v AS (SELECT DISTINCT p_partkey % 1024 AS v FROM part),
a AS (SELECT v, ((v::UHUGEINT + {(_A + _B) % 2**64}::UHUGEINT) % {_MOD}) AS x FROM v),
m(v, x) AS (SELECT v, ((((x // 4294967296) * {_A | kronecker.ODD_1}::UHUGEINT) % {_MOD}) * 4294967296 + ((x % 4294967296) * {_A | kronecker.ODD_1}::UHUGEINT)) % {_MOD} FROM a),
b AS (SELECT v, {_REV.format(x="x")} // 18014398509481984 AS x FROM m),
c AS (SELECT v, (x * {_B | kronecker.ODD_2}::UHUGEINT) % {_MOD} AS x FROM b)
SELECT v::BIGINT AS v, ({_REV.format(x="x")} // 18014398509481984)::BIGINT AS scrambled FROM c""")
def scramble_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids below 1024 after the generator's permutation."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kronecker.scramble(batch.column(0).to_numpy(), 10, _A, _B).astype("int64"))], ["v", "scrambled"])

    kronecker.ship(spark)
    return graphs.table(spark, sf_dir, "part").select((F.col("p_partkey") % 1024).alias("v")).distinct().mapInArrow(run, "v long, scrambled long")


@query("""WITH u AS (SELECT DISTINCT (l_extendedprice * 100)::BIGINT % 2147483647 AS u FROM lineitem)
SELECT u, CASE WHEN u < 3647 THEN NULL WHEN u % 10000 < 1900 THEN 1 WHEN u % 10000 < 3800 THEN 2 WHEN u % 10000 < 9500 THEN 0 ELSE 3 END::INTEGER AS quadrant FROM u""")
def bernoulli_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quadrant of a draw, null where it is drawn again."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            u = batch.column(0).to_numpy().astype("uint64")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kronecker.quadrants(u), pa.int32(), mask=~kronecker.accepted(u))], ["u", "quadrant"])

    kronecker.ship(spark)
    price = F.round(F.col("l_extendedprice") * 100).cast("long") % 2147483647
    return graphs.table(spark, sf_dir, "lineitem").select(price.alias("u")).distinct().mapInArrow(run, "u long, quadrant int")


def _kronecker_sql(scale: int, factor: int) -> str:
    """Edges by the recurrence alone: states by powers of its matrix, a draw a step, and the permutation of ids.

    Fixed values: the seed 3, 3, 5, 7, 11 and the two scramble numbers that it gives.
    """
    p, bits = 2147483647, (factor << scale).bit_length() - 1
    moved = ", ".join(f"(({' + '.join(f'm[{5 * i + j + 1}] * z{j}' for j in range(5))}) % {p})::HUGEINT" for i in range(5))
    a, b = 8283123890190169968, 7194009784960672153
    odd = a | 0x4519840211493211
    ids = f"""i1 AS MATERIALIZED (SELECT v, (v::UHUGEINT + {(a + b) % 2**64}::UHUGEINT) % {_MOD} AS x FROM range({1 << scale}) r(v)),
i2 AS MATERIALIZED (SELECT v, (((x // 4294967296) * {odd}::UHUGEINT % {_MOD}) * 4294967296 + (x % 4294967296) * {odd}::UHUGEINT) % {_MOD} AS x FROM i1),
i3 AS MATERIALIZED (SELECT v, ({_REV.format(x="x")} // {2 ** (64 - scale)}) * {b | 0x3050852102C843A5}::UHUGEINT % {_MOD} AS x FROM i2),
ids AS (SELECT v, ({_REV.format(x="x")} // {2 ** (64 - scale)})::BIGINT AS x FROM i3)"""
    product = "list_transform(range(25), lambda t: list_sum(list_transform(range(5), lambda k: m[5 * (t // 5) + k + 1] * m[5 * k + t % 5 + 1])) % 2147483647)"
    start = [107374182, 0, 0, 0, 104480, *(int(j == i) for i in range(4) for j in range(5))]
    return f"""WITH RECURSIVE pw(bit, m) AS MATERIALIZED (SELECT 0, {start}::HUGEINT[] UNION ALL SELECT bit + 1, {product} FROM pw WHERE bit < {64 + bits}),
st(id, bit, z0, z1, z2, z3, z4) AS MATERIALIZED (SELECT id, 0, 3::HUGEINT, 3::HUGEINT, 5::HUGEINT, 7::HUGEINT, 11::HUGEINT FROM range({factor << scale}) r(id) UNION ALL
  SELECT id, bit + 1, n[1], n[2], n[3], n[4], n[5] FROM (SELECT id, s.bit, CASE WHEN (id >> s.bit) & 1 = 1 THEN [{moved}] ELSE [z0, z1, z2, z3, z4] END AS n FROM st s JOIN pw ON pw.bit = s.bit + 64 WHERE s.bit < {bits})),
w(id, level, s, t, z0, z1, z2, z3, z4) AS (SELECT id, 0, 0, 0, z0, z1, z2, z3, z4 FROM st WHERE bit = {bits} UNION ALL
  SELECT id, level + (u >= 3647)::INT, CASE WHEN u < 3647 THEN s WHEN s = t AND q = 2 THEN s ELSE s + (q // 2) * half END, CASE WHEN u < 3647 THEN t WHEN s = t AND q = 2 THEN t + half ELSE t + (q % 2) * half END, u, z0, z1, z2, z3
  FROM (SELECT *, CASE WHEN u % 10000 < 1900 THEN 1 WHEN u % 10000 < 3800 THEN 2 WHEN u % 10000 < 9500 THEN 0 ELSE 3 END AS q, (1 << ({scale - 1} - level)) AS half
    FROM (SELECT *, (107374182 * z0 + 104480 * z4) % {p} AS u FROM w WHERE level < {scale}))),
{ids},
kron AS (SELECT w.id::BIGINT AS edge_id, a.x AS src, b.x AS dst FROM w JOIN ids a ON a.v = w.s JOIN ids b ON b.v = w.t WHERE level = {scale})"""


_KRON = _kronecker_sql(10, 16)


@query(f"{_KRON} SELECT edge_id, src, dst FROM kron")
def kronecker_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale 10, 16 edges a vertex."""
    return kronecker.kronecker(spark, 10)


@query(f"{_KRON}, arcs AS (SELECT src, dst FROM kron UNION ALL SELECT dst, src FROM kron), {_DEGREE} SELECT degree, count(*)::BIGINT AS n FROM deg GROUP BY degree")
def kronecker_degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.out_degree(etl.symmetrize(kronecker.kronecker(spark, 10))).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
