"""Graph queries against their SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
NAMES = ["catalog_directed_flag", "bfs_directed", "validate_tree_edges", "validate_levels", "benchmark_run", "plot_teps", "results_coverage", "kronecker_edges", "dense_remap", "csr_roundtrip", "search_keys", "debug_rows", "symmetrize", "edge_stats", "out_degree", "degree_stats", "csr_row_ptr", "shuffle_remap", "edge_list_scan", "bfs_parents", "bfs_multi_source", "validate_summary", "displacements", "imbalance_metrics", "teps_harmonic", "times_p90", "results_load", "mrg_stream", "scramble_permutation", "bernoulli_quadrant", "parse_run_spec", "result_path_routing", "frontier_bitset_words"]


def rows(columns, found):
    """Sorted rows with columns in one order; nulls and NaN as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: "null" if x is None else "nan" if x != x else round(x, 6) if isinstance(x, float) else x
    return sorted(tuple(map(str, (clean(r[i]) for i in order))) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in df]
    assert rows(got.columns, plain(map(tuple, got.collect()))) == rows(want.columns, plain(want.fetchall()))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_no_query_leaves_rows_out(spark):
    assert not [n for n, sql in registry.ORACLES.items() if "l_quantity >=" in sql]
    assert registry.QUERIES["symmetrize"](spark, SF).count() == 2 * spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert __spark_entry__.entry(spark).count() == 1673  # FIXTURES.md, part 4
