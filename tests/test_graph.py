import random
import struct
from collections import deque

import pytest

from loomgraph.functions import glibc, mrg
from loomgraph.operators import bfs, etl, metrics, summary, validate
from loomgraph.operators.scan import prefix
from loomgraph.plans import benchmark
from loomgraph.session import scratch
from loomgraph.sources import catalog, csr, edge_list, results

EDGES = "src long, dst long"


def edges_of(spark, pairs, directed=False):
    df = spark.createDataFrame(pairs, EDGES)
    return df if directed else etl.symmetrize(df)


def tree_of(df):
    return {r.v: (r.d, r.parent) for r in df.collect()}


def plain_bfs(arcs, source):
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
    d, todo = {source: 0}, deque([source])
    while todo:
        v = todo.popleft()
        for w in near.get(v, ()):
            if w not in d:
                d[w] = d[v] + 1
                todo.append(w)
    back = {}
    for a, b in arcs:
        if a in d and d.get(b) == d[a] + 1:
            back[b] = min(a, back.get(b, a))
    return {v: (k, back[v] if k else v) for v, k in d.items()}


def test_edge_list_skips_comments_and_junk(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n10 20\nx y\n20\t30 99\n7\n\n  5 6\n99999999999999999999 1\n")
    found = sorted(map(tuple, edge_list.read(spark, f"file://{tmp_path}/e.txt").collect()))
    assert found == [(5, 6), (10, 20), (20, 30)]


@pytest.mark.parametrize(("pairs", "ids"), [([(7, 3), (3, 9)], {7: 0, 3: 1, 9: 2}), ([(10, 20), (20, 30)], {10: 0, 20: 1, 30: 2}), ([(5, 5)], {5: 0})])
def test_dense_ids_follow_first_appearance(spark, pairs, ids):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    assert {r.v: r.id for r in etl.remap_table(spark.createDataFrame(rows, "pos long, src long, dst long")).collect()} == ids


def test_row_pointers_and_degrees(spark):
    arcs = edges_of(spark, [(0, 1), (1, 2)])
    assert sorted(map(tuple, etl.row_ptr(arcs).collect())) == [(0, 1, 0), (1, 2, 1), (2, 1, 3)]
    assert sorted(map(tuple, etl.sorted_edges(arcs).collect())) == [(0, 1, 0), (1, 0, 1), (1, 2, 2), (2, 1, 3)]
    loops = edges_of(spark, [(5, 5)])
    assert [tuple(r) for r in etl.out_degree(loops).collect()] == [(5, 2)]
    assert edges_of(spark, [(1, 2), (1, 2)]).count() == 4


def test_prefix_numbers_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("(id * 37) % 1000 AS k")
    rows = {r.k: (r.position, r.before) for r in prefix(df, ["k"], df["k"]).collect()}
    assert rows == {k: (k, k * (k - 1) // 2) for k in range(1000)}


def test_bfs_small_cases(spark):
    assert tree_of(bfs.bfs_from(edges_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3)]), 0)) == {0: (0, 0), 1: (1, 0), 2: (1, 0), 3: (2, 1)}
    assert tree_of(bfs.bfs_from(edges_of(spark, [(0, 1), (2, 3)]), 0)) == {0: (0, 0), 1: (1, 0)}
    assert tree_of(bfs.bfs_from(edges_of(spark, [(0, 1)], directed=True), 1)) == {1: (0, 1)}
    assert tree_of(bfs.bfs_from(edges_of(spark, [(5, 5)]), 5)) == {5: (0, 5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_of_random_multigraphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    arcs = edges_of(spark, pairs).cache()
    plain = [(r.src, r.dst) for r in arcs.collect()]
    roots = [(0, pairs[0][0]), (1, pairs[1][1])]
    found = bfs.bfs(arcs, spark.createDataFrame(roots, "run int, source long"), partitions=1 + 2 * seed).cache()
    for run, source in roots:
        own = found.where(f"run = {run}").drop("run")
        assert tree_of(own) == plain_bfs(plain, source)
        assert all(r.errors == 0 for r in validate.summary(own, arcs, source, etl.vertices(arcs)).collect())


def test_long_path_is_compacted(spark):
    arcs = edges_of(spark, [(i, i + 1) for i in range(20)])
    assert tree_of(bfs.bfs_from(arcs, 0))[20] == (20, 19)


def test_validation_finds_faults(spark):
    arcs = edges_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    tree = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0)], "v long, d int, parent long")
    errors = {r.check_name: r.errors for r in validate.summary(tree, arcs, 0, etl.vertices(arcs)).collect()}
    assert errors == {"root": 0, "parent": 0, "edge": 1, "level": 1, "arc": 0}
    without = tree.where("v <> 0")
    assert validate.bad_roots(without, 0).count() == 1
    own = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "v long, d int, parent long")
    assert validate.bad_parents(own, 0, etl.vertices(arcs)).count() == 1


def test_metric_definitions(spark):
    balanced = spark.createDataFrame([(0, 4), (1, 4)], "rank long, traversed long")
    r = metrics.imbalance(balanced).first()
    assert (r.max_over_mean_ref, r.cv_ref, r.max_over_mean, r.cv) == (2, 1, 1, 0)
    nothing = metrics.imbalance(spark.createDataFrame([(0, 0), (1, 0)], "rank long, traversed long")).first()
    assert (nothing.max_over_mean_ref, nothing.cv_ref) == (-1, -1)
    skewed = metrics.imbalance(spark.createDataFrame([(0, 2), (1, 6)], "rank long, traversed long")).first()
    assert skewed.max_over_mean_ref == pytest.approx(2 * skewed.max_over_mean)
    assert skewed.cv_ref == pytest.approx((4 * skewed.cv**2 + 1) ** 0.5)


def test_summaries(spark):
    rows = [("g", "basic", 1, x, 0.0, float(x)) for x in (1.0, 2.0, 3.0, 10.0)] + [("g", "basic", 2, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "graph string, variant string, cores int, total_time double, comm_time double, teps double")
    means = {r.cores: r.teps for r in summary.teps_harmonic(df).collect()}
    assert means[1] == pytest.approx(4 / (1 + 1 / 2 + 1 / 3 + 1 / 10))
    assert means[2] != means[2]
    assert {r.cores: r.total_time_p90 for r in summary.times_p90(df).collect()}[1] == pytest.approx(7.9)
    assert [r.cores for r in summary.plot_data(df, "teps").collect()] == [1]


def test_generator_goldens():
    assert mrg.stream([3, 3, 5, 7, 11], 5) == [323271826, 531831315, 1424994175, 1112178214, 1114289618]
    assert mrg.stream(mrg.skip([3, 3, 5, 7, 11], 50, 7, 0), 4) == [1928565067, 1145686203, 1674985929, 320480098]
    assert glibc.rand(11, 4) == [1989311423, 1130649494, 665249397, 1078488845]
    assert len(mrg.seed_from(2**64 - 1, 5)) == 5
    assert all(0 <= x < 1 for x in [*mrg.random_doubles(5, 1, 2, 3), *mrg.random_floats([3, 3, 5, 7, 11], 5)])
    assert list(mrg.random_doubles(3, 1, 2, 2)) == list(mrg.random_doubles(5, 1, 2, 0)[2:])


def test_kronecker_goldens(spark):
    from loomgraph.sources import kronecker

    found = [(r.src, r.dst) for r in kronecker.kronecker(spark, 4, partitions=3).orderBy("edge_id").limit(8).collect()]
    assert found == [(10, 4), (10, 1), (10, 2), (9, 4), (10, 9), (8, 12), (15, 12), (10, 15)]
    ten = kronecker.kronecker(spark, 10, partitions=5).cache()
    assert ten.where("src = dst").count() == 157
    assert etl.vertices(ten).count() == 882
    assert ten.select("src", "dst").distinct().count() == 10529
    assert kronecker.graph(spark, 6, 100, 7, 9).count() == 100
    import numpy as np

    assert sorted(kronecker.scramble(np.arange(1024), 10, 5, 9).tolist()) == list(range(1024))


def test_csr_file(spark):
    arcs = edges_of(spark, [(0, 1), (1, 2), (0, 2), (3, 3)])
    path = f"{scratch(spark, 'csr-test')}/g.bin"
    assert csr.write(arcs, path) == (4, 8)
    for blocks in (1, 3, 9):
        assert sorted(map(tuple, csr.read(spark, path, blocks).collect())) == sorted(map(tuple, arcs.collect()))
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        raw = f.read()
    assert struct.unpack_from("<IQ5Q", raw) == (4, 8, 0, 2, 4, 6, 8)
    assert len(raw) == 12 + 8 * 5 + 4 * 8


def test_results_and_names(spark, tmp_path):
    for graph, name in (("com-dblp", "basic8"), ("weak_scaling", "hybrid16"), ("com-dblp", "notes")):
        (tmp_path / graph).mkdir(exist_ok=True)
        (tmp_path / graph / f"{name}.txt").write_text("# x\n1e0 2e-1 3e2 2.0 1.0\n")
    found = results.load(spark, f"file://{tmp_path}")
    assert sorted((r.graph, r.variant, r.cores, r.teps) for r in found.collect()) == [("com-dblp", "basic", 8, 300.0), ("weak_scaling", "hybrid", 16, 300.0)]
    with pytest.raises(ValueError, match="prefix"):
        results.clear(spark, f"file://{tmp_path}", "")
    assert results.clear(spark, f"file://{tmp_path}", "basic") == 1
    (tmp_path / "none" / "g").mkdir(parents=True)
    (tmp_path / "none" / "g" / "notes.txt").write_text("1 2 3 4 5\n")
    with pytest.raises(FileNotFoundError):
        results.load(spark, f"file://{tmp_path}/none")
    names = spark.createDataFrame([("com-dblp",), ("new",)], "graph string")
    assert {r.graph: r.directed for r in catalog.directed_flag(names, catalog.catalog(spark)).collect()} == {"com-dblp": 0, "new": 0}


def test_appended_results_are_loaded(spark, tmp_path, caplog):
    rows = spark.createDataFrame([(1.0, 0.1, 2.5e9, 2.0, 1.0)], "total_time double, comm_time double, teps double, max_over_mean double, cv double")
    for cores in (1, 1, 2):
        results.append(rows, f"file://{tmp_path}/r", "g", "basic", cores)
    (tmp_path / "r" / "g" / "notes.txt").write_text("1 2 3 4 5\n")
    found = results.load(spark, f"file://{tmp_path}/r")
    assert sorted((r.graph, r.variant, r.cores, r.filename, r.teps) for r in found.collect()) == [("g", "basic", 1, "basic1.txt", 2.5e9)] * 2 + [("g", "basic", 2, "basic2.txt", 2.5e9)]
    assert "g/notes.txt" in caplog.text
    assert results.scan(spark, f"file://{tmp_path}/r/g/basic1.txt").count() == 2
    assert [tuple(r) for r in results.coverage(found).collect()] == [("g", "basic", "1,2", 3)]


def test_files_to_build(spark, tmp_path):
    for name in ("raw/a.txt", "raw/b.txt", "built/a.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    raw, built = f"file://{tmp_path}/raw", f"file://{tmp_path}/built"
    assert edge_list.missing(spark, ["a", "b"], raw, built) == ["b"]
    with pytest.raises(FileNotFoundError):
        edge_list.missing(spark, ["c"], raw, built)


def test_benchmark_stops_at_a_wrong_tree(spark, monkeypatch):
    arcs = edges_of(spark, [(0, 1), (1, 2), (0, 2), (3, 3)])
    path, root = f"{scratch(spark, 'benchmark-test')}/g.bin", scratch(spark, "benchmark-lines")
    csr.write(arcs, path)
    done = benchmark.run(spark, path, root, "g", "basic", 4, keys=6)
    assert done.count() == 6
    assert {r.reached for r in done.collect()} <= {1, 3}
    assert results.load(spark, root).count() == 6
    whole = bfs.bfs
    monkeypatch.setattr(bfs, "bfs", lambda *a, **k: whole(*a, **k).selectExpr("run", "v", "d + 1 AS d", "parent"))
    with pytest.raises(benchmark.InvalidTree):
        benchmark.run(spark, path, root, "g", "basic", 4, keys=6)
    assert results.load(spark, root).count() == 6


def test_errors_of_each_run(spark):
    arcs = edges_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    good = [(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 2, 1)]
    trees = spark.createDataFrame([(0, *r) for r in good] + [(1, *r) for r in good[:3]] + [(1, 3, 2, 0)] + [(2, *r) for r in good[1:]], "run int, v long, d int, parent long")
    roots = spark.createDataFrame([(i, 0) for i in range(4)], "run int, source long")
    assert {r.run: r.errors for r in validate.errors_by_run(trees, arcs, roots).collect()} == {0: 0, 1: 2, 2: 3, 3: 1}


def test_levels_compare_with_two_levels_only(spark):
    """The plan of a level of a symmetric search reads the last two levels, and hubs are dealt over tasks."""
    from loomgraph.operators import skew

    arcs = edges_of(spark, [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 60)] + [(101, 300), (300, 301), (301, 302)])
    assert bfs.is_symmetric(arcs)
    assert not bfs.is_symmetric(edges_of(spark, [(0, 1), (1, 2)], directed=True))
    want = plain_bfs([(r.src, r.dst) for r in arcs.collect()], 302)
    before = skew.LEAST_HOT
    for least in (before, 5):
        skew.LEAST_HOT = least
        try:
            for symmetric in (None, False):
                assert tree_of(bfs.bfs_from(arcs, 302, symmetric=symmetric)) == want
        finally:
            skew.LEAST_HOT = before


def test_seeds_and_random_numbers_of_the_generator():
    """Values worked out by hand from the recurrence and the slices of the two numbers."""
    assert mrg.seed_from(1, 2) == [2, 1, 3, 1, 1]
    assert mrg.seed_from((3 << 60) + (5 << 30) + 7, (1 << 60) + (9 << 30) + 11) == [8, 6, 12, 10, 20]
    first = (107374182 * 2 + 104480 * 1) % 2147483647
    second = (107374182 * first + 104480 * 1) % 2147483647
    state = mrg.skip(mrg.seed_from(1, 2), 2, 0, 0)
    u = mrg.stream(state, 2)
    assert mrg.stream([2, 1, 3, 1, 1], 2) == [first, second]
    assert list(mrg.random_doubles(1, 1, 2)) == [u[0] / 2147483647 + u[1] / 2147483647 / 2147483647]
    assert mrg.random_floats([3, 3, 5, 7, 11], 1)[0] == pytest.approx(323271826 / 2147483647)


def test_runs_of_a_search_share_rows(spark):
    """What a level writes doesn't grow with the runs: 70 runs from the ends of a star's rays, and a root of its own."""
    from pyspark.sql import functions as F

    pairs = [(0, i) for i in range(1, 80)] + [(i, 100 + i % 7) for i in range(1, 80)] + [(900, 901)]
    arcs = edges_of(spark, pairs)
    plain = [(r.src, r.dst) for r in arcs.collect()]
    roots = [(3 * i, i + 1) for i in range(70)] + [(500, 900)]
    given = spark.createDataFrame(roots, "run int, source long")
    words = bfs.bfs(arcs, given, compact=True)
    found = bfs.expanded(words, bfs.numbered(given)).collect()
    assert len(found) == 70 * 87 + 2
    assert words.count() < len(found) / 4
    for run, source in roots:
        assert {r.v: (r.d, r.parent) for r in found if r.run == run} == plain_bfs(plain, source)
    assert {r.errors for r in validate.errors_by_run(words, arcs, given).collect()} == {0}
    least = words.withColumn("parent", F.when(F.col("v") == 5, F.lit(99)).otherwise(F.col("parent")).cast("long"))
    assert {r.run for r in validate.errors_by_run(least, arcs, given).where("errors = 0").collect()} == {500}


def test_words_with_hubs(spark):
    from loomgraph.operators import skew

    rng = random.Random(5)
    for directed in (False, True):
        arcs = edges_of(spark, [(rng.choice((0, rng.randrange(40))), rng.randrange(40)) for _ in range(150)], directed)
        plain = [(r.src, r.dst) for r in arcs.collect()]
        roots = [(i, i) for i in range(6)]
        before, skew.LEAST_HOT = skew.LEAST_HOT, 12
        try:
            found = bfs.bfs(arcs, spark.createDataFrame(roots, "run int, source long")).collect()
        finally:
            skew.LEAST_HOT = before
        for run, source in roots:
            assert {r.v: (r.d, r.parent) for r in found if r.run == run} == plain_bfs(plain, source)


def test_a_vertex_twice_in_a_run_is_an_error(spark):
    arcs = edges_of(spark, [(0, 1), (1, 2)])
    trees = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 2, 1), (0, 1, 3, 2)], "run int, v long, d int, parent long")
    roots = spark.createDataFrame([(0, 0)], "run int, source long")
    assert validate.errors_by_run(trees, arcs, roots).first().errors > 0


def test_sorted_remap_is_the_remap_of_sorted_edges(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(60)], EDGES)
    want = etl.remap_table(prefix(edges, ["src", "dst"]).withColumnRenamed("position", "pos"))
    assert sorted(map(tuple, etl.remap_sorted(edges).collect())) == sorted(map(tuple, want.collect()))
