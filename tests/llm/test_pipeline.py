"""The pipeline against a plain version of its stages, and what it must keep and drop."""

from collections import Counter

import pytest

import corpus_pipeline
from loomgraph.llm import mixing, ordinal_quality, registry, tokens

from .helpers import docs, sentence, words
from .test_operators import near_copies, plain_components, plain_ids, rated


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good and bad documents with ratings, exact and near copies."""
    base = tmp_path_factory.mktemp("sf")
    good = [(i, sentence(i, 60), "abc"[i % 3]) for i in range(150)]
    bad = [(1000 + i, " ".join(f"{w}%%%" for w in sentence(i, 40).split()), "a") for i in range(60)]
    copies = [(2000 + i, t.upper(), "c") for i, t, _ in good[:10]]
    rows = good + bad + copies + [(3000 + i, t, "b") for i, t, _ in near_copies(30, 3)]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{base}/documents.parquet")
    marks = [(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"file://{base}/labels.parquet")
    return f"file://{base}", rows


def test_stages(spark, tables):
    sf_dir, rows = tables
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs_.columns
    held, found = list(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, sf_dir).cache()
        found[name] = docs_.collect()
        if name != "pack":
            assert docs_.columns == names
    model = ordinal_quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), ordinal_quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")), grade_col="grade")
    assert model.grades == [0, 2]
    held = [r for r in held if not 1000 <= r[0] < 2000]
    assert {r.doc_id for r in found["quality"]} == {i for i, _, _ in held}
    last = {}
    for r in held:
        last[r[1].lower()] = max(r, last.get(r[1].lower(), r))
    held = sorted(last.values())
    assert sorted(r.doc_id for r in found["exact_dedup"]) == [r[0] for r in held]
    tops = {c for _, _, c in plain_components(held, 5, 80, 100)}
    held = [r for r in held if r[0] in tops]
    assert sorted(r.doc_id for r in found["near_dedup"]) == [r[0] for r in held]
    sizes, taken = Counter(), Counter()
    for _, t, s in held:
        sizes[s] += len(words(t))
    for r in found["mix"]:
        taken[r.source] += len(words(r.text))
    order = sorted(sizes)
    goals = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert all(abs(taken[s] - g) <= 40 for s, g in zip(order, goals, strict=True))
    assert max(Counter(r.doc_id for r in found["mix"]).values()) <= 2
    library = tokens.Encoder(tokens.default_path()).library
    length = Counter()
    for r in found["pack"]:
        length[r.doc_id] += r.length
    assert length == sum((Counter({r.doc_id: len(plain_ids(library, r.text)) + 1}) for r in found["mix"]), Counter())


def test_run_applies_every_stage(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_a_query_for_every_operator():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"op3_ordinal_quality", "op4_toxic_crf", "op7_packing", "op9_mixing", "op10_token_store"}


def test_rated_documents_are_used(spark):
    assert len(rated(spark, 30)[2]) == 30
