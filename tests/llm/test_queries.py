"""The ten queries on the smallest tables: against their SQL, or against what the tables and the tokenizer say."""

import os
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import mixing, registry, tokens

from .helpers import held_out, words
from .test_operators import crc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def documents(con):
    return {i: (t, s) for i, t, s in con.sql("SELECT doc_id, text, source FROM documents").fetchall()}


@pytest.fixture(scope="module")
def ids(documents):
    library = Tokenizer.from_file(tokens.default_path())
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, (t, _) in documents.items()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == Counter(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op3_ordinal_quality", "op4_toxic_crf"])
def test_every_document_is_scored(spark, documents, name):
    found = registry.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(documents)
    for r in found:
        assert r.held_out == held_out(r.doc_id)
        score = r.score if "score" in r.asDict() else r.tail_probability
        assert 0 <= score <= 1
        assert (r.predicted == 1 if "score" in r.asDict() else r.kept) == (score >= 0.5)
        for span in r.asDict().get("spans", []):
            assert re.fullmatch(r"\S+", documents[r.doc_id][0][span.start : span.end])


def test_packing_query(spark, ids):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in registry.QUERIES["op7_packing"](spark, SF).collect():
        own = [*ids[r.doc_id], 1]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == crc(own[r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for found, total in [*((pieces[i], len(ids[i]) + 1) for i in ids), *((p, None) for p in places.values())]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 2048


def test_token_store_query(spark, ids):
    found = sorted(map(tuple, registry.QUERIES["op10_token_store"](spark, SF).collect()))
    at, want = 0, []
    for i in sorted(ids):
        want.append((i, at, len(ids[i]) + 1, crc([*ids[i], 2])))
        at += len(ids[i]) + 1
    assert found == want


def test_mixing_query(spark, documents):
    found = registry.QUERIES["op9_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(documents)
    sizes, taken = Counter(), Counter()
    for t, s in documents.values():
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    for r in found:
        text, source = documents[r.doc_id]
        assert r["size"] == len(words(text))
        assert (r.source_size, r.target) == (sizes[source], pytest.approx(float(goals[source])))
        assert r.taken == r["size"] * len(r.shards) <= 2 * r["size"]
        taken[source] += r.taken
    longest = max(len(words(t)) for t, _ in documents.values())
    assert all(abs(taken[s] - goals[s]) <= min(longest, 0.05 * goals[s] + 10) for s in names)
