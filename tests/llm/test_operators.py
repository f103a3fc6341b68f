import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, features, jaccard_join, mixing, packing, quality_rules, range_coder, shards, substring_dedup, token_store, tokens, toxic_crf, warc
from loomgraph.llm import ordinal_quality as oq
from loomgraph.llm import textscan as ts
from loomgraph.session import scratch

from .helpers import awkward, docs, held_out, lower, sentence, thue_morse, words


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def table(spark, rows):
    return docs(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def library():
    return tokens.Encoder(tokens.default_path()).library


def plain_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Quality rules


def plain_rules(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


def test_rules_on_awkward_rows(table, rows, empty):
    found = Counter(tuple(r) for r in quality_rules.measurements(table).select("doc_id", *quality_rules.MEASURES).collect())
    assert found == Counter((i, *plain_rules(t)) for i, t, _ in rows)
    assert quality_rules.ledger(empty).count() == 0


def test_ablations_are_those_of_a_recount(table):
    led = quality_rules.ledger(table).cache()
    bits = [r.fail_bits for r in led.collect()]
    of = quality_rules.mask("v1")
    for r in quality_rules.ablations(led, "v1").collect():
        bit = 1 << list(quality_rules.RULES).index(r.rule)
        own = [b & of for b in bits]
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit > 0 for b in own), sum(b == bit for b in own), sum(b & ~bit == 0 for b in own))
    assert quality_rules.failing_anywhere(led).first().any_bits & 1


# Exact dedup


def check_groups(found, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    assert len(found) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in found:
        ids = by_text[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup(table, rows, empty):
    check_groups(exact_dedup.exact_dedup(table).collect(), rows)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.deduplicated(table)
    assert kept.columns == table.columns
    assert Counter(lower(r.text) for r in kept.collect()) == Counter({lower(t) for _, t, _ in rows})


def test_one_row_of_each_group_stays(spark, monkeypatch):
    rows = [(12, "Dup row", "b"), (12, "dup row", "a"), (13, None, "x"), (13, "", "x"), (11, "dup ROW", "z"), (None, "only null", "n"), (None, "ONLY null", "m")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, _sha_own int").toDF("doc_id", "text", "own_sha", "stay_id")
    for hot in (2000, 0):  # 0: every class is broadcast
        monkeypatch.setattr(exact_dedup, "LEAST_HOT", hot)
        kept = exact_dedup.deduplicated(df.repartition(3))
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(12, "Dup row", "b", 1), (13, "", "x", 1), (None, "ONLY null", "m", 1)], key=str)
        check_groups(exact_dedup.exact_dedup(df).collect(), rows)


def test_exact_dedup_compares_contents_where_digests_agree(spark):
    pairs = [(i, t, None) for i, t in enumerate(["aa", "bb", "AA", "c", "bb", "dd"])]
    weak = lambda c: F.length(c).cast("string")
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, pairs), digest=weak).collect()}
    assert found == {0: (2, 2, False), 2: (2, 2, True), 1: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 3: (3, 1, True)}


# Jaccard join


def shingle_set(text, k):
    w = words(lower(text))
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain_components(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t, _ in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (x, _, _) in enumerate(rows):
        k_ = find(i)
        least[k_] = min((y for y in (least.get(k_), x) if y is not None), default=None)
    return [(rows[i][0], len(s), least[find(i)]) for i, s in enumerate(sets)]


def near_copies(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = sentence(i % 7, 60 + i % 3).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((100 + i, " ".join(w), "a"))
    return out


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, rows, k, num):
    every = rows + near_copies(60, k)
    found = jaccard_join.jaccard_join(docs(spark, every), k, num).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == Counter(plain_components(every, k, num, 100))


def test_one_of_each_component(spark, empty):
    every = near_copies(40, 1) + [(1, None, None), (2, "", None), (3, "   ", None)]
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(docs(spark, every)).collect())
    assert kept == sorted({c for _, n, c in plain_components(every, 5, 80, 100)})
    assert jaccard_join.one_of_each(empty).columns == empty.columns
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_prefixes_of_linked_sets_meet_under_every_order():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.sort(np.concatenate([a[: int(n * 0.95)], rng.integers(0, 2**63, max(1, n // 20)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        for order in range(3):
            parts = [jaccard_join._prefix(x, (x % np.uint64(7)).astype(np.uint8), order, jaccard_join.prefix_length(len(x), 85, 100)) for x in (a, b)]
            assert len(np.intersect1d(*parts))


# Substring dedup


def plain_removed(rows, size):
    starts = {}
    for i, t, _ in rows:
        w = words(t)
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            k = 2**63 - 1 if i is None else i
            starts[key] = min(k, starts.get(key, k))
    out = []
    for i, t, _ in rows:
        w, gone = words(t), set()
        for j in range(len(w) - size + 1):
            if starts[tuple(w[j : j + size])] < (2**63 - 1 if i is None else i):
                gone.update(range(j, j + size))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("options", [{}, {"bucket": 50, "level_bits": 3}])
def test_substring_dedup(spark, rows, options):
    shared = sentence(50, 20)
    every = rows + [(200 + i, f"{sentence(60 + i, 9)} {shared} {sentence(80 + i, 5 + i)}", "a") for i in range(8)]
    found = substring_dedup.substring_dedup(docs(spark, every).repartition(3), **options).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, found)) == Counter(plain_removed(every, 13))


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_blobs_hold_entries():
    k1, k2, pos = np.array([-3, 9]), np.array([1, 2]), np.array([70_000, 0], np.int32)
    h, check = np.array([7, 5], np.uint64), np.array([3, 2**32 - 1], np.uint32)
    assert [x.tolist() for x in substring_dedup._unpacked(*substring_dedup._packed(k1, k2, pos, h, check))] == [x.tolist() for x in (k1, k2, pos, h, check)]
    assert [x.tolist() for x in substring_dedup._unpacked(*substring_dedup._packed(k1, k2, pos))] == [x.tolist() for x in (k1, k2, pos)]


def test_windows_of_one_hash_are_told_apart():
    h, check = np.array([5, 5, 5, 1], np.uint64), np.array([2, 1, 2, 9], np.uint32)
    order, first = substring_dedup._grouped(h, check)
    assert order.tolist() == [3, 1, 0, 2]
    assert first.tolist() == [True, True, True, False]


# Tokens, packing and files


def test_encoder_gives_the_library_ids(library, rows):
    import pyarrow as pa

    odd = ["a  b", "\n x", " lead", "trail ", "a \n b", "x\x1c y  z", "", "   ", "don't  's 're", "a\t b \t c", "é  ñ\r\n  q", "…. x÷. é. ×!", "a　 \nb\n\nc  d  e", "it's. I'll've 5th. x5.y", "日本 語。\n中", "a\x85b \x85c \x1cd\n\x1ce", "ß.\n x   y", "<|endoftext|> x"]
    rng = random.Random(3)
    odd += ["".join(rng.choice(" \n\t.,'aéZ9日  ß-$") for _ in range(40)) for _ in range(300)]
    texts = odd + [t for _, t, _ in rows]
    enc = tokens.Encoder(tokens.default_path(), entries=100)
    enc.library.encode_special_tokens = True
    library.encode_special_tokens = True
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(pa.array(texts))] == [plain_ids(library, t) for t in texts]


def test_packing_places_every_id_once(table, rows, empty, library):
    found = packing.packed(table, capacity=256, block=4, grain=16).collect()
    lengths = Counter((i, len(plain_ids(library, t)) + 1) for i, t, _ in rows)
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i, len(plain_ids(library, t)) + 1].append([*plain_ids(library, t), 1])
    for (i, n), copies in lengths.items():
        own = sorted((r for r in found if (r.doc_id, r.doc_tokens) == (i, n)), key=lambda r: r.start)
        assert sum(r.length for r in own) == n * copies
        for r in own:
            assert r.ids_crc32 in {crc(ids[r.start : r.start + r.length]) for ids in want[i, n]}
        assert Counter(k for r in own for k in range(r.start, r.start + r.length)) == Counter({k: copies for k in range(n)})
    for seq in {r.sequence_id for r in found}:
        at = 0
        for r in sorted((r for r in found if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.packed(empty).count() == 0


def test_differencing_levels_windows():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 2048) for _ in range(200)] + [rng.randrange(1, 128) for _ in range(200)]
    found = packing.windows(sizes, 2048)
    assert sorted(i for w in found for i in w) == list(range(400))
    loads = [sum(sizes[i] for i in w) for w in found]
    assert max(loads) <= 2048
    assert len(found) <= -(-sum(sizes) // 2048) + 1
    assert packing.windows([2048] * 3, 2048) == [[0], [1], [2]] or len(packing.windows([2048] * 3, 2048)) == 3
    assert len(packing.windows([1500, 1500, 1000], 2048)) == 3


@pytest.mark.parametrize("n", [1, 5, 4096, 9001])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, (3, n)), 50256)
    ids[1] = 7
    ids[2] = rng.integers(0, 50257, n)
    codes = range_coder.encoded(ids, 50257)
    assert (range_coder.decoded(codes, n, 50257) == ids).all()
    assert n < 100 or len(codes[1]) < n / 2
    assert range_coder.encoded(ids[1:2], 50257)[0] == codes[1]


def test_order_0_is_the_files():
    """Ids far apart in the vocabulary cost what their counts tell, in each block."""
    rng = np.random.default_rng(5)
    some = rng.choice(50257, 300, replace=False)
    ids = rng.choice(some, 100_000).astype("<u4")
    raw = token_store.to_bytes([1], [ids.tobytes()])
    assert len(raw) * 8 / len(ids) < np.log2(300) + 2  # two bits for predictions, which are wrong
    assert (token_store.from_bytes(raw)[2] == ids).all()


@pytest.mark.parametrize("n", [1, 4095, 4096, 4097, 9000])
def test_last_block_goes_with_the_others(monkeypatch, n):
    calls, coded = [], range_coder.encoded
    monkeypatch.setattr(range_coder, "encoded", lambda blocks, *a: calls.append(blocks.shape) or coded(blocks, *a))
    ids = np.random.default_rng(n).integers(0, 50257, n).astype("<u4")
    raw = token_store.to_bytes([1, 2], [ids[: n // 3].tobytes(), ids[n // 3 :].tobytes()])
    assert calls == [(-(-n // 4096), min(n, 4096))]
    monkeypatch.undo()
    _, lengths, every = token_store.from_bytes(raw)
    assert lengths.tolist() == [n // 3, n - n // 3]
    assert (every == ids).all()


def test_range_coder_at_its_narrowest():
    """The rarest of many ids again and again, where both predictions are sure and wrong."""
    weights = np.ones(50257)
    weights[:100] = 1e9
    shares = range_coder.shares_of(weights)
    assert shares.sum() == 1 << 17
    assert shares.min() == 1
    sure = np.tile([5, 6, 7], 300)
    rare = np.arange(40_000, 40_300)
    ids = np.stack([np.insert(sure, np.arange(0, 900, 3), rare), np.append(sure, rare), np.append(rare, sure), np.repeat(rare, 4)])
    for lanes in (ids, ids[2:3]):
        codes = range_coder.encoded(lanes, 50257, shares)
        assert (range_coder.decoded(codes, 1200, 50257, shares) == lanes).all()
    assert not range_coder.shares_of(np.zeros(9)).any()
    with pytest.raises(ValueError, match="more than"):
        range_coder.shares_of(np.ones(70_000))


def test_token_files(spark, table, rows, empty, library):
    folder = scratch(spark, "tokens-test")
    found = token_store.read(token_store.write(table, folder, shard_bytes=2000)).collect()
    at, want = 0, []
    for i, ids in sorted(((i, [*plain_ids(library, t), 2]) for i, t, _ in rows), key=lambda x: (x[0] is None, x[0] or 0)):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    loose = lambda rs: Counter((i, n, c) for i, _, n, c in rs)  # noqa: E731  rows of one id have no order
    assert loose(map(tuple, found)) == loose(want)
    assert sorted(r.start for r in found) == sorted(np.cumsum([0, *(r.n_tokens for r in sorted(found, key=lambda r: r.start))])[:-1].tolist())
    assert [i for _, i in sorted((r.start, r.doc_id) for r in found if r.doc_id is not None)] == sorted(i for i, _, _ in rows if i is not None)
    assert token_store.read(token_store.write(empty, scratch(spark, "tokens-none"))).count() == 0


def test_token_file_checksums():
    raw = bytearray(token_store.to_bytes([3, None], [np.arange(5000, dtype="<u4").tobytes(), b""]))
    ids, lengths, every = token_store.from_bytes(bytes(raw))
    assert ids == [3, None]
    assert lengths.tolist() == [5000, 0]
    assert every.tolist() == list(range(5000))
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_store.from_bytes(bytes(raw))
    assert token_store.from_bytes(token_store.to_bytes([], []))[0] == []


# WARC


def test_warc_round_trip(spark):
    big, other = "<p>" + "x" * 200 + "</p>", "é" * 60
    pages = [(5, "u5", big), (3, "u3", big), (9, None, big), (1, "u\r\n1", "small"), (2, "u2", "small"), (4, "u4", None), (6, "u6", ""), (7, "u7", other), (8, "u8", other), (8, "u8", other), (None, "n", big)]
    kinds = "page_id long, url string, html string, digest string, mark int"
    folder = scratch(spark, "warc-test")
    df = spark.createDataFrame([(*p, "d", 1) for p in pages], kinds).repartition(3)
    listed = warc.write(df, folder, shard_bytes=700, roll_bytes=300)
    found = warc.read(listed).collect()
    assert len(found) == len(pages)
    least = {big: 3, other: 7}
    for page, url, html in pages:
        body = (html or "").encode()
        own = [r for r in found if r.page_id == page and r.payload_digest == hashlib.sha256(body).hexdigest()]
        assert own
        assert all(r.payload_bytes == len(body) for r in own)
        if len(body) < 100 or page == least[html]:
            assert {(r.record_type, r.refers_to) for r in own} == {("response", None)}
        else:
            assert {(r.record_type, r.refers_to) for r in own} == {("revisit", least[html])}
    assert listed.count() > 2
    again = warc.write(df.repartition(1), scratch(spark, "warc-test"), shard_bytes=700, roll_bytes=300)
    assert sorted((r.shard, r.roll, r.sha256) for r in listed.collect()) == sorted((r.shard, r.roll, r.sha256) for r in again.collect())
    none = spark.createDataFrame([], kinds)
    assert warc.read(warc.write(none, scratch(spark, "warc-none"))).count() == 0


def test_shard_cuts_depend_on_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(shards, "LEAST_RANGES", 5)
    keys = [0] * 30 + list(range(1, 200)) + [10**15 + i for i in range(300)] + [2**62, -(2**63), -1]
    rows = [(k, i % 2 if k == 0 else 0) for i, k in enumerate(keys)]
    df = spark.createDataFrame([(k, t, 10) for k, t in rows], "key long, tie long, weight long")
    firsts = shards.cuts(df, 200)
    assert firsts.tolist() == shards.cuts(df.repartition(7), 200).tolist() == sorted(firsts.tolist())
    placed = shards.sharded(df, firsts).withColumn("p", F.spark_partition_id()).cache()
    loads = Counter(r.shard for r in placed.collect())
    assert max(loads.values()) <= 20  # the 30 rows of key 0 are cut by their ties
    assert set(loads) == set(range(len(firsts) + 1))
    assert len(loads) <= 1.5 * len(rows) / 20
    assert placed.groupBy("shard").agg(F.countDistinct("p").alias("n")).where("n > 1").isEmpty()
    spans = sorted((r.a, r.z, r.shard) for r in placed.groupBy("shard").agg(F.min(F.struct("key", "tie")).alias("a"), F.max(F.struct("key", "tie")).alias("z")).collect())
    assert [s for *_, s in spans] == sorted(loads)
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_shards_of_nothing_and_of_one_row(spark):
    kinds = "key long, tie long, weight long"
    assert len(shards.cuts(spark.createDataFrame([], kinds), 10)) == 0
    assert len(shards.cuts(spark.createDataFrame([(1, 1, 50)], kinds), 10)) == 0
    assert len(shards.cuts(spark.createDataFrame([(1, 1, 50)] * 40 + [(1, 2, 50)], kinds), 10)) == 1


def test_rows_without_id_are_dealt_to_many_shards(spark, library):
    rows = [(None, sentence(i, 40), "a") for i in range(60)] + [(None, "same text", "a")] * 200 + [(2**63 - 1, sentence(99, 40), "a"), (3, sentence(98, 40), "a")]
    df = docs(spark, rows).repartition(5)
    listed = token_store.write(df, scratch(spark, "tokens-null"), shard_bytes=1500)
    found = sorted(token_store.read(listed).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [3, 2**63 - 1, *[None] * 260]
    plain = {t: [*plain_ids(library, t), 2] for _, t, _ in rows}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(plain[t]), crc(plain[t])) for i, t, _ in rows)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    shapes = [(r.shard, r.roll, r.n_ids) for r in listed.collect()]
    assert len({s for s, *_ in shapes}) > 10
    assert max(n for *_, n in shapes) <= 1500
    assert max(r for _, r, _ in shapes) > 0 or 200 * len(plain["same text"]) <= 1500



# Mixing


def test_mixing_targets_reshare_what_is_over():
    assert [float(x) for x in mixing.targets([10, 100, 100], [5, 2, 1])] == [20, 590 / 3, 295 / 3]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]
    assert sum(mixing.targets([7, 90, 11, 40], [5, 2, 1, 5])) == 222


@pytest.mark.parametrize("last", [256, 4])
def test_mixing(spark, empty, monkeypatch, last):
    monkeypatch.setattr(mixing, "LAST_ROWS", last)  # 4: blocks are split further
    monkeypatch.setattr(mixing, "DOCS_A_BLOCK", 64 if last > 4 else 5)
    rng = random.Random(9)
    rows = [(i, sentence(i, rng.randrange(1, 60)), rng.choice(["a", "b", "é", "z", None])) for i in range(400)] + [(900, None, "a"), (901, "", "q"), (None, "x y", "a"), (3, "x y", "a"), (3, "x y", "a")]
    df = docs(spark, rows)
    found = mixing.mix_plan(df, shards=8).collect()
    assert len(found) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    for r in found:
        assert r.source_size == sizes[r.mix_source]
        assert r.target == pytest.approx(float(goals[r.mix_source]))
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        assert len(r.shards) == len(r.orders) == r.copies
        taken[r.mix_source] += r.taken
    assert all(abs(taken[s] - goals[s]) <= (1 if last > 4 else 30) for s in names)
    assert len({s for r in found for s in r.shards}) == 8
    again = mixing.mix_plan(df.repartition(5), shards=8).collect()
    key = lambda r: (r.doc_id, r.text_hash, r.taken, tuple(r.shards), tuple(r.orders))
    assert Counter(map(key, found)) == Counter(map(key, again))
    # the mix deals each document to the shards of its draws, in the order of the plan
    mix = mixing.mixed(df, shards=8)
    assert mix.columns == [*df.columns, "mix_shard", "mix_order"]
    assert Counter((r.doc_id, r.mix_shard, r.mix_order) for r in mix.collect()) == Counter((r.doc_id, s, o) for r in found for s, o in zip(r.shards, r.orders, strict=True))
    assert {tuple(r.shards) for r in found} != {tuple(r.shards) for r in mixing.mix_plan(df, shards=3).collect()}
    assert mixing.mix_plan(empty).count() == 0
    assert mixing.mixed(empty).count() == 0


def test_leaves_draw_disjoint_blocks_of_exact_quotas(spark):
    df = docs(spark, [(i, sentence(i, 5 + i % 40), "abc"[i % 3]) for i in range(900)])
    draws = mixing.Draws(df, "doc_id", "text", "source", *mixing._options(shards=5))
    marks = draws.marks.collect()
    for s in range(draws.n):
        per_shard = Counter(p for m in marks if m.of == s for p in m.places)
        assert [per_shard[i] for i in range(5)] == draws.quota[:, s].tolist()
        copies = {len(m.places) for m in marks if m.of == s}
        assert max(copies) - min(copies) <= 1


def test_nearest_subset_is_that_of_all_subsets():
    rng = random.Random(1)
    for _ in range(300):
        sizes, goal = [rng.randrange(0, 30) for _ in range(rng.randrange(0, 6))], rng.randrange(0, 100)
        counts = [rng.randrange(1, 4) for _ in sizes]
        got = mixing.nearest_subset(sizes, counts, goal)
        assert all(0 <= k <= n for k, n in zip(got, counts, strict=True))
        every = [sum(k * s for k, s in zip(ks, sizes, strict=True)) for ks in np.ndindex(*(n + 1 for n in counts))] if sizes else [0]
        assert abs(goal - sum(k * s for k, s in zip(got, sizes, strict=True))) == min(abs(goal - x) for x in every)
    assert mixing.nearest_subset([3], [10**9], 10**9)[0] in (333333333, 333333334)


def test_splitting_tree_keeps_quotas():
    out = mixing.split_quotas([100, 37, 0, 5], 7, 1)
    assert out.sum(axis=0).tolist() == [100, 37, 0, 5]
    assert max(out.sum(axis=1)) - min(out.sum(axis=1)) <= 2
    assert (out == mixing.split_quotas([100, 37, 0, 5], 7, 1)).all()


# Classifiers


def rated(spark, n=400):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        grade, toxic = i % 3, int(rng.random() < 0.3)
        w = sentence(i, 40).split() + [f"good{rng.randrange(5)}"] * (6 * grade)
        if toxic:
            w += [rng.choice(["Vile,", "awful.", "nasty"]) for _ in range(3)]
        rng.shuffle(w)
        rows.append((i, " ".join(w), "a"))
        marks.append((i, grade, toxic))
    return docs(spark, rows), spark.createDataFrame([*marks, (0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), marks


def test_ordinal_grades(spark, table, rows, empty):
    df, labels, marks = rated(spark)
    model = oq.train(df, labels)
    assert model.grades == [0, 1, 2]
    assert list(model.thresholds) == sorted(model.thresholds)
    found = {r.doc_id: r for r in oq.graded(df, model, cut=2).collect()}
    off = [abs(found[i].expected_grade - g) for i, g, _ in marks if held_out(i)]
    assert sum(off) / len(off) < 0.35
    assert sum((found[i].tail_probability >= 0.5) == (g == 2) for i, g, _ in marks if held_out(i)) > 0.9 * len(off)
    assert oq.graded(table, model).count() == len(rows)
    kept = oq.selected(table, model)
    assert kept.columns == table.columns
    want = Counter(r.doc_id for r in oq.graded(table, model).collect() if r.tail_probability >= 0.5)
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert oq.graded(empty, model).count() == 0
    none = oq.train(df, labels.limit(0))
    assert all(r.tail_probability == 1 for r in oq.graded(table, none).collect())


def test_toxic_spans(spark, table, rows, empty):
    df, labels, marks = rated(spark, 900)
    field = toxic_crf.train(df, labels)
    found = {r.doc_id: r for r in toxic_crf.tagged(df, field).collect()}
    held = [(i, y) for i, _, y in marks if held_out(i)]
    assert sum((found[i].score >= 0.5) == bool(y) for i, y in held) > 0.97 * len(held)
    texts = {r.doc_id: r.text for r in df.collect()}
    spans = [texts[i][s.start : s.end].lower() for i, _, y in marks if y for s in found[i].spans]
    assert set(spans) == {"vile", "awful", "nasty"}
    scored = toxic_crf.tagged(table, field).collect()
    assert len(scored) == len(rows)
    assert all(0 <= r.score <= 1 for r in scored)
    assert toxic_crf.tagged(empty, field).count() == 0
    assert toxic_crf.train(df, labels.where("toxic = 0")) is None
    assert {r.score for r in toxic_crf.tagged(table, None).collect()} == {0.0}


@pytest.mark.parametrize("block", [512, 2, 1])
def test_marginals_are_those_of_all_taggings(monkeypatch, block):
    monkeypatch.setattr(toxic_crf, "BLOCK", block)  # 2, 1: rows of several blocks
    rng = np.random.default_rng(1)
    field = toxic_crf.Field(rng.normal(size=toxic_crf.WIDTH), rng.normal(size=(2, 2)), np.zeros(3))
    n = np.array([3, 0, 5, 1, 8, 2])
    kinds = rng.integers(0, toxic_crf.WIDTH, (2, int(n.sum())))
    got = field.marginals(kinds, n)
    at = 0
    for k in n:
        e = field.weights[kinds[:, at : at + k]].sum(axis=0)
        total, on = 0.0, np.zeros(k)
        for tags in np.ndindex(*(2,) * int(k)) if k else ():
            p = np.exp(sum(e[i] for i in range(k) if tags[i]) + sum(field.moves[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += p
            on += p * np.array(tags)
        assert np.allclose(got[at : at + k], on / total if k else [])
        at += k


def test_a_field_is_fitted_to_few_labels():
    clean = [sentence(i, 12) for i in range(20)]
    assert toxic_crf.fit([*clean, "some vile thing", "vile"], [0] * 20 + [1, 1]) is not None
    assert toxic_crf.fit([*clean, "", "  "], [0] * 20 + [1, 1]) is None
    assert toxic_crf.fit([], []) is None
    assert toxic_crf._features(clean, 30)[3] == 20  # a chunk at least


def plain_grade(text, model):
    """Score of a text one word at a time."""
    data = (text or "").encode()
    total, w, last = 0.0, data.split(), None
    for x in w:
        one = np.frombuffer(x, np.uint8)
        _, found = features.indices(one, np.array([0, len(one)]))
        total += model.weights[found[:3, 0]].sum() + model.weights[features.SIZE - 2 + (x == last)]
        last = x
    score = total / max(len(w), 1)
    tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
    return model.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, model.grades, model.grades[1:], strict=False)), tails[0]


def test_grades_are_those_of_a_plain_computation(spark, table, rows):
    df, labels, _ = rated(spark)
    model = oq.train(df, labels)
    found = Counter((r.doc_id, round(r.expected_grade, 8), round(r.tail_probability, 8)) for r in oq.graded(table, model).collect())
    assert found == Counter((i, *(round(float(x), 8) for x in plain_grade(t, model))) for i, t, _ in rows)


def test_ordinal_fit_descends_the_likelihood(monkeypatch):
    """One step of plain gradient from the fit's start goes where differences of the likelihood point."""
    rng = np.random.default_rng(3)
    n, k = 60, 6
    monkeypatch.setattr(features, "SIZE", k)
    x, grade = rng.normal(size=(n, k)), rng.integers(0, 4, n)
    row, index = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    model = oq.fit(row, index, x.ravel(), grade, steps=3000, rate=0.02, decay=0.0)
    assert list(model.thresholds) == sorted(model.thresholds)

    def loss(w, cuts):
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        s = x @ w
        return -np.mean(np.log(oq.sigmoid(edges[grade + 1] - s) - oq.sigmoid(edges[grade] - s)))

    at = np.concatenate((model.weights, model.thresholds))
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-4
        up, down = (loss((at + d)[:k], (at + d)[k:]) for d in (step, -step))
        assert abs(up - down) / 2e-4 < 2e-3


def test_grades_of_labels(spark):
    rows = [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, None), (6, None, 1)]
    found = {r.doc_id: r.grade for r in oq.grades(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert found == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: None}


# Hashes


def test_hashes_of_spans():
    for n in (8, 9, 16, 1024, 4096):
        x, y = (w.encode() for w in thue_morse(n))
        data = np.frombuffer(x + b" " + y + b"  " + x, np.uint8)
        start, end, _ = ts.words(data, np.array([0, len(data)]))
        for got in (ts.span_hashes(data, start, end), ts.span_hashes(data, start, end, salt=1), ts.identities(data, start, end)):
            assert got[0] == got[2] != got[1]
    rng = random.Random(1)
    spans = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    data = np.frombuffer(" ".join(spans).encode(), np.uint8)
    start, end, _ = ts.words(data, np.array([0, len(data)]))
    assert len(set(zip(spans, ts.span_hashes(data, start, end).tolist(), strict=True))) == len(set(spans))


def test_bytes_decide_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(ts, "span_hashes", lambda data, start, end, salt=0: (end - start).astype(np.uint64))
    spans = ["aa", "bb", "aa", "c", "bb", "long enough"[:9], "long enoogh"[:9], "x" * 20, "x" * 19 + "y", "x" * 20]
    spans = [s.replace(" ", "_") for s in spans]
    data = np.frombuffer(" ".join(spans).encode(), np.uint8)
    start, end, _ = ts.words(data, np.array([0, len(data)]))
    got = ts.identities(data, start, end).tolist()
    assert len(set(got)) == len(set(spans)) == len(set(zip(spans, got, strict=True)))


def test_entries_of_the_coder_follow_their_rule():
    """Confidence up after a hit, halved after a miss; an id is replaced after a miss below confidence 4."""
    model = range_coder._Model(1, 50_257)
    for id_ in (0, 7, 1023, 1024, 8191, 8192, 50_256):
        k = int(model.classes[id_])
        assert model.start[k] <= id_ < model.start[k] + (1 << int(model.shift[k]))
    for conf in range(16):
        for known in (9, 12):
            model.one[5], model.two[5] = known << 4 | conf, 0
            model.shares(np.array([5]), np.array([5]))
            model.learn(np.array([9], np.uint32), np.array([1]), np.array([False]), np.array([known == 9]))
            want = (9, min(conf + 1, 15)) if known == 9 else (12, conf >> 1) if conf >= 4 else (9, 1)
            assert (model.one[5] >> 4, model.one[5] & 15) == want
            assert model.two[5] == 9 << 4 | 1
