"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Words are labelled from document labels: a word that marks toxic documents (by frequency and log-likelihood ratio,
copies of a document counting once) is toxic where it stands in a toxic document. The field has two states; a word's emission is the sum of hashed features of itself, its neighbours, its
beginning, its ending and its shape. It is fitted on windows around toxic words and on windows of other text, by gradients from
forward-backward marginals.

Forward-backward runs over whole documents, all documents of a batch in lockstep, on the ratio of the two states.
A document's score is a logistic function of its largest marginal and of the sum of the marginals, fitted on the
training documents; words with a marginal of at least a half are its spans.

Only the fit is bounded, by parameters: at most ``sample`` toxic and twice as many other labels, chosen by a hash of
the id; of their documents, at most ``6 * sample`` rows of at most ``longest`` bytes, in the order of
a hash of the text (more rows than labels only where ids repeat), and of these, in that order, as many as hold about
``most_words`` words; ``centres`` tagged and as many other words, drawn at random from all of these, for windows.
Features come from the text alone. A word marks toxic documents by the bounds of ``marking_words``; where no word
passes them, the words of the highest ratios do, so that there is always a field to fit.

A document's score takes its words in blocks of ``BLOCK``: forward-backward runs over all blocks in lockstep, and the
blocks' 2 x 2 products carry the state from one to the next, so a long text takes no more steps than a short one.

Defined results: null labels are none; of several labels of one id the highest counts; null and empty texts have the
score of a text without toxic words; without labels of both kinds, or without a word in them, every score is 0; rows
are scored one by one, whatever their ids; texts of any length are scored whole, each by one task; an empty table
gives an empty result; further columns may have any names and are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import textscan as ts
from loomgraph.llm.ordinal_quality import held_out, sigmoid
from loomgraph.session import ship

SAMPLE = 1500
LONGEST = 65_536
SEED = 31
BITS = 14
REACH = 8
CENTRES = 6000
MOST_WORDS = 6_000_000
BLOCK = 512
BATCH = 4 << 20
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SLICE = 1 << BITS
WIDTH = 5 * _SLICE + 8


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the punctuation at their ends; spans of punctuation alone stay."""
    at = np.flatnonzero(_ALNUM[data])
    if not len(at):
        return start, end
    i, j = np.searchsorted(at, start), np.searchsorted(at, end) - 1
    some = i <= j
    return np.where(some, at[np.minimum(i, len(at) - 1)], start), np.where(some, at[np.maximum(j, 0)] + 1, end)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, hash, start, end and features (one column a kind) of every word."""
    start, end, row = ts.words(data, offs)
    low = ts.lowered(data)
    a, b = stripped(data, start, end)
    h = ts.span_hashes(low, a, b)
    own = (h >> np.uint64(64 - BITS)).astype(np.int64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = row[1:] == row[:-1]
        before[1:] = np.where(same, own[:-1], 0)
        after[:-1] = np.where(same, own[1:], 0)
    ending, opening = ts.span_hashes(low, np.maximum(a, b - 3), b), ts.span_hashes(low, a, np.minimum(b, a + 6))
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    caps = np.minimum(upper[b] - upper[a], 2) + 3 * ((end - b) > 0)
    parts = [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in (ending, opening)]
    kinds = np.stack([own, _SLICE + before, 2 * _SLICE + after, 3 * _SLICE + parts[0], 4 * _SLICE + parts[1], 5 * _SLICE + caps])
    return row, h, a, b, kinds


class Field:
    """weights of the features for the toxic state, log transition scores [from, to], and the score's coefficients."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, final: np.ndarray) -> None:
        self.weights, self.moves, self.final = weights, moves, final

    def marginals(self, kinds: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(toxic) of every word; n: words of each row, which lie one after the other."""
        lift = np.exp(np.clip(self.weights[kinds].sum(axis=0), -30, 30))
        move = np.exp(self.moves)
        # blocks of at most BLOCK words; a row's blocks lie one after the other
        parts = -(-n // BLOCK)
        row = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(len(row)) - (np.cumsum(parts) - parts)[row]
        first = (np.cumsum(n) - n)[row] + nth * BLOCK
        size = np.minimum(n[row] - nth * BLOCK, BLOCK)
        ahead, back = np.ones(len(row)), np.ones(len(row))  # the two states' ratio before and after each block
        if len(row) and parts.max() > 1:
            whole = _products(lift, move, first, size, nth == 0)
            for k in range(1, int(parts.max())):
                at = np.flatnonzero(nth == k)
                ahead[at] = _through(ahead[at - 1], whole[at - 1])
            last = parts[row] - 1 - nth
            for k in range(1, int(parts.max())):
                at = np.flatnonzero(last == k)
                back[at] = _through(back[at + 1], whole[at + 1].transpose(0, 2, 1))
        return _odds(lift, move, first, size, ahead, nth == 0, back)


def _through(ratio: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """(1, ratio) times a matrix, as a ratio again."""
    return (matrix[:, 0, 1] + ratio * matrix[:, 1, 1]) / (matrix[:, 0, 0] + ratio * matrix[:, 1, 0])


def _steps(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks from the longest down, and for each step how many of them are still running."""
    order = np.argsort(-size, kind="stable")
    longest = int(size.max()) if len(size) else 0
    return order, np.searchsorted(-size[order], -np.arange(longest), "left")


def _products(lift: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Each block's product of moves and emissions, scaled; a block that opens a row has no move before its first word."""
    order, active = _steps(size)
    begin, out = first[order], np.tile(np.eye(2), (len(size), 1, 1))
    for t, k in enumerate(active.tolist()):
        m = out[:k] @ move if t else np.where(opens[order][:k, None, None], out[:k], move)
        m[:, :, 1] *= lift[begin[:k] + t][:, None]
        out[:k] = m / m.sum(axis=(1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out
    return back


def _odds(lift: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray, ahead: np.ndarray, opens: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Marginals of all words. ahead, behind: the ratio that enters a block from either side; opens: blocks with which a row begins."""
    (m00, m01), (m10, m11) = move
    order, active = _steps(size)
    begin, enter, opens, leave = first[order], ahead[order], opens[order], behind[order]
    forward, back = np.empty(len(lift)), np.ones(len(lift))
    r = enter
    for t, k in enumerate(active.tolist()):
        at = begin[:k] + t
        step = (m01 + m11 * r[:k]) / (m00 + m10 * r[:k])
        # both states are as likely before the first word of a row
        r = lift[at] * (np.where(opens[:k], 1.0, step) if t == 0 else step)
        forward[at] = r
    q = leave.copy()  # of each block's last word so far
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        at = begin[:k] + t
        back[at] = q[:k]
        e = q[:k] * lift[at]
        q[:k] = (m10 + m11 * e) / (m00 + m01 * e)
    odds = forward * back
    return odds / (1 + odds)


def _gathered(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Largest marginal and log of one plus the sum of the marginals that stand out, a row each."""
    out = np.zeros((len(n), 2))
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        out[some, 0] = np.maximum.reduceat(p, at)
        out[some, 1] = np.log1p(np.add.reduceat(np.where(p > 0.1, p, 0), at))
    return out


def marking_words(h: np.ndarray, row: np.ndarray, toxic: np.ndarray, odds: float = 20.0, few: int = 16) -> np.ndarray:
    """Hashes of words that mark toxic documents: in three or more of them, over ``odds`` times as frequent there, with a
    log-likelihood ratio that chance gives less than once among all words; if there are none, the ``few`` words of the
    highest ratios.

    toxic: the label of each row; copies are left out before.
    """
    order = np.lexsort((row, h))
    once = np.ones(len(order), bool)
    once[1:] = (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    word, where, total = np.unique(h[order[once]], return_index=True, return_counts=True)
    k = np.add.reduceat(toxic[row[order[once]]].astype(np.int64), where) if len(where) else np.zeros(0, np.int64)
    rows = np.unique(row)
    n1 = int(toxic[rows].sum())
    n0 = len(rows) - n1
    oftener = (k > 0) & (k * n0 > (total - k) * n1)
    word, total, k = word[oftener], total[oftener], k[oftener].astype(float)
    c = total - k
    rate, ratio = (k + c) / max(n0 + n1, 1), np.zeros(len(word))
    for o, x in ((k, n1 * rate), (n1 - k, n1 * (1 - rate)), (c, n0 * rate), (n0 - c, n0 * (1 - rate))):
        some = o > 0
        ratio[some] += 2 * o[some] * np.log(o[some] / x[some])
    passing = (k >= 3) & (k * n0 > odds * c * n1) & (ratio >= 2 * np.log(max(len(where), 1)) + 1)
    return word[passing] if passing.any() else word[np.lexsort((word, -ratio))[:few]]


def _originals(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """False for documents that share a least three-word hash, under either of two orders, with an earlier one."""
    at, value = ts.windows(h, row, 3)
    keep = np.ones(n, bool)
    for salt in (1, 2):
        v = ts.mixed(value + np.uint64(salt))
        order = np.lexsort((v, row[at]))
        first = order[np.append(True, row[at[order[1:]]] != row[at[order[:-1]]])] if len(order) else order
        _, once = np.unique(v[first], return_index=True)
        later = np.ones(len(first), bool)
        later[once] = False
        keep[row[at[first[later]]]] = False
    return keep


def _fitted(kinds: np.ndarray, tags: np.ndarray, valid: np.ndarray, steps: int = 100, rate: float = 0.25, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves from windows: kinds (features, windows, length), tags and which words there are (windows, length)."""
    n, length = tags.shape
    params = [np.zeros(WIDTH), np.array([[1.0, -1.0], [0.0, 0.0]])]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    seen, paired = np.zeros((2, 2)), valid[:, 1:]
    np.add.at(seen, (tags[:, :-1][paired], tags[:, 1:][paired]), 1)
    for t in range(1, steps + 1):
        w, moves = params
        lift = np.exp(np.clip(w[kinds].sum(axis=0), -30, 30))
        m = np.exp(moves)
        ahead, back = np.empty((length, n, 2)), np.empty((length, n, 2))
        a = np.stack([np.ones(n), lift[:, 0]], axis=1)
        for i in range(length):
            if i:
                a = np.where(valid[:, i, None], (a @ m) * np.stack([np.ones(n), lift[:, i]], axis=1), a)
            a /= a.sum(axis=1, keepdims=True)
            ahead[i] = a
        b = np.ones((n, 2))
        for i in range(length - 1, -1, -1):
            if i < length - 1:
                b = np.where(valid[:, i + 1, None], (b * np.stack([np.ones(n), lift[:, i + 1]], axis=1)) @ m.T, b)
            b /= b.sum(axis=1, keepdims=True)
            back[i] = b
        node = ahead * back
        p = (node[..., 1] / node.sum(axis=2)).T
        want = np.zeros((2, 2))
        for i in range(length - 1):
            pair = ahead[i][:, :, None] * m[None] * (back[i + 1] * np.stack([np.ones(n), lift[:, i + 1]], axis=1))[:, None, :]
            want += (pair / pair.sum(axis=(1, 2), keepdims=True))[valid[:, i + 1]].sum(axis=0)
        off = np.broadcast_to((p - tags) * valid / n, kinds.shape)
        grads = [np.bincount(kinds.ravel(), off.ravel(), minlength=WIDTH) + decay * w, (want - seen) / n + decay * moves]
        for q, g, mo in zip(params, grads, moments, strict=True):
            mo[0] += 0.1 * (g - mo[0])
            mo[1] += 0.001 * (g * g - mo[1])
            q -= rate * (mo[0] / (1 - 0.9**t)) / (np.sqrt(mo[1] / (1 - 0.999**t)) + 1e-8)
    return params[0], params[1]


def _features(texts: list[str], most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, hashes and features of the words of the first texts, up to ``most_words``; and how many texts those are."""
    rows, hashes, features, words, done = [], [], [], 0, 0
    for lo, hi, data, offs in ts.chunks(pa.array(texts, pa.string())):
        row, h, _, _, kinds = tokens(data, offs)
        if words + len(h) > most_words and words:
            break
        rows.append(row + lo)
        hashes.append(h)
        features.append(kinds.astype(np.int32))
        words, done = words + len(h), hi
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((6, 0), np.int32), 0
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(features, axis=1), done


def fit(texts: list[str], labels: list[int], centres: int = CENTRES, most_words: int = MOST_WORDS) -> Field | None:
    """None without documents of both kinds that hold words."""
    row, h, kinds, done = _features(texts, most_words)
    labels = labels[:done]
    toxic = np.array(labels, bool)
    if len(set(toxic[np.unique(row)].tolist())) < 2:
        return None
    n = ts.per_row(row, done)
    ends = np.cumsum(n)
    own = _originals(h, row, done)[row]
    marks = marking_words(h[own], row[own], toxic)
    tags = (np.isin(h, marks) & toxic[row]).astype(np.int64)
    length = 2 * REACH + 1
    rng = np.random.default_rng(SEED)
    tagged_ = np.flatnonzero(tags)
    centre = np.concatenate([rng.choice(x, min(len(x), centres), replace=False) for x in (tagged_, np.arange(len(h)))])
    begin, end = (ends - n)[row[centre]], ends[row[centre]]
    at = np.clip(centre - REACH, begin, np.maximum(begin, end - length))[:, None] + np.arange(length)
    valid = at < end[:, None]  # texts shorter than a window end early
    at = np.minimum(at, end[:, None] - 1)
    weights, moves = _fitted(kinds[:, at], tags[at] * valid, valid)
    field = Field(weights, moves, np.zeros(3))
    x = np.column_stack([_gathered(field.marginals(kinds, n), n), np.ones(len(n))])
    beta = np.zeros(3)
    for _ in range(25):  # Newton steps with a little shrinkage
        p = sigmoid(x @ beta)
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (toxic - p) - 0.1 * beta)
    field.final = beta
    return field


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE,
    longest: int = LONGEST, centres: int = CENTRES, most_words: int = MOST_WORDS,
) -> Field | None:
    """Fits on labelled documents outside the held-out fold."""
    ship(docs.sparkSession)
    own = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    own = own.where(~held_out(F.col("id"))).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    by_hash = (F.xxhash64(F.lit(SEED), "id"), "id")
    chosen = own.where("y = 1").orderBy(*by_hash).limit(sample).union(own.where("y = 0").orderBy(*by_hash).limit(2 * sample))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.octet_length("text") <= longest)
    joined = texts.join(F.broadcast(chosen), "id").select("y", "text", F.xxhash64(F.lit(SEED), "text", "id").alias("h"))  # at most 3 * sample labels
    got = joined.orderBy("h", "text").limit(6 * sample).select("y", "text").toArrow()
    return fit(got["text"].to_pylist(), got["y"].to_pylist(), centres, most_words)


def _scorer(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in ts.chunks(batch.column(1), BATCH):
                own = batch.column(0).slice(lo, hi - lo)
                if field is None:
                    score, spans = np.zeros(hi - lo), pa.array([[]] * (hi - lo), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))
                else:
                    row, _, a, b, kinds = tokens(data, offs)
                    n = ts.per_row(row, hi - lo)
                    p = field.marginals(kinds, n)
                    score = sigmoid(np.column_stack([_gathered(p, n), np.ones(hi - lo)]) @ field.final)
                    hit = np.flatnonzero(p >= 0.5)
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    base = points[offs[:-1]][row[hit]]
                    found = pa.StructArray.from_arrays([pa.array((points[a[hit]] - base).astype(np.int32)), pa.array((points[b[hit]] - base).astype(np.int32)), pa.array(p[hit])], ["start", "end", "p"])
                    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[hit], np.arange(hi - lo + 1)).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([own, pa.array(score), spans], ["id", "score", "spans"])

    return run


def tagged(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and the toxic spans (start and end in characters, marginal) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(field), f"id {kind}, score double, spans array<struct<start: int, end: int, p: double>>").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = tagged(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
