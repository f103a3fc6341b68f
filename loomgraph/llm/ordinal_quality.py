"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - score). That gives the expected grade, and the tail probability of a grade of
at least ``cut``, by which documents are selected.

Only the fit is bounded, by parameters: at most ``sample`` ratings, chosen by a hash of the id, and of their documents
at most ``2 * sample`` rows of at most ``longest`` bytes, in the order of a hash of the text (more rows than ratings
only where ids repeat). Every document is scored on its whole text, of any length, by one task.

Defined results: null grades are no ratings; of several ratings of one id the highest counts; with no ratings, or a
single grade, all documents are kept; null and empty texts have score 0 of their features; each row is scored by
itself, whatever its id; an empty table gives an empty result; further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import features
from loomgraph.llm import textscan as ts
from loomgraph.session import ship

SAMPLE = 3000
LONGEST = 65_536
SEED = 29


def held_out(id_: Column) -> Column:
    """One document in five, by crc32 of its id as text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """grades (ascending), weights, and thresholds between neighbouring grades (ascending)."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k + 1]) in column k."""
        return sigmoid(score[:, None] - self.thresholds[None])

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.at_least(score) @ np.diff(self.grades) if self.grades else np.zeros(len(score))

    def tail(self, score: np.ndarray, cut: int | None) -> np.ndarray:
        """P(grade >= cut); cut None: better than the lowest grade."""
        if len(self.grades) < 2:
            return np.ones(len(score))
        k = 1 if cut is None else int(np.searchsorted(self.grades, cut))
        if k == 0:
            return np.ones(len(score))
        return self.at_least(score)[:, k - 1] if k < len(self.grades) else np.zeros(len(score))


def fit(rows: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = 200, rate: float = 0.3, decay: float = 1e-4) -> Ordinal:
    """Adam on the mean negative log-likelihood of sparse features (row, index, value)."""
    grades = sorted(set(grade.tolist()))
    if len(grades) < 2:
        return Ordinal(grades, np.zeros(features.SIZE), np.zeros(0))
    n, y = len(grade), np.searchsorted(grades, grade)
    share = np.cumsum(np.bincount(y))[:-1] / n
    start = np.log(share / (1 - share))
    # thresholds are start plus ordered shifts: the first free, the gaps through exp
    params = [np.zeros(features.SIZE), np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for t in range(1, steps + 1):
        w, free = params
        gaps = np.exp(free[1:])
        cuts = free[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(rows, value * w[index], minlength=n)
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        up, down = sigmoid(edges[y + 1] - score), sigmoid(edges[y] - score)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p  # of log p by the two thresholds
        g_score = (d_up - d_down) / n
        g_cut = np.bincount(y, -d_up / n, minlength=len(grades))[:-1] + np.bincount(y, d_down / n, minlength=len(grades))[1:]
        tail = np.cumsum(g_cut[::-1])[::-1]
        grads = [np.bincount(index, value * g_score[rows], minlength=features.SIZE) + decay * w, np.concatenate((tail[:1], tail[1:] * gaps))]
        for q, g, m in zip(params, grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            q -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    w, free = params
    return Ordinal(grades, w, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:])))))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each row and their mean count a word."""
    for batch in batches:
        for lo, hi, data, offs in ts.chunks(batch.column(1)):
            row, found = features.indices(data, offs)
            n = np.maximum(ts.per_row(row, hi - lo), 1)
            key, count = np.unique(np.tile(row, len(found)) * features.SIZE + found.ravel(), return_counts=True)
            of = key // features.SIZE
            at = pa.array(np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in ((key % features.SIZE).astype(np.int32), (count / n[of]).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], ["grade", "index", "value"])


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Ordinal:
    """Fits on rated documents outside the held-out fold."""
    ship(docs.sparkSession)
    rated = ratings.select(ratings[id_col].alias("id"), ratings[grade_col].cast("int").alias("grade")).where("grade IS NOT NULL AND id IS NOT NULL")
    rated = rated.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.octet_length("text") <= longest)
    chosen = texts.join(F.broadcast(rated), "id")  # at most ``sample`` ratings
    chosen = chosen.select("grade", "text", F.xxhash64(F.lit(SEED), "text", "id").alias("h")).orderBy("h", "text").limit(2 * sample)
    got = chosen.select("grade", "text").mapInArrow(_sparse, "grade int, index array<int>, value array<float>").toArrow()
    sizes = np.array([len(x) for x in got["index"]], np.int64)
    if not len(got):
        return Ordinal([], np.zeros(features.SIZE), np.zeros(0))
    index, value = (got[c].combine_chunks().flatten().to_numpy() for c in ("index", "value"))
    return fit(np.repeat(np.arange(len(got)), sizes), index.astype(np.int64), value.astype(np.float64), got["grade"].to_numpy())


def _scorer(model: Ordinal, cut: int | None, text: int, keep: int):
    """Scores column ``text``; the first ``keep`` columns are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in ts.chunks(batch.column(text)):
                score = features.scores(data, offs, model.weights)
                own = [batch.column(i).slice(lo, hi - lo) for i in range(keep)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(model.expected(score)), pa.array(model.tail(score, cut))], [*batch.schema.names[:keep], "expected_grade", "tail_probability"])

    return run


def graded(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", cut: int | None = None) -> DataFrame:
    """id, expected_grade and tail_probability of every row."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model, cut, 1, 1), f"id {kind}, expected_grade double, tail_probability double").withColumnRenamed("id", id_col)


def selected(docs: DataFrame, model: Ordinal, text_col: str = "text", cut: int | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a tail probability of at least ``least``, with all their columns."""
    names = docs.columns
    wide = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    scored = wide.mapInArrow(_scorer(model, cut, names.index(text_col), len(names)), f"{kinds}, expected_grade double, tail_probability double")
    return scored.where(F.col("tail_probability") >= least).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and grade: 0 for bad quality, 1 for good quality but toxic, 2 for good quality and not toxic; null without a quality."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") > 0) & (toxic > 0), 1).when(F.col("quality") > 0, 2)
    return labels.select(id_col, grade.alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade and P(grade >= 1), by which it is kept."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = graded(docs, train(docs, grades(labels), grade_col="grade"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))
