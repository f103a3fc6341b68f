"""Quality rules as a bitmask ledger.

Each rule is evaluated once for each document; the ledger stores its measurements and one failure bit a rule.
Policies are versioned sets of rules: a document is kept when ``fail_bits & mask = 0``. Ablations need no
second look at any text: they are bitwise aggregates over the ledger.

Defined results: a null or empty text has zero of everything and fails ``few_words``; rows with equal or null
ids each keep their own row; an empty table gives an empty ledger; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import textscan as ts
from loomgraph.session import ship

#: name -> failure as SQL over the measurements. A rule's bit is its place; new rules go to the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "20 * n_symbols > word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 100 * n_words",
}
#: version -> names of the rules that a document must pass.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and for each place in it whether it equals the one before."""
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    return order, same


def measured(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each row."""
    n = len(offs) - 1
    start, end, row = ts.words(data, offs)
    out = {"n_words": ts.per_row(row, n), "n_symbols": ts.summed(_SYMBOL[data], offs)}
    out["word_chars"] = ts.summed(~ts._SPACE[data] & (data & 0xC0 != 0x80), offs)

    line_start = np.union1d(np.flatnonzero(data[:-1] == 10) + 1, offs[:-1][offs[:-1] < offs[1:]])
    line_end = np.append(line_start[1:], len(data))
    line_end -= (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else 0
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[full], line_end[full]
    line_row = np.searchsorted(offs, line_start, "right") - 1
    out["n_lines"] = ts.per_row(line_row, n)
    order, same = _repeats(line_row, ts.identities(data, line_start, line_end))
    out["n_dup_lines"] = ts.per_row(line_row[order[same]], n)

    word = ts.identities(data, start, end)
    at = np.flatnonzero(row[:-2] == row[2:])
    order, same = _repeats(row[at], word[at], word[at + 1], word[at + 2])
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(start) + 3, bool)
    for j in range(3):
        cover[at[order[twice]] + j] = True
    out["n_repeat_words"] = ts.per_row(row[cover[: len(row)]], n)
    return out


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and MEASURES of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in ts.chunks(batch.column(1)):
                got = measured(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(got[m]) for m in MEASURES)], ["id", *MEASURES])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("id", id_col)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set when rule i fails."""
    bits = " | ".join(f"(CASE WHEN {fails} THEN {1 << i}L ELSE 0L END)" for i, fails in enumerate(RULES.values()))
    return measurements(docs, id_col, text_col).withColumn("fail_bits", F.expr(bits))


def mask(policy: str) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[policy])


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    The ledger is first summed by failure pattern, of which there are at most 2**rules.
    """
    of = mask(policy)
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(of)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [(name, 1 << i) for i, name in enumerate(RULES) if name in POLICIES[policy]]
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names)))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    here, rest = F.col("bits").bitwiseAND(F.col("bit")), F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return each.groupBy("rule").agg(total(here != 0, "n_failed"), total((here != 0) & (rest == 0), "n_failed_alone"), total(rest == 0, "n_kept_without"))


def failing_anywhere(led: DataFrame) -> DataFrame:
    """One row: the rules that some document fails, and those that every document fails."""
    return led.agg(F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measurements, its failure bits and the verdicts of policies base and v1."""
    led = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), (passes("base") & passes("v1")).alias("kept"), "fail_bits",
    )


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), wins AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}')
), dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n_lines, 0)::BIGINT AS n_lines,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
), f AS (
  SELECT *, ({" | ".join(f"(CASE WHEN {x} THEN {1 << i} ELSE 0 END)" for i, x in enumerate(RULES.values()))})::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {mask("base")}) <> 0 AS base_failed, (fail_bits & {mask("base") | mask("v1")}) = 0 AS kept, fail_bits
FROM f
"""
