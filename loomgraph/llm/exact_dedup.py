"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Equal rows combine locally: the partial aggregation by (digest, salt, content) keeps one row a task and content.
2. Salted groups merge: a group of any size is dealt over ``salts`` tasks.
3. The salt winners, at most ``salts`` a group, combine by (digest, content).

Content is a grouping key at each stage, so a digest never decides alone. Where one digest has several contents,
those rows are matched to their class by digest and content. The classes are then joined to the rows by digest, in
which no text moves: classes of many rows, of which there are at most ``HOT_CLASSES``, are broadcast, so that no task
gets all rows of one.

Defined results: null text counts as empty; of rows with the same id and text one is kept, the others go (in
``deduplicated`` the one whose columns, as JSON, come first); null ids lose against any other; texts of any length are
compared whole; an empty table gives an empty result; further columns may have any names and are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.columns import Plain
from loomgraph.session import release, written

#: A class is hot from this many rows on, or from this share of all rows.
LEAST_HOT = 2000
HOT_CLASSES = 20_000


def normalised(text: Column) -> Column:
    """A-Z to a-z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row a row of ``docs``: id, keep_id, group_size, kept, text_sha256. The largest id of a group stays."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("content"))
    rows = rows.select("id", "content", digest(F.col("content")).alias("digest"))
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "content").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    contents = salted.repartition("digest").groupBy("digest", "content").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    by_digest = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    classes = written(by_digest, "dedup-classes")
    release(spark)

    total = classes.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") > max(LEAST_HOT, total // HOT_CLASSES)
    one = classes.where("contents = 1")
    slim = written(rows.select("id", "digest"), "dedup-digests")
    matched = slim.join(F.broadcast(one.where(hot)), "digest", "left")
    others = matched.where("contents IS NULL").select("id", "digest").join(one.where(~hot), "digest")
    found = matched.where("contents IS NOT NULL").unionByName(others)
    clashing = classes.where("contents > 1").select("digest")
    if not clashing.isEmpty():
        apart = rows.join(clashing, "digest", "left_semi")
        own = contents.join(clashing, "digest", "left_semi").select("digest", "content", F.lit(1).cast("long").alias("contents"), F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
        found = found.unionByName(apart.join(own, ["digest", "content"]).withColumn("digest", F.concat("digest", F.lit("/"), F.xxhash64("content").cast("string"))).drop("content"))
    found = written(found.select("id", "digest", "keep_id", "group_size"), "dedup-rows")
    release(spark)

    # rows that repeat the id of the one that stays: the first in the table stays
    top = F.col("id").eqNullSafe(F.col("keep_id"))
    repeated = found.where(top & (F.col("group_size") > 1)).select("digest", F.struct("_metadata.file_path", "_metadata.row_index").alias("at")).groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    if repeated.isEmpty():
        kept, out = top, found
    else:
        out = found.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("at")).join(repeated, "digest", "left")
        kept = top & F.coalesce(F.col("at") == F.col("first"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.substring_index("digest", "/", 1).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one a group, with all their columns."""
    own = Plain(docs)
    id_, text = own.name(id_col), own.name(text_col)
    decided = exact_dedup(own.df, id_, text)
    stay = decided.where("kept").select(F.col(id_).alias("stay_id"), F.col("text_sha256").alias("stay_sha"))
    marked = own.df.withColumn("own_sha", sha256(normalised(F.col(text))))
    both = marked.join(stay, F.col(id_).eqNullSafe(F.col("stay_id")) & (F.col("own_sha") == F.col("stay_sha")), "left_semi")
    repeats = decided.where(F.col(id_).eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1)).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("text_sha256").alias("own_sha"))
    if repeats.isEmpty():
        return both.select(*own.back())
    several = both.join(repeats, "own_sha", "left_semi")
    first = several.groupBy("own_sha").agg(F.min(F.struct(F.to_json(F.struct(*own.df.columns)).alias("json"), F.struct(*own.df.columns).alias("row"))).alias("one")).select("one.row.*") if _orderable(own.df) else several.dropDuplicates(["own_sha"]).drop("own_sha")
    return both.join(repeats, "own_sha", "left_anti").select(*own.df.columns).unionByName(first.select(*own.df.columns)).select(*own.back())


def _orderable(df: DataFrame) -> bool:
    return "map<" not in df.schema.simpleString() and "variant" not in df.schema.simpleString()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_NORM = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
