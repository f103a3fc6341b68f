"""A training corpus from raw documents: quality, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of documents.

Defined results, stage by stage. Null and empty texts: graded by the model without features, one of them is left by
the exact stage, the near stage keeps it, the mix doesn't take it. Texts of any length are read whole. Rows with equal
ids and different texts are documents of their own; equal rows count once from the exact stage on. Of copies the
largest id stays, of near copies the smallest; null ids lose to others there and come last here. Without labels no
document is rejected. An empty table passes every stage and gives no pieces. Further columns, of any names, are kept
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import exact_dedup, jaccard_join, mixing, ordinal_quality, packing
from loomgraph.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cumulative-link model rates above the lowest grade more likely than not."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal_quality.train(docs, ordinal_quality.grades(labels), grade_col="grade")
    return ordinal_quality.selected(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, up to the case of A-Z, the one with the largest id."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8, the one with the smallest id."""
    return jaccard_join.one_of_each(docs, size=5, num=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents not drawn go, those drawn twice appear twice, shuffled within shards."""
    return mixing.shuffled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mix", mix), ("pack", pack)]
#: The classifier, the mix and the packing can't be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
