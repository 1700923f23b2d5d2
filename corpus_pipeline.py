"""From documents to a training mix in five stages; each stage's rows are written as Parquet and read by the next.

1. The quality classifier's rejects go. 2. Lines that smaller ids hold too go (n_chars, where there is one, follows). 3. Of near copies
(five-word shingles, Jaccard similarity of 0.8 or more, and what such links connect) the smallest id stays.
4. Documents that hold a benchmark passage go. 5. What is left is packed into blocks and mixed to target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from tessellar.llm.common import scratch
from tessellar.sources.shared import written

#: SQL has no words for the factorisation machine of the first stage.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs, 5, 80, 100)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_blocks(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", one_of_a_kind),
    ("benchmark decontamination", uncontaminated),
    ("mixing to target weights", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}")
        written(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
