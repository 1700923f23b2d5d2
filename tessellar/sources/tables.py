"""Scans of the input tables, with schemas left to the files and columns to the optimiser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A row a line of a document: (doc_id, source, lang, ordinal from 0, line)."""
    d = table(spark, folder, "documents")
    return d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
