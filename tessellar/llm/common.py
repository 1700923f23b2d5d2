"""Shared pieces of the training-data operators: keys, words, folders, lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, discard, importable, scratch, shared_root  # noqa: F401

#: Bytes 0x20 and 0x09-0x0D: the white space of every contract here.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Sorts a missing id before all others.
NO_ID = -(2**63)
#: Rows that travel to a Python worker at once; bounds its memory when texts are long.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts (a session setting, read when a plan runs)."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only (first of each name), so that other columns cannot clash."""
    known = {f.name for f in docs.schema.fields}
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    return docs.select(*[(docs[n].cast(kinds.get(n, "string")) if n in known else F.lit(None).cast(kinds.get(n, "string"))).alias(n) for n in names])


def fold_ascii(x: Column) -> Column:
    """A-Z to lower case; every other character stays."""
    return F.translate(x, UPPER, LOWER)


def strip_space(x: Column) -> Column:
    return F.trim(x, F.lit(SPACE))


def words(x: Column) -> Column:
    """The words of a text (null: none) as an array, without a regular expression per word."""
    spaced = F.translate(F.coalesce(x, F.lit("")), SPACE[1:], " " * (len(SPACE) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def remainder(x: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as empty text."""
    return F.crc32(F.coalesce(x.cast("string"), F.lit("")).cast("binary")) % n


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def texts(batch, name: str = "text") -> list[bytes]:
    """A batch's texts as UTF-8 (null: empty), without decoding them."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def by_batches(rows: Iterator, size: int) -> Iterator[list]:
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out
