"""Editions, dates and which member of a chain is in force. Every "latest" has an id as its tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order; groups are cut to one row where they meet."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def next_edition(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.max("edition") + 1).alias("next_edition"))


def as_of(members: DataFrame, by: list[str], effective: str, day: Column, identity: str) -> DataFrame:
    """Of each chain, the member with the latest effective date at or before a day (ties: the larger identity)."""
    return members.filter(F.col(effective).isNotNull() & (F.col(effective) <= day)).groupBy(*by).agg(F.max_by(identity, F.struct(effective, identity)).alias(identity), F.max(effective).alias(effective))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, since: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the right row of its key that began last at or before it.

    Both sides go through one shuffle and one sorted scan a key, not a range join.
    """
    a = left.select("*", F.col(at).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    b = right.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col(key) for f in left.schema.fields], F.col(since).alias("_at"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("_v", filled).filter("_side = 1").select(*left.columns, *[F.col("_v")[v].alias(v) for v in values])


def agreement(rows: DataFrame, by: list[str], value: str, status: str) -> DataFrame:
    """unanimous, conflict or none; the value only where all agree; the confidence of the weakest source."""
    weak = F.when(F.max((F.col(status) == "flagged").cast("int")) == 1, "review_required").when(F.min(F.col(status).isin("accepted", "corrected").cast("int")) == 1, "reviewed").otherwise("extracted")
    n = F.count_distinct(value)
    return rows.groupBy(*by).agg(
        F.when(n == 0, "none").when(n == 1, "unanimous").otherwise("conflict").alias("agreement"),
        F.when(n == 1, F.min(value)).alias("value"),
        F.when(n > 0, weak).alias("confidence"),
        F.count(value).alias("sources"),
    )


def select_active(members: DataFrame, chain: str, as_of_day: str) -> DataFrame:
    """(chain, active, basis): marked, inferred_in_force, assumed_newest, conflict, withdrawn or none.

    members: chain, document_id, content (equal content is one filing: its smallest id), version_status, expiration
    (ISO text or null), expiration_conflict, position (the newest has the largest).
    """
    live = members.filter(F.coalesce(F.col("version_status") != "superseded", F.lit(True)))
    one = live.withColumn("status", F.when(F.col("expiration_conflict"), "unknown").when(F.col("expiration").isNull(), "unknown").when(F.col("expiration") < as_of_day, "expired").otherwise("in_force"))
    marked, valid = F.col("version_status") == "active", F.col("status") == "in_force"
    picked = one.groupBy(chain).agg(
        F.count_distinct(F.when(marked, F.col("content"))).alias("n_marked"),
        F.min_by(F.when(marked, F.struct("document_id", "status", "expiration_conflict")), F.when(marked, F.col("document_id"))).alias("m"),
        F.count_distinct(F.when(valid, F.col("content"))).alias("n_valid"),
        F.min_by(F.when(valid, F.struct("document_id", "status", "expiration_conflict")), F.when(valid, F.col("document_id"))).alias("v"),
        F.max_by(F.struct("document_id", "status", "expiration_conflict"), F.struct("position", "document_id")).alias("p"),
    )
    chains = members.select(chain).distinct().join(picked, chain, "left")
    chosen = F.when(F.col("n_marked") == 1, F.col("m")).when((F.col("n_marked") == 0) & (F.col("n_valid") == 1), F.col("v")).when((F.col("n_marked") == 0) & (F.col("n_valid") == 0), F.col("p"))
    kind = F.when(F.col("n_marked") == 1, "marked").when(F.col("n_valid") == 1, "inferred_in_force").otherwise("assumed_newest")
    basis = (
        F.when(F.col("p").isNull(), "none")
        .when((F.col("n_marked") > 1) | ((F.col("n_marked") == 0) & (F.col("n_valid") > 1)), "conflict")
        .when(F.col("c")["expiration_conflict"], "conflict")
        .when(F.col("c")["status"] == "expired", "withdrawn")
        .otherwise(F.col("k"))
    )
    out = chains.withColumns({"c": chosen, "k": kind}).withColumn("basis", basis)
    return out.select(chain, F.when(F.col("basis").isin("marked", "inferred_in_force", "assumed_newest"), F.col("c")["document_id"]).alias("active"), "basis")
