"""Checks as plans: what breaks a rule comes back as rows that name it; a batch with any fault is refused whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERFACES = ("search", "resolve", "facts")


def violations(rows: DataFrame, identity: str, rules: dict[str, Column]) -> DataFrame:
    """(identity, rule): a row for each rule that a row breaks. A rule is a condition that must hold; null breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return rows.select(identity, F.explode(broken).alias("rule"))


def distinct_in_order(x: Column) -> Column:
    """Whether a list is sorted and names nothing twice."""
    return (F.array_sort(x) == x) & (F.size(F.array_distinct(x)) == F.size(x))


def differences(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more: (columns, side)."""
    cols = expected.columns
    e, s = expected.select(*cols), stored.select(*cols)
    return e.exceptAll(s).withColumn("side", F.lit("missing")).unionByName(s.exceptAll(e).withColumn("side", F.lit("unexpected")))


def echo_faults(reviews: DataFrame, held: DataFrame, anchor: str, fields: list[str]) -> DataFrame:
    """(review_id, fault): reviews of things that are gone, or that no longer read as the reviewer saw them."""
    h = held.select(anchor, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    j = reviews.join(h, anchor, "left")
    faults = [F.when(F.col("_there").isNull(), F.lit("gone"))] + [F.when(F.col("_there") & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f"{f} moved")) for f in fields]
    return j.select("review_id", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def decision_faults(decisions: DataFrame, held: DataFrame, verdicts: list[str], kinds: list[str]) -> DataFrame:
    """(anchor, fault) of a batch of decisions: no reviewer, unknown words, an acceptance without a kind, text that
    moved, two decisions on one anchor. Any of them refuses the batch."""
    twice = decisions.groupBy("anchor").agg((F.count("*") > 1).alias("_twice"))
    h = held.select("anchor", F.col("text").alias("_text"))
    j = decisions.join(twice, "anchor").join(h, "anchor", "left")
    c = lambda test, name: F.when(test, F.lit(name))
    faults = F.array_compact(F.array(
        c(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "no reviewer"), c(~F.col("verdict").isin(verdicts), "unknown verdict"), c(F.col("kind").isNotNull() & ~F.col("kind").isin(kinds), "unknown kind"),
        c(F.col("verdict").isin("accepted", "corrected") & F.col("kind").isNull(), "accepted without a kind"), c(~F.col("text_seen").eqNullSafe(F.col("_text")), "text moved"), c(F.col("_twice"), "decided twice"),
    ))
    return j.select("anchor", F.explode(faults).alias("fault")).distinct()


def apply_all_or_nothing(decisions: DataFrame, faults: DataFrame) -> DataFrame:
    """The decisions, or none where the batch has a fault."""
    n = faults.agg(F.count("*").alias("_n"))
    return decisions.join(F.broadcast(n)).filter("_n = 0").drop("_n")  # one row


GOLD = "id string, category string, question string, interface string, answerable boolean, expected_documents array<string>, expected_pages map<string, array<int>>, expected_answer_terms array<string>"


def gold(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Questions of JSON-lines files with their file's name as the set; an interface that is not known is an error."""
    g = spark.read.schema(GOLD).json(paths).withColumn("set", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.\w+$", 1))
    known = F.coalesce(F.col("interface"), F.lit("search"))
    return g.withColumn("interface", F.when(known.isin(*INTERFACES), known).otherwise(F.raise_error(F.concat(F.lit("unknown interface: "), known))))


def routed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, questions, before, after, gained, lost) of the questions that another interface answered."""
    j = after.select("question_id", "category", F.col("passed").alias("_a")).join(before.select("question_id", F.col("passed").alias("_b")), "question_id", "left")
    b = F.coalesce("_b", F.lit(False))
    return j.groupBy("category").agg(F.count("*").alias("questions"), F.count_if(b).alias("before"), F.count_if("_a").alias("after"), F.count_if(F.col("_a") & ~b).alias("gained"), F.count_if(~F.col("_a") & b).alias("lost"))


STEPS = "source string, page int, steps array<struct<text: string, kind: string, slot: string>>"


def step_readings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row a step of readings (JSON files), with its place."""
    raw = spark.read.schema(STEPS).option("multiLine", "true").json(paths)
    return raw.select("source", "page", F.posexplode("steps").alias("ordinal", "s")).select("source", "page", "ordinal", "s.*")


def reference_text(index: DataFrame, elements: DataFrame) -> DataFrame:
    """(ref_id, text): the text of a reference that names exactly one element; null for the others."""
    one = index.withColumn("element_id", F.when(F.size("element_ids") == 1, F.col("element_ids")[0]))
    return one.join(elements.select("element_id", "text"), "element_id", "left").select("ref_id", "text")
