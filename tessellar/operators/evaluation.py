"""How good the answers are: ranks, support, gates on unrounded numbers, and audits of the corpus and its projections."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import QUESTIONS, question_blocks

# fixed values: what a run must reach
GATES = {"recall": 0.80, "support": 0.70, "no_answer_precision": 0.66, "false_unsupported": 0.20}


def holders(units: DataFrame, items: DataFrame, size: int = QUESTIONS) -> DataFrame:
    """(question_id, doc_id) of each item (question_id, item) and unit (doc_id, t) whose text holds the item's as it stands.

    Both are normalised: words between single blanks. An item's words but its first and last stand whole in a text that
    holds it, so its second and third are looked up among the text's neighbouring words, and what they find is
    compared; shorter items are compared with every text. The items go to the units, whose texts are not shuffled.
    """
    parts = [_holders(units, block) for block in question_blocks(items, size)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _holders(units: DataFrame, items: DataFrame) -> DataFrame:
    by_pair: dict[tuple[str, str], list[tuple[int, str]]] = {}
    short: list[tuple[int, str]] = []
    for q, item in items.select("question_id", "item").collect():  # a block
        words = item.split(" ")
        (by_pair.setdefault((words[1], words[2]), []) if len(words) > 3 else short).append((q, item))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found, at = [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                words = t.split(" ")
                near = [x for pair in by_pair.keys() & set(zip(words, words[1:], strict=False)) for x in by_pair[pair]]
                mine = [q for q, item in [*near, *short] if item in t]
                found += mine
                at += [i] * len(mine)
            yield pa.record_batch([pa.array(found, pa.int64()), b.column("doc_id").take(pa.array(at, pa.int64()))], names=["question_id", "doc_id"])

    return units.select(F.col("doc_id").cast("bigint"), "t").mapInArrow(run, "question_id bigint, doc_id bigint")


def scored(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(question_id, rank, found): the first relevant result's rank within k, of every question with an answer."""
    hits = results.filter(F.col("rank") <= k).join(relevant, ["question_id", "doc_id"])
    per = relevant.select("question_id").distinct().join(hits.groupBy("question_id").agg(F.min("rank").alias("rank"), F.count("*").alias("found")), "question_id", "left")
    return per.select("question_id", "rank", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"))


def metrics(per: DataFrame) -> DataFrame:
    """One row: questions, recall, mean reciprocal rank, unrounded."""
    return per.agg(F.count("*").alias("questions"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def support(text: Column, terms: Column) -> Column:
    """The share of an answer's terms that the evidence holds."""
    low = F.lower(text)
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.instr(low, t) > 0)) / F.size(terms))


def verdicts(scores: DataFrame) -> DataFrame:
    """passes: an answerable question is found with half its support; another is flagged as unsupported."""
    ok = F.when(F.col("answerable"), F.col("rank").isNotNull() & (F.coalesce("support", F.lit(0.0)) >= 0.5)).otherwise(F.col("flagged"))
    return scores.withColumn("passed", F.coalesce(ok, F.lit(False)))


def gates(recall: float, support: float, no_answer_precision: float, false_unsupported: float) -> dict[str, bool]:
    """Graded as measured, never rounded first."""
    return {"recall": recall >= GATES["recall"], "support": support >= GATES["support"], "no_answer_precision": no_answer_precision >= GATES["no_answer_precision"], "false_unsupported": false_unsupported <= GATES["false_unsupported"]}


def length_shape(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, min, mean, max, and the values at ranks 10, 50 and 90 % (by place, not interpolated).

    Places are found through the counts of equal lengths, so the window sees a row a length, not a row a document.
    """
    per = rows.groupBy(value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(value))
    per = per.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = lambda share, name: F.min(F.when(F.col("upto") > F.floor(F.col("all") * share / 100), F.col(value))).cast("bigint").alias(name)
    return per.agg(F.sum("n").alias("n"), F.min(value).cast("bigint").alias("least"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 4).alias("mean"), F.max(value).cast("bigint").alias("most"), at(10, "p10"), at(50, "p50"), at(90, "p90"))


def slot_shares(results: DataFrame, key: str, page: list[str]) -> DataFrame:
    """One row: slots, the share of repeated texts and of repeated pages within a question's list."""
    first = lambda by: F.row_number().over(Window.partitionBy("question_id", *by).orderBy("rank"))
    r = results.withColumns({"_t": first([key]), "_p": first(page)})
    return r.agg(F.count("*").alias("slots"), F.round(F.avg((F.col("_t") > 1).cast("double")), 6).alias("duplicate_share"), F.round(F.avg((F.col("_p") > 1).cast("double")), 6).alias("repeat_page_share"))


def subsets(rows: DataFrame, tags: Column, content: str, size: str) -> DataFrame:
    """(subset, files, objects, bytes): bytes of distinct contents only."""
    t = rows.withColumn("subset", F.explode(tags))
    files = t.groupBy("subset", content).agg(F.count("*").alias("n"), F.max(size).alias("b"))
    return files.groupBy("subset").agg(F.sum("n").alias("files"), F.count("*").alias("objects"), F.sum("b").alias("bytes"))


def changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed between two listings."""
    b = before.select(F.col(key).alias("_kb"), F.col(digest).alias("_b"))
    j = after.select(F.col(key).alias("_ka"), F.col(digest).alias("_a")).join(b, F.col("_ka") == F.col("_kb"), "full")
    change = F.when(F.col("_kb").isNull(), "added").when(F.col("_ka").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return j.select(F.coalesce("_ka", "_kb").alias(key), change.alias("change")).filter("change is not null")
