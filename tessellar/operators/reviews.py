"""Readings and reviews: agreement, verification, projections as functions of append-only logs, re-attachment, import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import latest

HUMAN = ("accepted", "corrected", "rejected")


def agreement(readings: DataFrame, cell: list[str], a: str, b: str, value: str = "value", illegible: str = "illegible") -> DataFrame:
    """Counts over the cells that both readers read: agree, disagree, one or both illegible. One pass, no self-join."""
    of = lambda r, c: F.max(F.when(F.col("reader") == r, F.col(c)))
    per = readings.filter(F.col("reader").isin(a, b)).groupBy(*cell).agg(of(a, value).alias("va"), of(b, value).alias("vb"), of(a, illegible).alias("ia"), of(b, illegible).alias("ib"))
    both = per.filter(F.col("ia").isNotNull() & F.col("ib").isNotNull())
    clear = ~F.col("ia") & ~F.col("ib")
    same = F.col("va").eqNullSafe(F.col("vb"))
    out = both.agg(F.count("*").alias("compared"), F.count_if(clear & same).alias("agree"), F.count_if(clear & ~same).alias("disagree"), F.count_if(F.col("ia") & F.col("ib")).alias("both_illegible"), F.count_if(F.col("ia") != F.col("ib")).alias("one_illegible"))
    settled = F.col("agree") + F.col("disagree")
    return out.withColumn("rate", F.when(settled > 0, F.round(F.col("agree") / settled, 4)))


def cross_family(readings: DataFrame, cell: list[str], family: Column, value: str = "value", status: str = "review_status") -> DataFrame:
    """Cells that two or more known families read alike: (cell, value, families); what people decided stays out."""
    known = readings.withColumn("_f", family).filter(F.col("_f") != "unknown")
    per = known.groupBy(*cell).agg(F.count_distinct("_f").alias("families"), F.count_distinct(value).alias("_v"), F.min(value).alias("value"), F.max(F.col(status).isin(*HUMAN).cast("int")).alias("_h"))
    return per.filter("families >= 2 and _v = 1 and _h = 0").select(*cell, "value", "families")


def one_reading_per_cell(readings: DataFrame, cell: list[str], status: str, identity: str) -> DataFrame:
    """A corrected reading before others, then the smallest id."""
    return latest(readings, cell, [(F.col(status) != "corrected").cast("int"), F.col(identity)])


def effective(original: Column, reviewed: Column, status: Column | None = None) -> Column:
    """The reviewed value before the original; with a status, only a corrected one counts."""
    return F.coalesce(reviewed, original) if status is None else F.when((status == "corrected") & reviewed.isNotNull(), reviewed).otherwise(original)


def settle(proposals: DataFrame, anchor: list[str], value: str) -> DataFrame:
    """none, single, agreed or disagreed readers of one anchor; the value unless they disagree."""
    n, v = F.count(value), F.count_distinct(value)
    return proposals.groupBy(*anchor).agg(F.when(n == 0, "none").when(n == 1, "single").when(v == 1, "agreed").otherwise("disagreed").alias("settled"), F.when(v == 1, F.min(value)).alias("value"))


def project(log: DataFrame, anchor: list[str], order: list[str], verdict: str, before: str, value: str) -> DataFrame:
    """What a log makes of each anchor: the last verdict and value, the first one's earlier status, how many there
    were. Logs only grow, so this is an aggregate and can be replayed at will."""
    key = F.struct(*order)
    return log.groupBy(*anchor).agg(F.max_by(verdict, key).alias("status"), F.max_by(value, key).alias("reviewed_value"), F.min_by(before, key).alias("status_before"), F.count("*").alias("reviews"))


def apply_projection(facts: DataFrame, projection: DataFrame, anchor: list[str], status: str, value: str) -> DataFrame:
    p = projection.select(*anchor, F.col("status").alias("_s"), F.col("reviewed_value").alias("_v"))
    j = facts.join(p, anchor, "left")
    return j.withColumn(status, F.coalesce("_s", status)).withColumn("effective_value", effective(F.col(value), F.col("_v"))).drop("_s", "_v")


def reattach(old: DataFrame, new: DataFrame, anchor: list[str], value: str, old_id: str, new_id: str) -> DataFrame:
    """(old id, new id, outcome): attached where an anchor has one old and one new fact of the same value; else
    ambiguous, value_changed or orphaned."""
    o = old.groupBy(*anchor).agg(F.count("*").alias("n_old"), F.min(old_id).alias("_o"))
    n = new.groupBy(*anchor, value).agg(F.count("*").alias("n_new"), F.min(new_id).alias("_n"))
    at = new.select(*anchor).distinct().withColumn("_there", F.lit(True))
    j = old.join(o, anchor).join(n, [*anchor, value], "left").join(at, anchor, "left")
    outcome = F.when((F.col("n_old") > 1) | (F.col("n_new") > 1), "ambiguous").when(F.col("n_new") == 1, "attached").when(F.col("_there"), "value_changed").otherwise("orphaned")
    return j.select(old_id, F.when(outcome == "attached", F.col("_n")).alias(new_id), outcome.alias("outcome"))


def import_status(ledger: DataFrame, store: DataFrame, identity: str, fields: list[str], known: DataFrame, anchor: str) -> DataFrame:
    """(id, status): new, identical, conflict, or unresolvable where the anchor is not known."""
    s = store.select(identity, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_in"))
    k = known.select(anchor).distinct().withColumn("_known", F.lit(True))
    j = ledger.join(s, identity, "left").join(k, anchor, "left")
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields])
    status = F.when(F.col("_known").isNull(), "unresolvable").when(F.col("_in").isNull(), "new").when(same, "identical").otherwise("conflict")
    return j.select(identity, status.alias("status"))


def order_conflicts(ledger: DataFrame, store: DataFrame, anchor: str, order: list[str], identity: str) -> DataFrame:
    """Anchors whose stored reviews are not a prefix of the ledger's, in order."""
    ids = lambda df, name: df.groupBy(anchor).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, identity))), lambda x: x[identity]).alias(name))
    j = ids(store, "_s").join(ids(ledger, "_l"), anchor)
    return j.filter(F.slice("_l", 1, F.greatest(F.size("_s"), F.lit(1))) != F.col("_s")).select(anchor)


def queue(rows: DataFrame, done: DataFrame, on: str, order: list[Column], k: int) -> DataFrame:
    """What waits for a decision, in order."""
    return rows.join(done.select(on).distinct(), on, "left_anti").orderBy(*order).limit(k)


def without_reviewer(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("review_status").isin(*HUMAN) & F.col("reviewer").isNull())


def expand_spans(spans: DataFrame, first: str, last: str) -> DataFrame:
    """A row a table row that a span covers."""
    return spans.withColumn("row", F.explode(F.sequence(F.col(first), F.col(last))))


def piles(frames: dict[str, DataFrame]) -> DataFrame:
    """Work piles one after another, each row with its pile's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("pile", F.lit(n)) for n, f in frames.items()])


def grid_faults(reviews: DataFrame, grid: str, spans: str) -> DataFrame:
    """(review_id, fault): a cell given twice, a span that runs back, or one outside the grid's rows."""
    cells = F.transform(F.col(grid), lambda c: F.struct(c["row"], c["col"]))
    rows = F.transform(F.col(grid), lambda c: c["row"])
    back = F.exists(F.col(spans), lambda s: s["row_from"] > s["row_to"])
    out = F.exists(F.col(spans), lambda s: (s["row_from"] < F.array_min(rows)) | (s["row_to"] > F.array_max(rows)))
    faults = F.array_compact(F.array(F.when(F.size(F.array_distinct(cells)) < F.size(cells), "cell given twice"), F.when(back, "span runs back"), F.when(out, "span outside the grid")))
    return reviews.select("review_id", F.explode(faults).alias("fault"))
