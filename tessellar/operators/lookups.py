"""Look-ups on facts, labels, approvals and filings, and the classes of warnings: columns and single-shuffle plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_reading

BLANK = " \t\n\r\f\v"

# fixed values: a column's label, and the kind of value or the condition that it stands for; the first match counts
VALUE_LABELS = {r"footing\s*depth": "footing_depth_in", r"min\.?\s*footing.*depth": "footing_depth_in", r"max\.?\s*post\s*spacing": "post_spacing_in", r"min\.?\s*footing.*diameter": "footing_diameter_in"}
CONDITION_LABELS = {r"wind\s*exposure": "exposure_category", r"^exposure$": "exposure_category", r"fence\s*height": "fence_height"}
# fixed values: an approval's number, and the two wordings that cite an earlier one
APPROVAL = r"\d{2}-\d{4}\.\d{2}"
SPACED_APPROVAL = r"(\d{2}\s*-\s*\d{4}\s*\.\s*\d{2})"
CITED = (r"(?i)previous\s+approval\s*#?\s*" + SPACED_APPROVAL, r"(?i)renew(?:s|al of)?\s+(?:noa\s*)?#?\s*" + SPACED_APPROVAL)
CITING_PAGES = 6
# fixed values: words that open a warning, what may stand before them, and wordings that make or unmake one
OPENERS = r"(?:WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|NOTES?|ATTENTION|ADVERTENCIA|AVERTISSEMENT)"
BEFORE_OPENER = r"[\s*•·]{0,4}(?:\d{1,3}[A-Z]?\.?\s*[*•]?\s*)?"
HAZARD = r"personal injury|bodily injury|serious injury|can result in|may result in|failure to comply|void the warranty|not be covered by the warranty|underground utilit|call before you dig|always wear|eye protection|limitation of liability"
NAMED_RULE = r"never strike|never cut the top|never attach both ends|codes? for frost line|not covered (?:by|under)[^.]{0,25}warrant"
NO_WARNING = r"NOTICE OF ACCEPTANCE|never fades|never blisters|never peels|^\s*(?:safety glasses|safety goggles)\s*\z|removal of NOA|terminate this NOA"
HANGING_WORDS = r"to|the|a|an|and|or|of|in|on|at|as|is|are|be|with|for|from|by|your|you|it|this|that|will|may|can|need|needs|into|onto|over|under"
# fixed values: the headers of a kit's table, and the rows with a quantity that it needs
QUANTITY_HEADER, ITEM_HEADER, SIZE_HEADER = r"(?i)^(?:qty|quantity|count)\z", r"(?i)^(?:item|part|component|description)\z", r"(?i)^dimensions?\z"
KIT_ROWS = 3
# fixed values: how far each review status carries a reading
CURATED = {"accepted": 2, "corrected": 2, "reviewed": 2, "cross_family_verified": 1}


def stripped(x: Column) -> Column:
    return F.trim(x, F.lit(BLANK))


def text_or_ocr(text: Column, ocr: Column) -> Column:
    """The text layer's words, else the recognised ones, else the empty string."""
    return F.coalesce(F.nullif(stripped(text), F.lit("")), stripped(ocr), F.lit(""))


def labelled(label: Column, registry: dict[str, str]) -> Column:
    """The name of the first pattern found in the label; null for none or no label."""
    low = F.lower(stripped(label))
    return F.coalesce(*[F.when(low.rlike(rx), F.lit(name)) for rx, name in registry.items()])


def fact_lookup(facts: DataFrame, documents: DataFrame, fact_type: str | None = None, conditions: dict[str, object] | None = None, maker: str | None = None, limit: int = 20, flagged: bool = True) -> DataFrame:
    """The `limit` first facts with their document: those of active documents first, then by page and fact_id.

    facts: fact_id, document_id, fact_type, page_no, review_status, conditions (map of strings; null: none). documents:
    document_id, manufacturer, version_status. Rejected facts and those without a status never come; without `flagged`
    only extracted and reviewed ones do. Conditions are compared as strings, before the limit. The order and the limit are
    one top-k a partition, so only `limit` rows leave each."""
    f = facts.filter(F.col("review_status") != "rejected")
    if fact_type is not None:
        f = f.filter(F.col("fact_type") == fact_type)
    if not flagged:
        f = f.filter(F.col("review_status").isin("extracted", "reviewed"))
    for k, v in (conditions or {}).items():
        f = f.filter(F.col("conditions")[k] == str(v))
    d = documents.select("document_id", "manufacturer", "version_status")
    if maker is not None:
        d = d.filter(F.col("manufacturer") == maker)
    active = F.coalesce(F.col("version_status") == "active", F.lit(False))
    return f.join(d, "document_id").orderBy(active.desc(), "page_no", "fact_id").limit(limit)


def approval_id(path: Column, title: Column) -> Column:
    """The approval that a document is: by its path, else by its title; null where neither names one."""
    find = lambda x: F.nullif(F.regexp_extract(x, r"(?<![\p{L}\p{N}_])" + APPROVAL + r"(?![\p{L}\p{N}_])", 0), F.lit(""))
    return F.coalesce(find(path), find(title))


def cited_approvals(text: Column) -> Column:
    """The distinct approvals that a text calls its previous or renewed one, without blanks."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx), F.lit(1)) for rx in CITED])
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


def approval_edges(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """(a, b): document a supersedes b, for one of its first pages cites b's approval as previous or renewed.

    documents: document_id, approval. elements: document_id, page_no, text. A document's own approval does not count.
    `graph.mirrored` makes the relation rows, `graph.linked_duplicates` by approval those of the same product."""
    c = elements.filter(F.col("page_no") <= CITING_PAGES).select(F.col("document_id").alias("a"), F.explode(cited_approvals(F.col("text"))).alias("approval")).distinct()
    named = documents.filter("approval is not null").select(F.col("document_id").alias("b"), "approval")
    own = documents.select(F.col("document_id").alias("a"), F.col("approval").alias("_own"))
    e = c.join(named, "approval").join(own, "a", "left")
    return e.filter("a <> b and not (approval <=> _own)").select("a", "b").distinct()


def warning_class(x: Column) -> Column:
    """excluded, alone (the opening word only), led (the word, a mark, a body), hazard, rule or none, in this order."""
    y = F.coalesce(x, F.lit(""))
    any_case = lambda rx: y.rlike("(?i)" + rx)
    lead = "^" + BEFORE_OPENER + OPENERS + r"\s*"
    return (
        F.when(any_case(NO_WARNING), "excluded")
        .when(any_case(lead + r"[:!.–-]?\s*\z"), "alone")
        .when(any_case(lead + r"[:!.–—-]\s*\S"), "led")
        .when(any_case(HAZARD), "hazard")
        .when(any_case(NAMED_RULE), "rule")
        .otherwise("none")
    )


def dangling(x: Column) -> Column:
    """Does the text stop in the middle of a clause?"""
    return F.coalesce(x, F.lit("")).rlike(r"(?i)(?:(?:^|[^\p{L}\p{N}_])(?:" + HANGING_WORDS + r")|-)\s*\z")


def interleaved(x: Column) -> Column:
    """Does a second opening word stand inside the text, as where two columns were read as one?"""
    return F.coalesce(x, F.lit("")).rlike(r"(?i)\S\s+" + OPENERS + r"\s*[:!]")


def kit_tables(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, qty, item, dim, rows): tables whose first row heads a quantity and an item, with the columns of the headers
    (the last one counts) and the rows below it whose quantity is digits, three at least. cells: row, col, text."""
    t = cells.withColumn("text", stripped(F.coalesce(F.col("text"), F.lit(""))))
    t = t.groupBy(*by).agg(F.min("row").alias("_r"), F.collect_list(F.struct("row", "col", "text")).alias("_c"))
    head = lambda rx: F.array_max(F.transform(F.filter("_c", lambda c: (c["row"] == F.col("_r")) & c["text"].rlike(rx)), lambda c: c["col"]))
    t = t.select(*by, "_r", "_c", head(QUANTITY_HEADER).alias("qty"), head(ITEM_HEADER).alias("item"), head(SIZE_HEADER).alias("dim")).filter("qty is not null and item is not null")
    counted = F.size(F.filter("_c", lambda c: (c["row"] > F.col("_r")) & (c["col"] == F.col("qty")) & c["text"].rlike(r"^\d+\z")))
    return t.select(*by, "qty", "item", "dim", counted.alias("rows")).filter(F.col("rows") >= KIT_ROWS)


def differences(ledger: Column, store: Column) -> Column:
    """map(field: struct(ledger, store)) of the fields that differ; a missing one is null. Fields in order of name."""
    both = F.map_zip_with(ledger, store, lambda k, a, b: F.struct(a.alias("ledger"), b.alias("store")))
    unlike = F.map_filter(both, lambda k, v: ~v["ledger"].eqNullSafe(v["store"]))
    return F.map_from_entries(F.array_sort(F.map_entries(unlike)))


def curation_level(status: Column) -> Column:
    """2 where a person compared the reading, 1 where two families agree, else 0."""
    return F.coalesce(*[F.when(status == s, F.lit(n)) for s, n in CURATED.items()], F.lit(0))


def source_classes(filings: DataFrame, by: str, kind: Column, classes: dict[str, str], unclassified: tuple[str, ...], weakest: str) -> DataFrame:
    """(by, source_class, gap): the one class of all kinds that bytes are filed under; the weakest where none is
    classified; null, and the gap, where classes disagree. Kinds outside `classes` count as unclassified."""
    one = F.coalesce(*[F.when(kind == k, F.lit(c)) for k, c in classes.items() if k not in unclassified])
    g = filings.groupBy(by).agg(F.count_distinct(one).alias("_n"), F.min(one).alias("_c"))
    gap = F.when(F.col("_n") == 0, "source_class_unclassified").when(F.col("_n") > 1, "source_class_disagreement")
    return g.select(by, F.when(F.col("_n") == 0, F.lit(weakest)).when(F.col("_n") == 1, F.col("_c")).alias("source_class"), gap.alias("gap"))


def proposed(candidates: DataFrame, recorded: DataFrame, key: tuple[str, ...] = ("element_id", "start", "end")) -> DataFrame:
    """The candidates whose place is not on record, one a place: to append, so that proposing again adds nothing and a
    recorded row keeps its review."""
    return candidates.dropDuplicates(list(key)).join(recorded.select(*key), list(key), "left_anti")


def same_family(readings: DataFrame, cell: list[str], a: str, b: str, value: str = "value", illegible: str = "illegible", status: str = "review_status", identity: str = "candidate_id") -> DataFrame:
    """(identity): readings of two readers of one family that read a cell alike, the first one's still unreviewed.

    They are marked, not promoted. Groups by cell and folded value, so no pairs of readings are formed."""
    r = readings.filter(F.col("reader").isin(a, b) & ~F.col(illegible)).withColumn("_v", norm_reading(F.col(value).cast("string")))
    r = r.filter((F.col("reader") == b) | (F.col(status) == "unreviewed"))
    alike = r.groupBy(*cell, "_v").agg(F.count_distinct("reader").alias("_n")).filter("_n = 2")
    return r.join(alike, [*cell, "_v"], "left_semi").select(identity)


def value_lexemes(value: Column, alternates: Column) -> Column:
    """The value as printed, then its alternates in order: stripped, none empty, none twice."""
    return F.array_distinct(F.filter(F.concat(F.array(stripped(F.coalesce(value, F.lit("")))), F.transform(F.coalesce(alternates, F.array().cast("array<string>")), lambda x: stripped(F.coalesce(x, F.lit(""))))), lambda x: x != ""))


def published_basis(basis: Column) -> Column:
    return F.when(basis == "stated", "stated").otherwise("assumed")


def point_words(exposure: Column, zone: Column, others: dict[str, Column]) -> Column:
    """A domain's point in words, dimensions by name: exposure C, HVHZ or non-HVHZ, any other by its name and value."""
    parts = {"exposure_category": F.concat(F.lit("exposure "), exposure), "hvhz": F.when(zone, "HVHZ").when(~zone, "non-HVHZ")}
    parts |= {k: F.concat(F.lit(k.replace("_", " ") + " "), v.cast("string")) for k, v in others.items()}
    return F.coalesce(F.nullif(F.concat_ws(", ", *[parts[k] for k in sorted(parts)]), F.lit("")), F.lit("any conditions"))


def attachment(kind: Column, path: Column, sha: Column, step: str = r"(?i)^step\s*\d+") -> Column:
    """struct(kind, ref) that a warning belongs to: a warranty's bytes, the last step among its headings, the document."""
    last = F.try_element_at(F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda h: h.rlike(step)), F.lit(-1))
    to = lambda k, ref: F.struct(F.lit(k).alias("kind"), ref.alias("ref"))
    return F.when(kind == "warranty", to("warranty", sha)).when(last.isNotNull(), to("step", last)).otherwise(to("document", sha))


def seen_candidates(candidates: DataFrame, reviews: DataFrame, crop: str, identity: str, seen: str) -> DataFrame:
    """A review's candidates: those of its crop that it saw, none that were read later."""
    r = reviews.select("review_id", crop, F.explode(seen).alias(identity)).distinct()
    return r.join(candidates, [crop, identity])


def evidence_matches(wanted: DataFrame, facts: DataFrame, anchor: list[str], value: str, identity: str) -> DataFrame:
    """(anchor, value, facts, others): ids of the facts that carry this value on this anchor, and the other values there.

    Facts are gathered by anchor and value first, so that a row is a value, not a fact."""
    per = facts.groupBy(*anchor, value).agg(F.array_sort(F.collect_list(identity)).alias("_ids"))
    w = wanted.select(*anchor, F.col(value).alias("_w")).distinct().join(per, anchor, "left")
    hit = F.col(value) == F.col("_w")
    out = w.groupBy(*anchor, "_w").agg(F.array_sort(F.flatten(F.collect_list(F.when(hit, F.col("_ids"))))).alias("facts"), F.array_sort(F.collect_set(F.when(~hit, F.col(value)))).alias("others"))
    return out.withColumnRenamed("_w", value)
