"""Accessors of the canonical store and the steps between extraction and publication, as relational plans."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import edition_id
from ..functions.text import severity, warning_key
from .search import with_texts
from .versions import latest

# fixed values: wordings that state, or refuse, a manufactured length
SUPPLIED = r"(?:supplied|furnished|available|sold|packaged)\s+in\s+(\d+(?:\.\d+)?)\s*(foot|feet|ft\.?|inch(?:es)?|in\.?|')\s*(?:long\s+)?(?:lengths?|sections?|rails?)"
NOT_STOCK = r"insert\s+kit|fill\s+kits?|\bkit\b|\bheights?\b|\bhigh\b|\bwide\b|\bwidth\b|\bcut\s+to\b|\btrim\b|\bshorten|\bsubtract\b|\bSKU\b|Model\s*#|\bcent(?:er|re)s?\b|\bo\.?c\.?\b|\bspacing\b|\bapart\b|(?:shim|cap)\s+stock|\bin\s+stock\b"
COLOUR = r"\blengths?\s+for\s+([A-Z][A-Za-z]+)"
OTHER_COLOUR = r"(\d+(?:\.\d+)?)\s*(foot|feet|ft\.?|')\s*rails?\s+for\s+([A-Z][A-Za-z]+)"
STOCK_RANGE = (48.0, 288.0)
# fixed values: faults of extraction, the gap each leaves, and its code
GAPS = {"mojibake_text_layer": ("unread", "text_layer_unreadable"), "low_ocr_confidence": ("unread", "ocr_low_confidence"), "table_not_reconstructed": ("unread", "table_not_reconstructed"), "empty_page": ("missing", "page_empty"), "missing_image": ("missing", "page_image_missing")}


def document_record(documents: DataFrame, versions: DataFrame, relations: DataFrame, issues: DataFrame, identifier: str) -> DataFrame:
    """One row: a document by id or path, its versions, relations and issues gathered in order."""
    d = documents.filter((F.col("document_id") == identifier) | (F.col("source_path") == identifier))
    gather = lambda df, key, cols, name: df.groupBy(F.col(key).alias("document_id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    keys = d.select("document_id")
    near = lambda df, key: df.join(keys.withColumnRenamed("document_id", key), key, "left_semi")
    out = d.join(gather(near(versions, "document_id"), "document_id", ["ingested_at", "version_id"], "versions"), "document_id", "left")
    out = out.join(gather(near(relations, "from_id"), "from_id", ["relation", "to_id"], "relations"), "document_id", "left")
    return out.join(gather(near(issues, "document_id"), "document_id", ["page_no", "kind"], "issues"), "document_id", "left")


def page_elements(elements: DataFrame, versions: DataFrame, by: list[str]) -> DataFrame:
    """Each page's elements in order, of its newest version (ties: the larger id)."""
    newest = latest(versions, ["document_id"], [F.col("ingested_at").desc(), F.col("version_id").desc()]).select("version_id")
    e = elements.join(newest, "version_id", "left_semi")
    return e.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("elements"))


def context(elements: DataFrame, targets: DataFrame, before: int, after: int, width: int = 600) -> DataFrame:
    """(element_id, near_id, text): neighbours on the page by ordinal, all elements of the pages next to it, not the
    element itself. Dealt by (document, page): a target is copied to the three pages it looks at."""
    t = targets.select("element_id", "document_id", F.col("page_no").alias("at"), F.col("ordinal").alias("o"), F.explode(F.sequence(F.col("page_no") - 1, F.col("page_no") + 1)).alias("page_no"))
    e = elements.select(F.col("element_id").alias("near_id"), "document_id", "page_no", "ordinal", F.substring("text", 1, width).alias("text"))
    j = t.join(e, ["document_id", "page_no"])
    near = (F.col("page_no") != F.col("at")) | F.col("ordinal").between(F.col("o") - before, F.col("o") + after)
    return j.filter(near & (F.col("element_id") != F.col("near_id"))).select("element_id", "near_id", "text")


def lookup_normalised(wanted: DataFrame, candidates: DataFrame, page: str, norm: Column, raw: str, repair: str, identity: str) -> DataFrame:
    """(wanted's columns, identity): by page and normalised text, the raw reading before the repaired one, then the id."""
    c = candidates.select(page, identity, F.explode(F.array(F.struct(F.lit(0).alias("pref"), F.col(raw).alias("t")), F.struct(F.lit(1).alias("pref"), F.col(repair).alias("t")))).alias("c")).select(page, identity, "c.pref", F.col("c.t").alias("_t")).filter("_t is not null")
    best = c.withColumn("_k", norm_of(F.col("_t"))).groupBy(page, "_k").agg(F.min_by(identity, F.struct("pref", identity)).alias(identity))
    return wanted.withColumn("_k", norm).join(best, [page, "_k"], "left").drop("_k")


def norm_of(x: Column) -> Column:
    from ..functions.text import norm_step

    return norm_step(x)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def link_replacements(values: DataFrame) -> DataFrame:
    """(value_id, replaced_by): the values of the same answer whose authority supersedes this one's."""
    after = values.select("query", "value_id", F.explode("superseded_by").alias("authority"))
    other = values.select("query", "authority", F.col("value_id").alias("by"))
    return after.join(other, ["query", "authority"]).groupBy("query", "value_id").agg(F.array_sort(F.collect_set("by")).alias("replaced_by"))


def page_ceiling(results: DataFrame, pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(question_id, ceiling): the most of an answer's terms that all the text of one returned page could hold."""
    p = with_texts(results.select("question_id", "doc_id").distinct(), pages).join(terms, "question_id")
    hit = F.size(F.filter("terms", lambda t: F.instr(F.lower("text"), t) > 0)) / F.size("terms")
    return p.groupBy("question_id").agg(F.round(F.max(hit), 6).alias("ceiling"))


def identity_family(x: Column) -> Column:
    return F.regexp_replace(x, "/[^/]*$", "")


def reachable(objects: DataFrame, declared: DataFrame) -> DataFrame:
    """(snapshot, family, objects, declared): how many objects of each family a consumer can reach."""
    o = objects.groupBy("snapshot", identity_family(F.col("identity")).alias("family")).agg(F.count_distinct("identity").alias("objects"))
    return o.join(declared.select("family", F.lit(True).alias("_d")).distinct(), "family", "left").select("snapshot", "family", "objects", F.coalesce("_d", F.lit(False)).alias("declared"))


def worst(rows: DataFrame, by: str, count: Column) -> DataFrame:
    """The group with most, ties by name."""
    n = rows.groupBy(by).agg(count.alias("n"))
    return n.agg(F.max(F.struct("n", by)).alias("w")).select(f"w.{by}", "w.n")


def stock_length(x: Column, element_type: Column, text_source: Column) -> Column:
    """struct(inches, colour, basis) of a supplied length; null where it is none or the kind of text cannot state one."""
    n = F.regexp_extract(x, "(?i)" + SUPPLIED, 1).try_cast("double")
    feet = F.lower(F.regexp_extract(x, "(?i)" + SUPPLIED, 2)).rlike("^(foot|feet|ft|')")
    inches = F.when(feet, n * 12).otherwise(n)
    colour = F.nullif(F.regexp_extract(x, COLOUR, 1), F.lit(""))
    usable = ~F.coalesce(element_type.isin("drawing", "drawing_label", "figure", "ocr_supplement"), F.lit(False)) & ~F.coalesce(text_source.isin("ocr", "image_ocr"), F.lit(False)) & ~x.rlike("(?i)" + NOT_STOCK)
    return F.when(usable & inches.between(*STOCK_RANGE), F.struct(inches.alias("inches"), colour.alias("colour"), F.when(colour.isNotNull(), "stated").otherwise("unexamined").alias("basis")))


def other_lengths(text: str) -> list[tuple[float, str]]:
    """(inches, colour) of the lengths that other colours come in."""
    return [(float(m[1]) * 12, m[3]) for m in re.finditer("(?i)" + OTHER_COLOUR, text)]


def warnings(elements: DataFrame, by: list[str]) -> DataFrame:
    """(key, lexeme, text, cites): lines that start with a warning's lexeme; a bare lexeme takes the next line of its
    page as its body; equal warnings are one, with every place that prints them."""
    w = Window.partitionBy(*by).orderBy("ordinal")
    e = elements.withColumn("_next", F.lead("text").over(w)).withColumn("lexeme", severity(F.col("text"))).filter("lexeme is not null")
    alone = F.trim("text").rlike(r"(?i)^\W*\w+\W*$")
    e = e.withColumn("full", F.when(alone, F.concat_ws(" ", "text", "_next")).otherwise(F.col("text")))
    e = e.filter(F.length("full") - F.length("lexeme") >= 12)
    return e.groupBy(warning_key(F.col("full")).alias("key"), "lexeme").agg(F.min_by("full", "element_id").alias("text"), F.array_sort(F.collect_set("element_id")).alias("cites"))


def issue_gaps(issues: DataFrame, backing: DataFrame) -> DataFrame:
    """(document_id, page_no, kind, code, severity): a gap for each known fault of extraction, informational where the
    fault was only noted, a warning exactly where the document backs a published value."""
    kinds = F.create_map(*[F.lit(x) for k, (a, b) in GAPS.items() for x in (k, f"{a}|{b}")])
    g = issues.withColumn("_g", F.try_element_at(kinds, F.col("kind"))).filter("_g is not null")
    b = backing.select("document_id").distinct().withColumn("_b", F.lit(True))
    level = F.when(F.col("severity") == "info", "informational").when(F.col("_b"), "warns_line").otherwise("informational")
    part = lambda i: F.split_part("_g", F.lit("|"), F.lit(i))
    return g.join(b, "document_id", "left").select("document_id", "page_no", part(1).alias("gap_kind"), part(2).alias("code"), level.alias("level")).distinct()


def table_block(lines: DataFrame, by: list[str], width: float = 14.0) -> DataFrame:
    """Whether a block's lines start and break at the same few places: (by, tabular)."""
    starts = lines.groupBy(*by, F.round(F.col("x0") / width).alias("_c")).agg(F.count_distinct("row").alias("n"))
    rows = lines.groupBy(*by).agg(F.count_distinct("row").alias("rows"))
    j = starts.join(rows, by)
    return j.groupBy(*by).agg((F.count_if((F.col("n") >= 2) & (F.col("n") * 2 >= F.col("rows"))) >= 2).alias("tabular"))


def equivalents(paths: DataFrame, same: DataFrame) -> DataFrame:
    """paths and the paths filed with the same content, one step away."""
    near = paths.join(same.select(F.col("a").alias("path"), F.col("b").alias("_o")), "path").select(*[F.col("_o").alias("path") if c == "path" else c for c in paths.columns])
    return paths.unionByName(near).distinct()


def parameter_rows(facts: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, gaps): facts of registered types with a value and known conditions become rows of their parameter's
    table; the others say why not."""
    j = facts.join(registry, "fact_type", "left")
    why = F.when(F.col("parameter").isNull(), "unmapped").when(F.col("value").isNull(), "unquantified").when(F.size(F.array_except(F.map_keys("conditions"), "dimensions")) > 0, "undeclared")
    j = j.withColumn("why", why)
    return j.filter("why is null").drop("why"), j.filter("why is not null").select("fact_id", "fact_type", "why")


def domains(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(parameter, dimension, values, basis): the declared list of a dimension, else what was observed."""
    seen = rows.select("parameter", F.explode("conditions").alias("dimension", "value")).groupBy("parameter", "dimension").agg(F.array_sort(F.collect_set("value")).alias("seen"))
    j = seen.join(declared, "dimension", "left")
    return j.select("parameter", "dimension", F.coalesce("declared", "seen").alias("values"), F.when(F.col("declared").isNotNull(), "declared").otherwise("observed").alias("basis"))


def procedures(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, steps, waiting): decided steps with a kind, in print order, and how many still wait."""
    ready = F.col("review_status").isin("accepted", "corrected") & F.col("kind").isNotNull()
    at = F.when(ready, F.struct("ordinal", "start", "kind", "text"))
    return steps.groupBy(*by).agg(F.array_sort(F.array_compact(F.collect_list(at))).alias("steps"), F.count_if(~ready & (F.col("review_status") != "rejected")).alias("waiting"))


def source_warnings(filings: DataFrame) -> DataFrame:
    """(sha256, codes): what a reader should know of a source, over all documents it is filed under, in order."""
    any_ = lambda c: F.max(c.cast("int")) == 1
    g = filings.groupBy("sha256").agg(
        any_(F.col("version_status") == "superseded").alias("s"), any_(F.col("version_status") == "unknown").alias("u"), any_(F.col("ocr")).alias("o"), any_(F.col("mojibake")).alias("m"),
        (F.count_distinct("document_id") > 1).alias("d"),
    )
    code = lambda c, name: F.when(F.col(c), F.lit(name))
    codes = F.array_compact(F.array(code("d", "content_duplicated"), code("s", "document_superseded"), code("o", "text_from_ocr"), code("m", "text_layer_mojibake"), code("u", "version_status_unknown")))
    return g.select("sha256", F.array_sort(codes).alias("codes")).filter(F.size("codes") > 0)


def purchase_lines(stations: DataFrame, bays: DataFrame, rules: DataFrame) -> DataFrame:
    """(layout, target, quantity): bays and stations by the quantity their rule gives each."""
    n = bays.groupBy("layout").agg(F.count("*").alias("n")).withColumn("target", F.lit("panel_kit"))
    s = stations.groupBy("layout").agg(F.count("*").alias("n")).withColumn("target", F.explode(F.array(F.lit("post"), F.lit("post_cap"))))
    return n.unionByName(s).join(rules, "target").select("layout", "target", (F.col("n") * F.col("each")).alias("quantity"))


def revocable(promoted: DataFrame, decided: DataFrame, on: str) -> DataFrame:
    """Promotions that no person decided."""
    return promoted.join(decided.filter(F.col("review_status").isin("accepted", "corrected")).select(on).distinct(), on, "left_anti")


def ocr_recall(readings: DataFrame, pages: DataFrame, on: list[str]) -> DataFrame:
    """(reader, values, found): how many values that a reader read are in their page's text."""
    j = readings.filter("value is not null and not illegible").join(pages, on)
    return j.groupBy("reader").agg(F.count("*").alias("values"), F.count_if(F.instr(F.lower("page_text"), F.lower("value")) > 0).alias("found"))


def edition_names(rows: DataFrame) -> DataFrame:
    """rows with a version_id: the first toolchain on a content has the plain name, others carry their fingerprint."""
    first = rows.groupBy("document_id", "sha256").agg(F.min_by("fingerprint", F.struct("ingested_at", "fingerprint")).alias("_f"))
    j = rows.join(first, ["document_id", "sha256"])
    plain = edition_id(F.col("document_id"), F.col("sha256"))
    return j.withColumn("version_id", F.when(F.col("fingerprint") == F.col("_f"), plain).otherwise(edition_id(F.col("document_id"), F.col("sha256"), F.col("fingerprint")))).drop("_f")


def renamed(x: Column, names: dict[str, str]) -> Column:
    """A migration's new name of a type, or the old one."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x), x)


def slot(x: Column) -> Column:
    """struct(target, part) of 'Target (part)'; null otherwise."""
    rx = r"^\s*([^()]+?)\s*\(([^()]+)\)\s*$"
    return F.when(x.rlike(rx), F.struct(F.regexp_extract(x, rx, 1).alias("target"), F.trim(F.regexp_extract(x, rx, 2)).alias("part")))


def mentioned_paths(reports: DataFrame, text: str) -> DataFrame:
    """Paths that reports mention, which keeps those files alive."""
    return reports.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[\w./-]+/[\w.-]+\.\w+"), F.lit(0))).alias("path")).distinct()


def first_present(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns by their first alias that is there and not null: one shape for files that spell their keys differently."""
    none = F.lit(None).cast("string")
    return rows.select(*[reduce(F.coalesce, [F.col(a) for a in aliases if a in rows.columns] or [none]).alias(n) for n, aliases in names.items()])


def write_edition(rows: DataFrame, path: str, by: str = "version_id") -> None:
    """Rows of editions replace those editions' rows and no others: a rerun changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
