"""A folder's files as a manifest, curated metadata, incremental ingestion, readings and the review ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_id

SCAN_CHARS = 60


def inspect(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(source_path, file_type, bytes, sha256) of all files under a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select(F.col("path").alias("source_path"), suffix.alias("file_type"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), document_id(F.col("path")).alias("document_id"))


def route(file_type: Column, pages: Column, chars: Column) -> Column:
    """How a file is read: its text layer, OCR where a page has hardly any text, or by its own format."""
    return F.when(file_type == "pdf", F.when(chars / F.greatest(pages, F.lit(1)) < SCAN_CHARS, "ocr").otherwise("text_layer")).when(file_type.isin("html", "htm"), "html").when(file_type == "docx", "docx").when(file_type.isin("png", "jpg", "jpeg"), "image").otherwise("unsupported")


def version_status(path: Column, curated: Column) -> Column:
    """superseded before active, from a path's or a curator's words; else unknown."""
    words = F.lower(F.concat_ws(" ", path, curated))
    return F.when(words.rlike(r"superseded|obsolete|expired|archive|old"), "superseded").when(words.rlike(r"active|current|in[ _-]force"), "active").otherwise("unknown")


def first_of(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each key's first entry, and the later ones kept beside it."""
    all_rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    g = rows.groupBy(key).agg(all_rows.alias("_e"))
    return g.select(key, *[F.col("_e")[0][c].alias(c) for c in columns], F.slice("_e", 2, F.greatest(F.size("_e") - 1, F.lit(1))).alias("duplicates"))


def manifest(found: DataFrame, curated: DataFrame) -> DataFrame:
    """Files on disk with their curated metadata, and curated paths that are not on disk, in order of the path."""
    there = found.join(curated, "source_path", "left").withColumn("on_disk", F.lit(True))
    gone = curated.join(found.select("source_path"), "source_path", "left_anti").withColumn("on_disk", F.lit(False))
    return there.unionByName(gone, allowMissingColumns=True).orderBy("source_path")


def targets(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """wanted paths with their state: ready, not_fetched, stale (other bytes than listed) or unknown."""
    j = wanted.join(listed.select("source_path", F.col("sha256").alias("_listed"), "on_disk", F.col("disk_sha256").alias("_disk")), "source_path", "left")
    state = F.when(F.col("on_disk").isNull(), "unknown").when(~F.col("on_disk"), "not_fetched").when(F.col("_listed") != F.col("_disk"), "stale").otherwise("ready")
    return j.withColumn("state", state).drop("_listed", "_disk", "on_disk")


def not_ingested(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files whose (document, bytes, toolchain) is not in the store: what an ingestion has to read."""
    return files.join(versions.select("document_id", "sha256", "tool_fingerprint").distinct(), ["document_id", "sha256", "tool_fingerprint"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, fixed: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): new values over old ones column by column; a changed owner is refused and its row stays."""
    cols = [c for c in old.columns if c != key]
    j = old.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_in")).join(new, key, "full")
    clash = F.coalesce(F.col("_in") & F.col(fixed).isNotNull() & ~F.col(fixed).eqNullSafe(F.col(f"_{fixed}")), F.lit(False))
    j = j.withColumn("_clash", clash)
    rows = j.select(key, *[F.when(F.col("_clash"), F.col(f"_{c}")).otherwise(F.coalesce(c, f"_{c}")).alias(c) for c in cols])
    return rows, j.filter("_clash").select(key, F.col(f"_{fixed}").alias("held"), F.col(fixed).alias("offered"))


def with_columns(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """An additive migration: columns that are missing come as nulls of their type."""
    return reduce(lambda df, c: df.withColumn(c, F.lit(None).cast(schema[c])), [c for c in schema if c not in rows.columns], rows)


READING = "crop_path string, source_path string, page_no int, reader string, is_table boolean, grid struct<headers: array<string>, rows: array<struct<cells: array<string>, illegible: array<int>>>>, notes string"


def readings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row a cell of table readings (JSON files); a page without a table is one row at (-1, -1)."""
    raw = spark.read.schema(READING).option("multiLine", "true").json(paths)
    keep = ["crop_path", "source_path", "page_no", "reader"]
    page = raw.filter("not is_table").select(*keep, F.lit(-1).alias("row_index"), F.lit(-1).alias("col_index"), F.lit(None).cast("string").alias("row_label"), F.lit(None).cast("string").alias("col_label"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("illegible"))
    rows = raw.filter("is_table").select(*keep, F.col("grid.headers").alias("h"), F.posexplode("grid.rows").alias("row_index", "r"))
    cells = rows.select(*keep, "h", "row_index", "r", F.posexplode("r.cells").alias("col_index", "value"))
    bad = F.coalesce(F.array_contains("r.illegible", F.col("col_index")), F.lit(False)) | F.coalesce(F.contains("value", F.lit("?")), F.lit(False))
    out = cells.select(*keep, "row_index", "col_index", F.col("r.cells")[0].alias("row_label"), F.try_element_at("h", F.col("col_index") + 1).alias("col_label"), "value", bad.alias("illegible"))
    return out.unionByName(page)


LEDGER = "kind string, id string, anchor string, reviewer string, reviewed_at string, verdict string, value string"


def write_ledger(reviews: DataFrame, path: str) -> None:
    """Records as JSON lines in a fixed order, behind a line that counts them. A ledger is a published file of people's
    decisions: one file, sorted."""
    rows = reviews.select(*[c.split()[0] for c in LEDGER.split(", ")])
    body = rows.select(F.lit(1).alias("part"), F.struct("kind", "anchor", "reviewed_at", "id").alias("at"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    n = rows.agg(F.lit(0).alias("part"), F.lit(None).cast(body.schema["at"].dataType).alias("at"), F.to_json(F.struct(F.lit("header").alias("kind"), F.count("*").alias("count"))).alias("value"))
    n.unionByName(body).orderBy("part", "at").select("value").coalesce(1).write.mode("errorifexists").text(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A strict read: a line that does not parse, or a count that does not hold, ends it."""
    raw = spark.read.text(path).filter(F.length("value") > 0)
    head = raw.filter(F.get_json_object("value", "$.kind") == "header").select(F.get_json_object("value", "$.count").cast("bigint").alias("n")).collect()
    body = raw.filter(F.get_json_object("value", "$.kind") != "header").select(F.from_json("value", LEDGER, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if len(head) != 1 or head[0]["n"] != body.count():
        raise ValueError("the ledger's count does not hold")
    return body
