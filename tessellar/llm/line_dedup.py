"""Line dedup [native]: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

Results in the odd cases: a null or empty text is one empty line and stays; a line whose key is shorter than
``min_chars`` stays; within the smallest doc_id that holds a key every occurrence stays; rows that repeat an id share
that id's standing (copies of one row under one id are one document); a null doc_id sorts before all others; an empty
table gives an empty table; columns besides doc_id and text are carried along by ``dedup_lines`` and never read,
whatever their names (only n_lines and n_dropped are replaced); a text of any length is split whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, columns, cut, fold_ascii, strip_space, unused

MIN_CHARS, MIN_DOCS = 10, 2


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row1, row2, id, pos, h1, h2): a row for each line long enough to count. 128 bits of hash stand for the key."""
    lines = docs.select("row1", "row2", "id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = lines.withColumn("key", fold_ascii(strip_space(F.col("line"))))
    return key.filter(F.length("key") >= min_chars).select("row1", "row2", "id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds id (never null), text (never null) and a row key that equal rows share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text.alias("text")).select("*", F.xxhash64("id", "text").alias("row1"), F.xxhash64(F.lit(29), "text", "id").alias("row2"))


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row1, row2, gone): sorted positions of the lines that go.

    The aggregation combines on the map side, so a line that every document holds costs a row a task. A key with more
    rows than a shuffle partition's share is hot: there are fewer hot keys than partitions, so they are broadcast and
    their lines stay where they are; the others meet their keys in a shuffle.
    """
    lines = cut(line_keys(keyed(columns(docs, "doc_id", "text")), min_chars), "lines")
    if min_docs == 2:
        held = lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.count("*").alias("n")).filter("last > keeper")
    else:
        some = lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
        held = lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.count("*").alias("n")).join(some, ["h1", "h2"])
    held = cut(held.select("h1", "h2", "keeper", "n"), "held")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, lines.count() // parts)
    hot = F.broadcast(held.filter(F.col("n") > share).select("h1", "h2", F.col("keeper").alias("kept")))  # fewer than `parts` rows
    spread = lines.join(hot, ["h1", "h2"], "left")
    here = spread.filter("kept is not null and id > kept")
    there = spread.filter("kept is null").drop("kept").join(held.filter(F.col("n") <= share), ["h1", "h2"]).filter("id > keeper")
    names = ["row1", "row2", "pos"]
    return here.select(*names).unionByName(there.select(*names)).groupBy("row1", "row2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text replaced by its kept lines, and n_lines and n_dropped added."""
    extra = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    one, two, gone, parts, edges = (unused(docs, f"{c}_of_lines") for c in ("row1", "row2", "gone", "parts", "edges"))
    full = docs.select(*[docs[c] for c in extra], F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    full = full.withColumns({one: F.xxhash64(key, F.col("text")), two: F.xxhash64(F.lit(29), F.col("text"), key)})
    lost = dropped_positions(docs, min_chars, min_docs).select(F.col("row1").alias(one), F.col("row2").alias(two), F.col("gone").alias(gone))
    full = full.join(lost, [one, two], "left").withColumn(gone, F.coalesce(gone, F.expr("cast(array() as array<int>)")))
    full = full.withColumn(parts, F.split("text", "\n", -1)).withColumn("n_lines", F.size(parts).cast("bigint"))
    full = full.withColumn("n_dropped", F.size(gone).cast("bigint"))
    # the kept lines are the slices between neighbouring dropped positions: linear in the number of lines
    full = full.withColumn(edges, F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(parts))))
    kept = F.expr(f"flatten(transform(sequence(0, size({edges}) - 2), i -> slice({parts}, {edges}[i] + 2, {edges}[i + 1] - {edges}[i] - 1)))")
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return full.select(*[F.col(f"`{c}`") for c in extra], text.alias("text"), "n_lines", "n_dropped")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, t.pos, t.line,
         translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) t),
held AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
flagged AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM lines l LEFT JOIN held h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
