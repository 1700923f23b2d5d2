"""Registered queries on validation, layout levels and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from ..operators import records as rc
from ..operators import validation as va
from ..sources.tables import table
from .audits import BOXES, _boxes


def shape_violations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("sorted", F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 7))
    rules = {"priority": F.col("o_orderpriority").rlike("^[1-5]-"), "status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 1000, "order": va.distinct_in_order(F.col("sorted"))}
    return va.violations(o, "o_orderkey", rules)


SHAPES = r"""
SELECT o_orderkey, 'priority' AS rule FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-') UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE NOT o_totalprice > 1000 UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE NOT o_custkey % 5 < o_custkey % 7"""


def expected_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type")
    return va.differences(e.filter("user_id % 2 = 0 or event_type = 'click'"), e.filter("user_id % 3 = 0")).groupBy("side", "event_type").agg(F.count("*").alias("n"))


EXPECTED = """
WITH g AS (SELECT user_id, event_type, count(*) FILTER (user_id % 2 = 0 OR event_type = 'click') AS a, count(*) FILTER (user_id % 3 = 0) AS b FROM events GROUP BY ALL)
SELECT 'missing' AS side, event_type, CAST(sum(a - b) AS BIGINT) AS n FROM g WHERE a > b GROUP BY event_type UNION ALL SELECT 'unexpected', event_type, CAST(sum(b - a) AS BIGINT) FROM g WHERE b > a GROUP BY event_type"""


def _decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations")
    held = c.filter("turn > 0").select(F.concat_ws("#", "conv_id", "turn").alias("anchor"), "text")
    dec = c.select(F.when(F.col("turn") == 5, F.concat_ws("#", "conv_id", F.lit(4))).otherwise(F.concat_ws("#", "conv_id", "turn")).alias("anchor"), F.when(F.col("conv_id") % 9 != 0, F.lit("me")).alias("reviewer"), F.when(F.col("turn") % 3 == 0, "accepted").when(F.col("turn") % 3 == 1, "rejected").otherwise("maybe").alias("verdict"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("kind"), F.col("text").alias("text_seen"))
    return dec, held


def decision_faults(spark: SparkSession, d: str) -> DataFrame:
    dec, held = _decisions(spark, d)
    return va.decision_faults(dec, held, ["accepted", "corrected", "rejected"], ["user"]).groupBy("fault").agg(F.count("*").alias("anchors"))


DECISIONS = """
WITH dec AS (SELECT conv_id || '#' || CASE WHEN turn = 5 THEN 4 ELSE turn END AS anchor, CASE WHEN conv_id % 9 <> 0 THEN 'me' END AS reviewer, CASE turn % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'maybe' END AS verdict,
 CASE WHEN turn % 2 = 0 THEN role END AS kind, text FROM conversations),
h AS (SELECT conv_id || '#' || turn AS anchor, text AS held FROM conversations WHERE turn > 0),
j AS (SELECT dec.*, held, count(*) OVER (PARTITION BY dec.anchor) > 1 AS twice FROM dec LEFT JOIN h USING (anchor)),
f AS (SELECT anchor, 'no reviewer' AS fault FROM j WHERE reviewer IS NULL UNION SELECT anchor, 'unknown verdict' FROM j WHERE verdict = 'maybe' UNION SELECT anchor, 'unknown kind' FROM j WHERE kind IS NOT NULL AND kind <> 'user'
 UNION SELECT anchor, 'accepted without a kind' FROM j WHERE verdict = 'accepted' AND kind IS NULL UNION SELECT anchor, 'text moved' FROM j WHERE text IS DISTINCT FROM held UNION SELECT anchor, 'decided twice' FROM j WHERE twice)
SELECT fault, count(*) AS anchors FROM f GROUP BY fault"""


def batch_refused(spark: SparkSession, d: str) -> DataFrame:
    """One faulty decision keeps the whole batch out."""
    dec, held = _decisions(spark, d)
    faults = va.decision_faults(dec, held, ["accepted", "corrected", "rejected"], ["user"])
    return va.apply_all_or_nothing(dec, faults).agg(F.count("*").alias("applied"))


def echo_faults(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    seen = c.select(F.concat_ws("#", "conv_id", "turn").alias("review_id"), F.concat_ws("#", "conv_id", "turn").alias("anchor"), "role", F.when(F.col("turn") % 5 == 0, F.lower("text")).otherwise(F.col("text")).alias("text"))
    held = c.filter("conv_id % 7 <> 0").select(F.concat_ws("#", "conv_id", "turn").alias("anchor"), F.when(F.col("turn") % 4 == 0, "other").otherwise(F.col("role")).alias("role"), "text")
    return va.echo_faults(seen, held, "anchor", ["role", "text"])


ECHO = """
WITH c AS (SELECT *, conv_id || '#' || turn AS id FROM conversations)
SELECT id AS review_id, 'gone' AS fault FROM c WHERE conv_id % 7 = 0 UNION ALL SELECT id, 'role moved' FROM c WHERE conv_id % 7 <> 0 AND turn % 4 = 0 UNION ALL SELECT id, 'text moved' FROM c WHERE conv_id % 7 <> 0 AND turn % 5 = 0 AND lower(text) <> text"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_partkey", (8 + F.col("p_size") % 6 + F.when(F.col("p_partkey") % 40 == 0, 12).otherwise(0)).cast("double").alias("height"), F.col("p_name").alias("text"))


LINE = "ln AS (SELECT p_brand, p_partkey, CAST(8 + p_size % 6 + CASE WHEN p_partkey % 40 = 0 THEN 12 ELSE 0 END AS DOUBLE) AS height, p_name AS text FROM part), sz AS (SELECT p_brand, round(height, 1) AS size, sum(length(text)) AS chars FROM ln GROUP BY ALL), bs AS (SELECT p_brand, arg_max(size, (chars, -size)) AS body_size FROM sz GROUP BY p_brand)"


def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    return layout.body_size(_lines(spark, d), ["p_brand"])


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    return layout.heading_levels(x, layout.body_size(x, ["p_brand"]), ["p_brand"]).filter("level is not null").select("p_brand", "p_partkey", F.col("level").cast("bigint").alias("level"))


LEVELS = f"""
WITH {LINE}, big AS (SELECT DISTINCT p_brand, round(height, 1) AS size FROM ln JOIN bs USING (p_brand) WHERE height > body_size * 1.15), lv AS (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY size DESC) AS level FROM big)
SELECT ln.p_brand, p_partkey, level FROM ln JOIN lv ON ln.p_brand = lv.p_brand AND round(ln.height, 1) = lv.size WHERE level <= 4"""


def tabular_grids(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("row"), (F.col("l_partkey") % 4).cast("int").alias("col"), F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).when(F.col("l_suppkey") % 7 == 0, F.lit("cut off")).otherwise(F.lit("VALUE")).alias("text"))
    g = li.groupBy("l_orderkey", "row", "col").agg(F.max("text").alias("text"))
    return layout.looks_tabular(g, ["l_orderkey"])


TABULAR = """
WITH g AS (SELECT l_orderkey, l_linenumber AS r, l_partkey % 4 AS c, max(CASE WHEN l_suppkey % 3 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN 'cut off' ELSE 'VALUE' END) AS t FROM lineitem GROUP BY ALL),
a AS (SELECT l_orderkey, max(r) + 1 AS rows_, max(c) + 1 AS cols_, count(*) FILTER (t <> '') AS filled, quantile_cont(length(t), 0.5) FILTER (t <> '') AS med, count(*) FILTER (t = 'cut off') AS cut FROM g GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(rows_ >= 2 AND cols_ >= 2 AND filled / (rows_ * cols_) >= 0.35 AND med <= 40 AND cut / greatest(1, filled) <= 0.25, false) AS tabular FROM a"""


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    return layout.union_box(_boxes(spark, d), ["page"])


def equivalent_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("p"), F.sha2("text", 256).alias("h"))
    g = docs.groupBy("h").agg(F.min("p").alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = docs.join(g, "h").filter("p <> first").select(F.col("first").alias("a"), F.col("p").alias("b"))
    wanted = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("path"))
    return rc.equivalents(wanted, same).agg(F.count("*").alias("paths"), F.sum("path").alias("total"))


EQUIVALENT = """
WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents), w AS (SELECT doc_id AS path FROM labels WHERE quality = 1),
u AS (SELECT path FROM w UNION SELECT g.doc_id FROM w JOIN g ON w.path = g.first AND g.doc_id <> g.first) SELECT count(*) AS paths, CAST(sum(path) AS BIGINT) AS total FROM u"""


def routed_summary(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    before = lab.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("passed"))
    after = lab.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("category"), (F.col("toxic") == 0).alias("passed"))
    return va.routed(before, after)


ROUTED = """
WITH x AS (SELECT lang AS category, toxic = 0 AS a, coalesce(doc_id % 3 <> 0 AND quality = 1, false) AS b FROM labels JOIN documents USING (doc_id))
SELECT category, count(*) AS questions, count(*) FILTER (b) AS before, count(*) FILTER (a) AS after, count(*) FILTER (a AND NOT b) AS gained, count(*) FILTER (b AND NOT a) AS lost FROM x GROUP BY category"""

_Q = {
    shape_violations: SHAPES, expected_rows: EXPECTED, decision_faults: DECISIONS, batch_refused: "SELECT CAST(0 AS BIGINT) AS applied", echo_faults: ECHO, body_sizes: f"WITH {LINE} SELECT p_brand, body_size FROM bs",
    heading_levels: LEVELS, tabular_grids: TABULAR, page_boxes: f"WITH {BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM bx GROUP BY page", equivalent_paths: EQUIVALENT, routed_summary: ROUTED,
}
QUERIES = {f.__name__: f for f in _Q}
SQL = {f.__name__: q for f, q in _Q.items()}
