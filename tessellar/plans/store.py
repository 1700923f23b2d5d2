"""Registered queries on the store's accessors, on what lies between extraction and publication, and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import records as rc
from ..sources.shared import scratch
from ..sources.tables import lines, table
from ..streaming.ingest import counts_by_window
from .audits import RESULTS, _results
from .corpus import LINES, TOKENS


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of every even document; the second is the newer, but for every sixth."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    v = docs.withColumn("n", F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return v.select(F.col("doc_id").alias("document_id"), F.concat_ws("@", "doc_id", "n").alias("version_id"), F.when(F.col("doc_id") % 6 == 0, 0).otherwise(F.col("n")).alias("ingested_at"))


def document_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat_ws("/", "source", "doc_id").alias("source_path"))
    rel = table(spark, d, "conversations").select(F.col("conv_id").alias("from_id"), F.lit("cites").alias("relation"), F.col("turn").alias("to_id"))
    issues = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("document_id"), F.col("toxic").alias("page_no"), F.lit("quality").alias("kind"))
    r = rc.document_record(docs, _versions(spark, d), rel, issues, "24")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return r.select("document_id", "source_path", F.greatest(size("versions"), F.lit(0)).alias("versions"), F.greatest(size("relations"), F.lit(0)).alias("relations"), F.greatest(size("issues"), F.lit(0)).alias("issues"))


DOCUMENT_RECORDS = """
SELECT doc_id AS document_id, source || '/' || doc_id AS source_path, CAST(2 AS BIGINT) AS versions, (SELECT count(*) FROM conversations WHERE conv_id = 24) AS relations,
 (SELECT count(*) FROM labels WHERE doc_id = 24 AND quality = 0) AS issues FROM documents WHERE doc_id = 24"""


def newest_pages(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    e = lines(spark, d).join(v.select(F.col("document_id").alias("doc_id"), "version_id"), "doc_id").select("version_id", "doc_id", "ordinal", F.col("line").alias("text"))
    p = rc.page_elements(e, v, ["version_id", "doc_id"])
    return p.select("doc_id", "version_id", F.size("elements").cast("bigint").alias("elements"), F.length(F.array_join(F.col("elements")["text"], "\n")).cast("bigint").alias("chars"))


NEWEST_PAGES = "SELECT doc_id, doc_id || '@' || CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS elements, CAST(length(text) AS BIGINT) AS chars FROM documents"


def page_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines as elements, ten to a page: what stands around each document's line 25."""
    e = lines(spark, d).select(F.concat_ws("#", "doc_id", "ordinal").alias("element_id"), F.col("doc_id").alias("document_id"), F.expr("ordinal div 10").alias("page_no"), "ordinal", F.col("line").alias("text"))
    c = rc.context(e, e.filter("ordinal = 25"), 2, 1)
    return c.groupBy("element_id").agg(F.count("*").alias("near"), F.sum(F.length("text")).alias("chars"))


PAGE_CONTEXT = f"""
WITH l AS (SELECT * FROM {LINES}) SELECT a.doc_id || '#25' AS element_id, count(*) AS near, CAST(sum(length(substr(b.line, 1, 600))) AS BIGINT) AS chars
FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.ordinal = 25 AND b.ordinal <> 25 AND (b.ordinal BETWEEN 10 AND 19 OR b.ordinal BETWEEN 30 AND 39 OR b.ordinal BETWEEN 23 AND 26) GROUP BY a.doc_id"""


def proposal_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Proposals by normalised text: each brand's types, as bullets in capitals, against its parts."""
    p = table(spark, d, "part")
    wanted = p.select("p_brand", "p_type").distinct().withColumn("said", F.concat(F.lit("• "), F.upper("p_type"), F.lit(" ")))
    c = p.select("p_brand", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("raw"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")).alias("repair"), "p_partkey")
    return rc.lookup_normalised(wanted, c, "p_brand", tx.norm_step(F.col("said")), "raw", "repair", "p_partkey").select("p_brand", "p_type", "p_partkey")


PROPOSALS = "SELECT p_brand, p_type, coalesce(min(p_partkey) FILTER (p_partkey % 3 = 0), min(p_partkey) FILTER (p_partkey % 3 = 1)) AS p_partkey FROM part GROUP BY ALL"


def replacement_links(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("value_id"), F.col("l_linenumber").alias("authority"), F.array((F.col("l_linenumber") + 1), F.col("l_linenumber") + 3).alias("superseded_by"))
    return rc.link_replacements(li).select("query", "value_id", F.array_join(F.col("replaced_by").cast("array<string>"), ",").alias("replaced_by"))


REPLACEMENTS = "SELECT a.l_orderkey AS query, a.l_linenumber AS value_id, string_agg(DISTINCT CAST(b.l_linenumber AS VARCHAR), ',' ORDER BY CAST(b.l_linenumber AS VARCHAR)) AS replaced_by FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber IN (a.l_linenumber + 1, a.l_linenumber + 3) GROUP BY ALL"


def page_ceiling(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.array_distinct(tx.tokens(F.col("text"))).alias("terms"))
    return rc.page_ceiling(_results(spark, d).filter("rank <= 3"), table(spark, d, "documents").select("doc_id", "text"), terms)


CEILING = f"""
WITH {RESULTS}, b AS (SELECT item_id AS question_id, list_distinct({TOKENS}) AS terms FROM benchmark)
SELECT question_id, round(max(len(list_filter(terms, lambda t: contains(lower(d.text), t))) / len(terms)), 6) AS ceiling FROM results JOIN documents d USING (doc_id) JOIN b USING (question_id) WHERE rank <= 3 GROUP BY question_id"""


def reachability(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_size") % 3).cast("string").alias("snapshot"), F.concat_ws("/", F.lit("mfr"), "p_brand", "p_partkey").alias("identity"))
    declared = table(spark, d, "part").filter("p_brand like '%1'").select(F.concat_ws("/", F.lit("mfr"), "p_brand").alias("family"))
    return rc.reachable(p, declared)


REACH = "SELECT CAST(p_size % 3 AS VARCHAR) AS snapshot, 'mfr/' || p_brand AS family, count(*) AS objects, p_brand LIKE '%1' AS declared FROM part GROUP BY ALL"


def stock_lengths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = F.concat(F.lit("Rails are supplied in "), F.col("p_size").cast("string"), F.lit(" foot lengths"), F.when(k % 3 == 0, " for White").when(k % 3 == 1, " by the kit").otherwise("."))
    s = rc.stock_length(x, F.lit("paragraph"), F.when(k % 5 == 0, "ocr").otherwise("pdf_text_layer"))
    return table(spark, d, "part").select("p_partkey", s["inches"].alias("inches"), s["colour"].alias("colour"), s["basis"].alias("basis")).filter("inches is not null")


STOCK = "SELECT p_partkey, CAST(p_size * 12 AS DOUBLE) AS inches, CASE WHEN p_partkey % 3 = 0 THEN 'White' END AS colour, CASE WHEN p_partkey % 3 = 0 THEN 'stated' ELSE 'unexamined' END AS basis FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 1 AND p_size * 12 BETWEEN 48 AND 288"


def warning_units(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.concat_ws("#", "conv_id", "turn").alias("element_id"), F.when(F.col("turn") % 3 == 0, F.lit("WARNING:")).when(F.col("turn") % 3 == 2, F.concat(F.lit("12 Caution – "), F.substring("text", 1, 10))).otherwise(F.substring("text", 1, 30)).alias("text"))
    w = rc.warnings(c, ["conv_id"])
    return w.groupBy("lexeme").agg(F.count("*").alias("warnings"), F.sum(F.size("cites")).alias("cites"))


def fault_gaps(spark: SparkSession, d: str) -> DataFrame:
    issues = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.dayofmonth("ts").alias("page_no"), F.when(F.col("event_type") == "click", "mojibake_text_layer").when(F.col("event_type") == "view", "empty_page").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 2 == 0, "info").otherwise("error").alias("severity"))
    backing = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("document_id"))
    return rc.issue_gaps(issues, backing).groupBy("gap_kind", "code", "level").agg(F.count("*").alias("n"))


FAULT_GAPS = """
WITH i AS (SELECT DISTINCT user_id, day(ts) AS p, CASE event_type WHEN 'click' THEN 'unread' ELSE 'missing' END AS gap_kind, CASE event_type WHEN 'click' THEN 'text_layer_unreadable' ELSE 'page_empty' END AS code,
 CASE WHEN event_id % 2 <> 0 AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN 'warns_line' ELSE 'informational' END AS level FROM events WHERE event_type IN ('click', 'view'))
SELECT gap_kind, code, level, count(*) AS n FROM i GROUP BY ALL"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    conditions = F.map_filter(F.create_map(F.lit("size"), (F.col("p_size") % 5).cast("string"), F.lit("brand"), F.when(k % 2 == 0, F.col("p_brand")), F.lit("odd"), F.when(k % 10 == 3, F.lit("x"))), lambda a, b: b.isNotNull())
    return p.select(k.alias("fact_id"), F.col("p_type").alias("fact_type"), F.when(k % 7 != 0, F.col("p_retailprice")).alias("value"), conditions.alias("conditions"))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_type").distinct().filter("p_type like '%E%' or p_type like '%O%'").select(F.col("p_type").alias("fact_type"), F.lower("p_type").alias("parameter"), F.array(F.lit("size"), F.lit("brand")).alias("dimensions"))


def parameter_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rc.parameter_rows(_facts(spark, d), _registry(spark, d))[1]


PARAMETER_GAPS = "SELECT p_partkey AS fact_id, p_type AS fact_type, CASE WHEN NOT (p_type LIKE '%E%' OR p_type LIKE '%O%') THEN 'unmapped' WHEN p_partkey % 7 = 0 THEN 'unquantified' ELSE 'undeclared' END AS why FROM part WHERE NOT (p_type LIKE '%E%' OR p_type LIKE '%O%') OR p_partkey % 7 = 0 OR p_partkey % 10 = 3"


def parameter_domains(spark: SparkSession, d: str) -> DataFrame:
    rows = rc.parameter_rows(_facts(spark, d), _registry(spark, d))[0]
    declared = spark.createDataFrame([("size", ["0", "1", "2", "3", "4"])], "dimension string, declared array<string>")
    return rc.domains(rows, declared).select("parameter", "dimension", F.array_join("values", ",").alias("domain"), "basis")


PARAMETER_DOMAINS = """
WITH r AS (SELECT lower(p_type) AS parameter, p_brand, p_partkey FROM part WHERE (p_type LIKE '%E%' OR p_type LIKE '%O%') AND p_partkey % 7 <> 0 AND p_partkey % 10 <> 3)
SELECT DISTINCT parameter, 'size' AS dimension, '0,1,2,3,4' AS domain, 'declared' AS basis FROM r
UNION ALL SELECT parameter, 'brand', string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), 'observed' FROM r WHERE p_partkey % 2 = 0 GROUP BY parameter"""


def procedure_steps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.lit(0).alias("start"), F.when(F.col("turn") % 4 != 3, F.col("role")).alias("kind"), "text", F.when(F.col("conv_id") % 3 == 0, "accepted").when(F.col("turn") % 2 == 0, "corrected").when(F.col("turn") % 5 == 1, "rejected").otherwise("proposed").alias("review_status"))
    p = rc.procedures(c, ["conv_id"])
    return p.select("conv_id", F.size("steps").cast("bigint").alias("steps"), F.array_join(F.col("steps")["kind"], ",").alias("kinds"), "waiting")


PROCEDURES = """
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN role END AS kind, CASE WHEN conv_id % 3 = 0 THEN 'accepted' WHEN turn % 2 = 0 THEN 'corrected' WHEN turn % 5 = 1 THEN 'rejected' ELSE 'proposed' END AS s FROM conversations),
r AS (SELECT *, s IN ('accepted', 'corrected') AND kind IS NOT NULL AS ready FROM c)
SELECT conv_id, count(*) FILTER (ready) AS steps, coalesce(string_agg(kind, ',' ORDER BY turn) FILTER (ready), '') AS kinds, count(*) FILTER (NOT ready AND s <> 'rejected') AS waiting FROM r GROUP BY conv_id"""


def source_warnings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    f = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), k.alias("document_id"), F.when(k % 9 == 0, "superseded").when(k % 4 == 0, "unknown").otherwise("active").alias("version_status"), (k % 5 == 0).alias("ocr"), (k % 11 == 0).alias("mojibake"))
    return rc.source_warnings(f).select("sha256", F.array_join("codes", ",").alias("codes"))


SOURCE_WARNINGS = """
WITH g AS (SELECT sha256(text) AS sha256, count(DISTINCT doc_id) > 1 AS d, bool_or(doc_id % 9 = 0) AS s, bool_or(doc_id % 5 = 0) AS o, bool_or(doc_id % 11 = 0) AS m, bool_or(doc_id % 9 <> 0 AND doc_id % 4 = 0) AS u FROM documents GROUP BY text),
c AS (SELECT sha256, array_to_string(list_filter([CASE WHEN d THEN 'content_duplicated' END, CASE WHEN s THEN 'document_superseded' END, CASE WHEN o THEN 'text_from_ocr' END, CASE WHEN m THEN 'text_layer_mojibake' END, CASE WHEN u THEN 'version_status_unknown' END], lambda x: x IS NOT NULL), ',') AS codes FROM g)
SELECT * FROM c WHERE codes <> ''"""


def purchase_preview(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as runs of posts: a bay a turn, a post at either end of each."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("layout"), "turn")
    stations = c.select("layout", F.explode(F.array("turn", F.col("turn") + 1)).alias("station")).distinct()
    rules = spark.createDataFrame([("panel_kit", 1), ("post", 1), ("post_cap", 2)], "target string, each bigint")
    return rc.purchase_lines(stations, c.select("layout"), rules)


PURCHASE = """
WITH b AS (SELECT conv_id AS layout, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT layout, count(DISTINCT x) AS n FROM (SELECT conv_id AS layout, turn AS x FROM conversations UNION ALL SELECT conv_id, turn + 1 FROM conversations) GROUP BY 1)
SELECT layout, 'panel_kit' AS target, n AS quantity FROM b UNION ALL SELECT layout, 'post', n FROM s UNION ALL SELECT layout, 'post_cap', 2 * n FROM s"""


def revocable_promotions(spark: SparkSession, d: str) -> DataFrame:
    promoted = table(spark, d, "events").filter("event_id % 6 = 0").select(F.col("event_id").alias("candidate_id"))
    decided = table(spark, d, "events").select(F.col("event_id").alias("candidate_id"), F.when(F.col("event_type") == "purchase", "accepted").otherwise("proposed").alias("review_status"))
    return rc.revocable(promoted, decided, "candidate_id")


def ocr_recall(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    readings = lines(spark, d).select("doc_id", F.col("source").alias("reader"), F.when(F.col("doc_id") % 4 == 0, F.reverse("line")).otherwise(F.col("line")).alias("value"), (F.col("doc_id") % 13 == 0).alias("illegible"))
    return rc.ocr_recall(readings, docs.select("doc_id", F.col("text").alias("page_text")), ["doc_id"])


OCR_RECALL = f"""
WITH v AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 4 = 0 THEN reverse(line) ELSE line END AS value FROM {LINES} WHERE doc_id % 13 <> 0)
SELECT v.source AS reader, count(*) AS "values", count(*) FILTER (contains(lower(d.text), lower(v.value))) AS found FROM v JOIN documents d ON d.doc_id = v.id GROUP BY v.source"""


def edition_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), F.sha2("event_type", 256).alias("sha256"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("fingerprint"), F.col("ts").alias("ingested_at"))
    first = e.groupBy("document_id", "sha256", "fingerprint").agg(F.min("ingested_at").alias("ingested_at"))
    return rc.edition_names(first).select("version_id")


EDITION_NAMES = """
WITH f AS (SELECT CAST(user_id AS VARCHAR) || '@' || substr(sha256(event_type), 1, 12) AS b, 't' || event_id % 3 AS f, min(ts) AS t FROM events GROUP BY ALL)
SELECT CASE WHEN row_number() OVER (PARTITION BY b ORDER BY t, f) = 1 THEN b ELSE b || '~' || f END AS version_id FROM f"""


def slots(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_brand"), F.lit(" ( "), F.col("p_type"), F.lit(" )"))).otherwise(F.col("p_brand"))
    s = rc.slot(x)
    return table(spark, d, "part").select("p_partkey", s["target"].alias("target"), s["part"].alias("part"), rc.renamed(F.col("p_brand"), {"Brand#1": "renamed", "Brand#11": "renamed"}).alias("brand"))


SLOTS = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS target, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS part, CASE WHEN p_brand IN ('Brand#1', 'Brand#11') THEN 'renamed' ELSE p_brand END AS brand FROM part"


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, counted by hour and type: run to its end, then read."""
    import uuid

    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"counts_{uuid.uuid4().hex}"
    q = counts_by_window(events, "ts", "event_type").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


STREAM = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"

_Q = {
    document_records: DOCUMENT_RECORDS, newest_pages: NEWEST_PAGES, page_context: PAGE_CONTEXT, proposal_lookup: PROPOSALS, replacement_links: REPLACEMENTS, page_ceiling: CEILING, reachability: REACH, stock_lengths: STOCK,
    warning_units: None, fault_gaps: FAULT_GAPS, parameter_gaps: PARAMETER_GAPS, parameter_domains: PARAMETER_DOMAINS, procedure_steps: PROCEDURES, source_warnings: SOURCE_WARNINGS, purchase_preview: PURCHASE,
    revocable_promotions: "SELECT event_id AS candidate_id FROM events WHERE event_id % 6 = 0 AND event_type <> 'purchase'", ocr_recall: OCR_RECALL, edition_names: EDITION_NAMES, slots: SLOTS, stream_counts: STREAM,
}
QUERIES = {f.__name__: f for f in _Q}
SQL = {f.__name__: q for f, q in _Q.items() if q}
