"""Registered queries on fact look-ups, labels, approvals, warnings' classes and filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, graph
from ..operators import lookups as lo
from ..sources.tables import table
from .audits import LINES
from .knowledge import CELL, READINGS, _readings


def _facts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 5 == 0, "rejected").when(F.col("event_id") % 5 == 1, "reviewed").when(F.col("event_id") % 5 == 2, "flagged").otherwise("extracted")
    held = F.create_map(F.lit("day"), F.dayofmonth("ts").cast("string"), F.lit("half"), F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    return table(spark, d, "events").select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("fact_type"), F.hour("ts").alias("page_no"), "value", status.alias("review_status"), held.alias("conditions"))


def _filed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("manufacturer"), F.when(F.col("c_custkey") % 3 != 0, "active").when(F.col("c_custkey") % 2 == 0, "superseded").alias("version_status"))


def fact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Twenty clicks of one day in one segment, active documents first."""
    return lo.fact_lookup(_facts(spark, d), _filed(spark, d), "click", {"day": 4}, "BUILDING").select("fact_id", "document_id", "page_no", "version_status")


FACT_LOOKUP = """
SELECT event_id AS fact_id, user_id AS document_id, CAST(hour(ts) AS INT) AS page_no, CASE WHEN c_custkey % 3 <> 0 THEN 'active' WHEN c_custkey % 2 = 0 THEN 'superseded' END AS version_status FROM events JOIN customer ON c_custkey = user_id
WHERE event_id % 5 <> 0 AND event_type = 'click' AND c_mktsegment = 'BUILDING' AND day(ts) = 4 ORDER BY c_custkey % 3 <> 0 DESC, hour(ts), event_id LIMIT 20"""


def unflagged_facts(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred extracted or reviewed facts of the first half of a day, of any kind and maker."""
    return lo.fact_lookup(_facts(spark, d), _filed(spark, d), conditions={"half": "am"}, limit=100, flagged=False).select("fact_id", "fact_type", "review_status")


UNFLAGGED = """
SELECT event_id AS fact_id, event_type AS fact_type, CASE event_id % 5 WHEN 1 THEN 'reviewed' ELSE 'extracted' END AS review_status FROM events JOIN customer ON c_custkey = user_id
WHERE event_id % 5 IN (1, 3, 4) AND hour(ts) < 12 ORDER BY c_custkey % 3 <> 0 DESC, hour(ts), event_id LIMIT 100"""


def text_or_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth document has only blanks in its text layer, every eighth nothing at all."""
    k = F.col("doc_id")
    layer = F.when(k % 8 == 0, F.lit(None)).when(k % 4 == 0, " \t\n").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(lo.text_or_ocr(layer, F.when(k % 16 != 0, F.concat(F.lit("\n"), "text", F.lit(" "))))).alias("digest"))


TEXT_OR_OCR = r"""
WITH w AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b)
SELECT doc_id, md5(CASE WHEN doc_id % 16 = 0 THEN '' ELSE trim(coalesce(text, ''), b) END) AS digest FROM documents, w"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 9
    said = F.when(k == 0, " Footing  Depth (in.)").when(k == 1, "MIN. footing hole depth").when(k == 2, "Max post spacing").when(k == 3, "Min Footing Diameter").when(k == 4, "Wind Exposure").when(k == 5, "Exposure ").when(k == 6, "Fence height").when(k == 7, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", said.alias("label"))


def label_registry(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("p_partkey", lo.labelled(F.col("label"), lo.VALUE_LABELS).alias("value_of"), lo.labelled(F.col("label"), lo.CONDITION_LABELS).alias("condition_of"))


LABEL_REGISTRY = r"""
WITH l AS (SELECT p_partkey, lower(trim(CASE p_partkey % 9 WHEN 0 THEN ' Footing  Depth (in.)' WHEN 1 THEN 'MIN. footing hole depth' WHEN 2 THEN 'Max post spacing' WHEN 3 THEN 'Min Footing Diameter' WHEN 4 THEN 'Wind Exposure' WHEN 5 THEN 'Exposure ' WHEN 6 THEN 'Fence height' WHEN 7 THEN p_name END)) AS x FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(x, 'footing\s*depth') OR regexp_matches(x, 'min\.?\s*footing.*depth') THEN 'footing_depth_in' WHEN regexp_matches(x, 'max\.?\s*post\s*spacing') THEN 'post_spacing_in' WHEN regexp_matches(x, 'min\.?\s*footing.*diameter') THEN 'footing_diameter_in' END AS value_of,
 CASE WHEN regexp_matches(x, 'wind\s*exposure') OR x = 'exposure' THEN 'exposure_category' WHEN regexp_matches(x, 'fence\s*height') THEN 'fence_height' END AS condition_of FROM l"""


def _approval(n: str) -> str:
    return f"concat(lpad(cast({n} % 100 as string), 2, '0'), '-', lpad(cast({n} % 10000 as string), 4, '0'), '.', lpad(cast({n} % 7 as string), 2, '0'))"


def _approved(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents: the path names the approval, or the title does, or neither."""
    own = F.expr(_approval("o_custkey"))
    path = F.concat(F.lit("noa/x"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), own)).otherwise(own), F.lit(".pdf"))
    title = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Approval "), own))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), "o_custkey", lo.approval_id(path, title).alias("approval"))


APPROVED = f"""n AS (SELECT o_orderkey AS document_id, o_custkey, CASE WHEN o_orderkey % 3 <> 2 THEN {_approval('o_custkey').replace('string', 'varchar')} END AS approval, {_approval('(o_custkey + 1)').replace('string', 'varchar')} AS earlier FROM orders)"""


def approval_ids(spark: SparkSession, d: str) -> DataFrame:
    return _approved(spark, d).select("document_id", "approval")


def _editions(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth order cites the approval of the next customer on a page that counts or on one that doesn't."""
    other = F.regexp_replace(F.expr(_approval("(o_custkey + 1)")), r"[-.]", " $0 ")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("This renews NOA #"), other)).otherwise(F.concat(F.lit("see PREVIOUS approval # "), other, F.lit(" and no more")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("page_no"), F.when(F.col("o_custkey") % 50 == 0, said).alias("text"))


def approval_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.mirrored(lo.approval_edges(_approved(spark, d), _editions(spark, d)))


APPROVAL_EDGES = f"""
WITH {APPROVED}, e AS (SELECT x.document_id AS a, y.document_id AS b FROM n x JOIN n y ON y.approval = x.earlier WHERE x.o_custkey % 50 = 0 AND x.document_id % 10 < 6 AND x.document_id <> y.document_id AND x.approval IS DISTINCT FROM x.earlier)
SELECT a AS from_id, b AS to_id, 'supersedes' AS relation FROM e UNION ALL SELECT b, a, 'superseded_by' FROM e"""


def same_approval(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one approval, linked to the smallest of them."""
    return graph.linked_duplicates(_approved(spark, d).filter("approval is not null"), F.col("approval"), "document_id")


SAME_APPROVAL = f"""
WITH {APPROVED}, g AS (SELECT document_id, min(document_id) OVER w AS "primary", count(*) OVER w AS copies FROM n WHERE approval IS NOT NULL WINDOW w AS (PARTITION BY approval)) SELECT * FROM g WHERE copies > 1"""


def warning_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document, opened by different words: how many of each class, and how many of them are broken."""
    lines = table(spark, d, "documents").select(F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    k = F.col("n") % 11
    opened = F.when(k == 0, F.concat(F.lit("30 * Caution – "), "line")).when(k == 1, "NOTES:").when(k == 2, F.concat(F.lit("Note that "), "line", F.lit(" may result in harm")))
    opened = opened.when(k == 3, F.concat("line", F.lit(" Warning: "), "line")).when(k == 4, F.concat(F.lit("Never strike "), "line", F.lit(" the "))).when(k == 5, F.concat(F.lit("NOTICE of acceptance "), "line")).otherwise(F.col("line"))
    x = F.col("x")
    return lines.select(opened.alias("x")).groupBy(lo.warning_class(x).alias("class")).agg(F.count("*").alias("n"), F.count_if(lo.dangling(x)).alias("dangling"), F.count_if(lo.interleaved(x)).alias("interleaved"))


WARNING_CLASSES = rf"""
WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) % 11 AS k FROM documents),
x AS (SELECT CASE k WHEN 0 THEN '30 * Caution – ' || line WHEN 1 THEN 'NOTES:' WHEN 2 THEN 'Note that ' || line || ' may result in harm' WHEN 3 THEN line || ' Warning: ' || line WHEN 4 THEN 'Never strike ' || line || ' the ' WHEN 5 THEN 'NOTICE of acceptance ' || line ELSE line END AS x FROM l)
SELECT CASE WHEN regexp_matches(x, '{lo.NO_WARNING}', 'i') THEN 'excluded' WHEN regexp_matches(x, '^{lo.BEFORE_OPENER}{lo.OPENERS}\s*[:!.–-]?\s*\z', 'i') THEN 'alone' WHEN regexp_matches(x, '^{lo.BEFORE_OPENER}{lo.OPENERS}\s*[:!.–—-]\s*\S', 'i') THEN 'led'
 WHEN regexp_matches(x, '{lo.HAZARD}', 'i') THEN 'hazard' WHEN regexp_matches(x, '{lo.NAMED_RULE}', 'i') THEN 'rule' ELSE 'none' END AS class, count(*) AS n,
 count(*) FILTER (regexp_matches(x, '(?:(?:^|[^\p{{L}}\p{{N}}_])(?:{lo.HANGING_WORDS})|-)\s*\z', 'i')) AS dangling, count(*) FILTER (regexp_matches(x, '\S\s+{lo.OPENERS}\s*[:!]', 'i')) AS interleaved FROM x GROUP BY 1"""


def kit_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables: the first line is the header, a quantity below it may be no number."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").cast("int").alias("row"), "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    k, head = F.col("t") % 4, F.col("row") == 1
    cell = lambda col, title, below: F.struct(F.lit(col).alias("col"), F.when(head, title).otherwise(below).alias("text"))
    cells = F.array(cell(0, F.when(k == 0, "Qty ").when(k == 1, "QUANTITY").when(k == 2, "Number").otherwise("count"), F.when(F.col("l_partkey") % 6 == 0, "2 pcs").otherwise(F.concat(F.lit(" "), F.col("q").cast("string")))), cell(1, F.when(F.col("t") % 5 == 0, "Colour").otherwise("Description"), F.lit("Post")), cell(2, F.when(F.col("t") % 3 == 0, "Dimensions").otherwise("Notes"), F.lit("3")))
    return lo.kit_tables(li.select("t", "row", F.explode(cells).alias("c")).select("t", "row", "c.*"), ["t"])


KIT_TABLES = """
SELECT l_orderkey AS t, 0 AS qty, 1 AS item, CASE WHEN l_orderkey % 3 = 0 THEN 2 END AS dim, CAST(count(*) FILTER (l_linenumber > 1 AND l_partkey % 6 <> 0) AS INT) AS rows
FROM lineitem WHERE l_orderkey % 4 <> 2 AND l_orderkey % 5 <> 0 GROUP BY l_orderkey HAVING min(l_linenumber) = 1 AND count(*) FILTER (l_linenumber > 1 AND l_partkey % 6 <> 0) >= 3"""


def record_differences(spark: SparkSession, d: str) -> DataFrame:
    """A ledger's and a store's record of an event: other verdicts, and a note that one of them lacks."""
    k = F.col("event_id")
    ledger = F.create_map(F.lit("verdict"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("note"), F.when(k % 7 == 0, "seen"))
    store = F.create_map(F.lit("verdict"), F.when(k % 3 == 0, "void").otherwise(F.col("event_type")), F.lit("user"), F.col("user_id").cast("string"), F.lit("by"), F.when(k % 11 == 0, "a"))
    said = F.transform(F.map_entries(lo.differences(ledger, store)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["ledger"], F.lit("-")), F.lit("/"), F.coalesce(e["value"]["store"], F.lit("-"))))
    return table(spark, d, "events").select("event_id", F.concat_ws(",", said).alias("unlike")).filter("unlike <> ''")


DIFFERENCES = """
SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'by=-/a' END, CASE WHEN event_id % 7 = 0 THEN 'note=seen/-' END, CASE WHEN event_id % 3 = 0 AND event_type <> 'void' THEN 'verdict=' || event_type || '/void' END) AS unlike
FROM events WHERE event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 3 = 0"""


def curation_levels(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_linenumber") == 1, "accepted").when(F.col("l_linenumber") == 2, "cross_family_verified").when(F.col("l_linenumber") == 3, "corrected").when(F.col("l_linenumber") == 4, "unreviewed")
    return table(spark, d, "lineitem").groupBy("l_returnflag", lo.curation_level(status).alias("level")).agg(F.count("*").alias("n"))


def source_classes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as bytes, filed under the priorities of the orders that hold them."""
    filings = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    classes = {"1-URGENT": "sealed", "2-HIGH": "sealed", "3-MEDIUM": "report", "5-LOW": "weak"}
    return lo.source_classes(filings, "l_partkey", F.col("o_orderpriority"), classes, ("5-LOW",), "weak")


SOURCE_CLASSES = """
WITH f AS (SELECT l_partkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'sealed' WHEN o_orderpriority = '3-MEDIUM' THEN 'report' END AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_partkey, CASE count(DISTINCT c) WHEN 0 THEN 'weak' WHEN 1 THEN min(c) END AS source_class, CASE count(DISTINCT c) WHEN 0 THEN 'source_class_unclassified' WHEN 1 THEN NULL ELSE 'source_class_disagreement' END AS gap FROM f GROUP BY 1"""


def step_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Steps of every document's lines; those of every third document are on record, so proposing adds the others."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter("trim(line) <> ''")
    rows = lines.select(F.concat_ws("#", "doc_id", "n").alias("element_id"), "doc_id", F.concat(F.lit("• "), "line").alias("text"), F.lit("text").alias("text_source"))
    found = extract.steps(rows, ["element_id", "doc_id"])
    return lo.proposed(found, found.filter("doc_id % 3 = 0")).groupBy("doc_id").agg(F.count("*").alias("proposed"))


STEP_PROPOSALS = f"SELECT doc_id, count(*) AS proposed FROM {LINES} WHERE doc_id % 3 <> 0 GROUP BY doc_id"


def same_family_marks(spark: SparkSession, d: str) -> DataFrame:
    r = _readings(spark, d).withColumn("value", F.expr("value div 40"))
    return lo.same_family(r, CELL, "click", "view")


SAME_FAMILY = f"""
WITH {READINGS}, r AS (SELECT *, value // 40 AS v FROM rd WHERE reader IN ('click', 'view') AND NOT illegible AND (reader = 'view' OR review_status = 'unreviewed'))
SELECT candidate_id FROM r WHERE EXISTS (SELECT 1 FROM r s WHERE s.table_id = r.table_id AND s.cell = r.cell AND s.v = r.v AND s.reader <> r.reader)"""


def printed_values(spark: SparkSession, d: str) -> DataFrame:
    """A part's lexemes in printed order, whether its basis is stated, and its point in words."""
    p = table(spark, d, "part")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    lexemes = lo.value_lexemes(F.concat(size, F.lit(" in ")), F.when(k % 4 != 0, F.array(F.concat(F.lit(" "), size, F.lit(" in")), F.lit(""), F.concat((F.col("p_size") * 25).cast("string"), F.lit(" mm")))))
    words = lo.point_words(F.when(k % 2 == 0, "C"), F.when(k % 3 != 0, k % 3 == 1), {"fence_height": F.when(k % 5 == 0, F.col("p_size"))})
    return p.select("p_partkey", F.concat_ws("|", lexemes).alias("lexemes"), lo.published_basis(F.when(k % 3 == 0, "stated").when(k % 3 == 1, "unexamined")).alias("basis"), words.alias("point"))


PRINTED_VALUES = """
SELECT p_partkey, p_size || ' in' || CASE WHEN p_partkey % 4 <> 0 THEN '|' || p_size * 25 || ' mm' ELSE '' END AS lexemes, CASE WHEN p_partkey % 3 = 0 THEN 'stated' ELSE 'assumed' END AS basis,
 coalesce(nullif(concat_ws(', ', CASE WHEN p_partkey % 2 = 0 THEN 'exposure C' END, CASE WHEN p_partkey % 5 = 0 THEN 'fence height ' || p_size END, CASE p_partkey % 3 WHEN 1 THEN 'HVHZ' WHEN 2 THEN 'non-HVHZ' END), ''), 'any conditions') AS point FROM part"""


def warning_attachment(spark: SparkSession, d: str) -> DataFrame:
    """What each turn belongs to: a warranty's bytes, the last step heading above it, or the document."""
    k = F.col("turn")
    path = F.when(k % 4 != 0, F.array(F.lit("Safety"), F.concat(F.lit("Step "), k.cast("string")), F.when(k % 4 == 1, F.concat(F.lit("STEP"), (k + 1).cast("string"))).otherwise("Tools")))
    to = lo.attachment(F.when(F.col("conv_id") % 5 == 0, "warranty").otherwise("manual"), path, F.sha2(F.col("conv_id").cast("string"), 256))
    return table(spark, d, "conversations").select("conv_id", "turn", to.alias("to")).select("conv_id", "turn", "to.kind", "to.ref")


ATTACHMENT = """
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'warranty' WHEN turn % 4 <> 0 THEN 'step' ELSE 'document' END AS kind,
 CASE WHEN conv_id % 5 = 0 OR turn % 4 = 0 THEN sha256(CAST(conv_id AS VARCHAR)) WHEN turn % 4 = 1 THEN 'STEP' || (turn + 1) ELSE 'Step ' || turn END AS ref FROM conversations"""


def seen_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A customer's review saw the clicks and views; what was read otherwise stays unsigned."""
    e = table(spark, d, "events").select(F.col("user_id").alias("crop"), F.col("event_id").alias("candidate_id"), "event_type")
    reviews = e.filter("event_type in ('click', 'view')").groupBy("crop").agg(F.min("candidate_id").alias("review_id"), F.collect_list("candidate_id").alias("seen"))
    return lo.seen_candidates(e.drop("event_type"), reviews, "crop", "candidate_id", "seen")


def evidence_matches(spark: SparkSession, d: str) -> DataFrame:
    """The facts that carry a user's first value of a kind on that user, and the other values there."""
    e = table(spark, d, "events").select("user_id", "event_type", F.expr("cast(floor(value / 20) as bigint)").alias("v"), "event_id")
    wanted = e.groupBy("user_id", "event_type").agg(F.min_by("v", "event_id").alias("v"))
    out = lo.evidence_matches(wanted, e, ["user_id", "event_type"], "v", "event_id")
    return out.withColumn("facts", F.concat_ws(",", F.transform("facts", lambda x: x.cast("string")))).withColumn("others", F.concat_ws(",", F.transform("others", lambda x: x.cast("string"))))


EVIDENCE = """
WITH e AS (SELECT user_id, event_type, CAST(floor(value / 20) AS BIGINT) AS x, event_id FROM events), w AS (SELECT user_id, event_type, arg_min(x, event_id) AS v FROM e GROUP BY ALL)
SELECT user_id, event_type, v, array_to_string(list_sort(list(event_id) FILTER (x = v)), ',') AS facts, coalesce(array_to_string(list_sort(list(DISTINCT x) FILTER (x <> v)), ','), '') AS others FROM w JOIN e USING (user_id, event_type) GROUP BY ALL"""

_Q = {
    fact_lookup: FACT_LOOKUP, unflagged_facts: UNFLAGGED, text_or_ocr: TEXT_OR_OCR, label_registry: LABEL_REGISTRY, approval_edges: APPROVAL_EDGES, same_approval: SAME_APPROVAL, warning_classes: WARNING_CLASSES, kit_tables: KIT_TABLES,
    approval_ids: f"WITH {APPROVED} SELECT document_id, approval FROM n",
    record_differences: DIFFERENCES, source_classes: SOURCE_CLASSES, step_proposals: STEP_PROPOSALS, same_family_marks: SAME_FAMILY, printed_values: PRINTED_VALUES, warning_attachment: ATTACHMENT, evidence_matches: EVIDENCE,
    curation_levels: "SELECT l_returnflag, CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS level, count(*) AS n FROM lineitem GROUP BY ALL",
    seen_candidates: "SELECT user_id AS crop, event_id AS candidate_id, min(event_id) OVER (PARTITION BY user_id) AS review_id FROM events WHERE event_type IN ('click', 'view')",
}
QUERIES = {f.__name__: f for f in _Q}
SQL = {f.__name__: q for f, q in _Q.items()}
