"""Registered queries on conditional tables, readings, reviews and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bracket_of_span
from ..operators import conditions as co
from ..operators import reviews as rv
from ..sources.tables import table

KEYS = ["flag", "status", "band"]


def _domain(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    dims = [li.select(F.col("l_returnflag").alias("flag")), li.select(F.col("l_linestatus").alias("status")), li.select((F.col("l_quantity").cast("int") % 10).alias("band"))]
    return co.points(dims)


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule a line item: some keys omitted (wildcards), a value, a validity window."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("rule"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_linenumber") % 5 != 1, F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_linenumber") % 3 != 2, F.col("l_quantity").cast("int") % 10).alias("band"),
        (F.col("l_partkey") % 4).alias("value"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("valid_from"),
        F.date_format(F.date_add("l_shipdate", 30), "yyyy-MM-dd").alias("valid_until"),
    )


RULES = """dom AS (SELECT * FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem), (SELECT DISTINCT l_linestatus AS status FROM lineitem), (SELECT DISTINCT CAST(l_quantity AS INT) % 10 AS band FROM lineitem)),
rules AS (SELECT l_orderkey || '-' || l_linenumber AS rule, CASE WHEN l_linenumber % 4 <> 0 THEN l_returnflag END AS flag, CASE WHEN l_linenumber % 5 <> 1 THEN l_linestatus END AS status,
 CASE WHEN l_linenumber % 3 <> 2 THEN CAST(l_quantity AS INT) % 10 END AS band, l_partkey % 4 AS value, strftime(l_shipdate, '%Y-%m-%d') AS valid_from, strftime(CAST(l_shipdate AS DATE) + 30, '%Y-%m-%d') AS valid_until
 FROM lineitem),
hits AS (SELECT dom.*, r.rule, r.value, r.valid_from, r.valid_until FROM dom JOIN rules r ON (r.flag IS NULL OR r.flag = dom.flag) AND (r.status IS NULL OR r.status = dom.status) AND (r.band IS NULL OR r.band = dom.band))"""


def domain_points(spark: SparkSession, d: str) -> DataFrame:
    return _domain(spark, d)


def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    return co.matches(_rules(spark, d).select("rule", *KEYS), _domain(spark, d), KEYS)


def uncovered_points(spark: SparkSession, d: str) -> DataFrame:
    return co.uncovered(_rules(spark, d).filter("rule like '%-1' and flag is not null and band is not null"), _domain(spark, d), KEYS)


def rule_collisions(spark: SparkSession, d: str) -> DataFrame:
    return co.collisions(_rules(spark, d).select("rule", *KEYS, "value"), _domain(spark, d), KEYS, "value")


def dated_collisions(spark: SparkSession, d: str) -> DataFrame:
    r = _rules(spark, d).withColumn("fallback", F.col("flag").isNull() & F.col("status").isNull() & F.col("band").isNull())
    return co.collisions(r, _domain(spark, d), KEYS, "value", "fallback", ("valid_from", "valid_until"))


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 50 != 0, F.col("p_retailprice")).alias("low"), (F.col("p_retailprice") + F.col("p_size") / 10).alias("high"))
    return co.interval_overlaps(p, ["p_brand"], "p_partkey", "low", "high", F.lit(25.0))


INTERVAL_OVERLAP = """
WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 50 <> 0 THEN p_retailprice END AS low, p_retailprice + p_size / 10 AS high FROM part)
SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
 AND (a.low IS NULL OR a.low <= b.high) AND (b.low IS NULL OR b.low <= a.high)"""


def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + F.col("p_size") / 10).alias("high"))
    return co.interval_gaps(p, ["p_brand"], "low", "high")


INTERVAL_GAPS = """
WITH p AS (SELECT p_brand, p_retailprice AS low, p_retailprice + p_size / 10 AS high FROM part),
r AS (SELECT *, max(high) OVER (PARTITION BY p_brand ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p)
SELECT DISTINCT p_brand, reach AS gap_min, low AS gap_max FROM r WHERE reach < low"""


def paired_schedule(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return co.paired(li, ["l_orderkey"], "l_returnflag", "q", "A", "R").select("l_orderkey", F.col("A").alias("a"), F.col("R").alias("r"))


def value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_linestatus", F.col("l_returnflag").alias("value"), F.col("l_suppkey").cast("string").alias("authority"))
    c = co.conflicts(li, ["l_partkey", "l_linestatus"], "value", "authority")
    return c.select("l_partkey", "l_linestatus", F.array_join("values", ",").alias("found"), F.size("authorities").cast("bigint").alias("authorities"))


def merged_citations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("cites"))
    return co.merge_but(li, ["l_partkey", "l_returnflag", "l_linestatus"], "cites").withColumn("cites", F.array_join("cites", ","))


def condition_match(spark: SparkSession, d: str) -> DataFrame:
    """Parts' conditions against one situation: size 15.0 and brand in another case, type left unstated."""
    p = table(spark, d, "part")
    conditions = F.map_filter(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), F.lit("type"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_type"))), lambda k, v: v.isNotNull())
    stated = F.create_map(F.lit("size"), F.lit("15.0"), F.lit("brand"), F.lit("BRAND#23"))
    return p.select("p_partkey", co.row_verdict(conditions, stated).alias("verdict"), F.array_join(co.missing_keys(conditions, stated), ",").alias("missing"))


CONDITION_MATCH = """
SELECT p_partkey, CASE WHEN p_size <> 15 OR (p_partkey % 3 <> 0 AND lower(p_brand) <> 'brand#23') THEN 'excluded' WHEN p_partkey % 4 = 0 THEN 'unstated' ELSE 'applies' END AS verdict,
 CASE WHEN p_partkey % 4 = 0 THEN 'type' ELSE '' END AS missing FROM part"""


def outside_domain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    rules = p.select(F.col("p_brand").alias("tab"), F.explode(F.array(F.struct(F.lit("size").alias("dimension"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("type").alias("dimension"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("value")))).alias("r")).select("tab", "r.*")
    n = table(spark, d, "nation")
    stated = n.select(F.col("n_nationkey").alias("query"), F.explode(F.array(F.struct(F.lit("size").alias("dimension"), (F.col("n_nationkey") * 4).cast("string").alias("stated")), F.struct(F.lit("type").alias("dimension"), F.lit("none such").alias("stated")))).alias("s")).select("query", "s.*")
    return co.outside(rules, stated, "tab", "dimension", "value")


OUTSIDE = """
WITH r AS (SELECT p_brand AS tab, 'size' AS dimension, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_brand, 'type', CASE WHEN p_partkey % 2 = 0 THEN p_type END FROM part),
s AS (SELECT n_nationkey AS query, 'size' AS dimension, CAST(n_nationkey * 4 AS VARCHAR) AS stated FROM nation UNION ALL SELECT n_nationkey, 'type', 'none such' FROM nation)
SELECT query, tab, dimension FROM s JOIN r USING (dimension) WHERE value IS NOT NULL GROUP BY ALL HAVING NOT bool_or(lower(stated) = lower(value))"""


def zone_brackets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    x = F.element_at(F.array(*[F.lit(v) for v in ("HVHZ and Non-HVHZ", "Non-HVHZ only", "within HVHZ", "", "other")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", bracket_of_span(x).alias("bracket"))


ZONES = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'non-hvhz' WHEN 2 THEN 'hvhz' WHEN 3 THEN 'none printed' END AS bracket FROM part"


# ---- readings and reviews: readers are event types, cells are (user, day)


def _readings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("table_id"), F.date_format("ts", "yyyy-MM-dd").alias("cell"), F.col("event_type").alias("reader"), F.col("event_id").alias("candidate_id"),
        F.round(F.col("value")).cast("bigint").alias("value"), (F.col("event_id") % 13 == 0).alias("illegible"),
        F.when(F.col("event_id") % 17 == 0, "corrected").when(F.col("event_id") % 19 == 0, "accepted").otherwise("unreviewed").alias("review_status"),
    )


READINGS = """rd AS (SELECT user_id AS table_id, strftime(ts, '%Y-%m-%d') AS cell, event_type AS reader, event_id AS candidate_id, CAST(round(value) AS BIGINT) AS value, event_id % 13 = 0 AS illegible,
 CASE WHEN event_id % 17 = 0 THEN 'corrected' WHEN event_id % 19 = 0 THEN 'accepted' ELSE 'unreviewed' END AS review_status FROM events)"""
CELL = ["table_id", "cell"]


def reader_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rv.agreement(rv.one_reading_per_cell(_readings(spark, d), [*CELL, "reader"], "review_status", "candidate_id"), CELL, "click", "view")


AGREEMENT = f"""
WITH {READINGS}, o AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY table_id, cell, reader ORDER BY review_status <> 'corrected', candidate_id) = 1),
j AS (SELECT a.value AS va, b.value AS vb, a.illegible AS ia, b.illegible AS ib FROM o a JOIN o b USING (table_id, cell) WHERE a.reader = 'click' AND b.reader = 'view'),
c AS (SELECT count(*) AS compared, count(*) FILTER (NOT ia AND NOT ib AND va = vb) AS agree, count(*) FILTER (NOT ia AND NOT ib AND va <> vb) AS disagree, count(*) FILTER (ia AND ib) AS both_illegible, count(*) FILTER (ia <> ib) AS one_illegible FROM j)
SELECT *, CASE WHEN agree + disagree > 0 THEN round(agree / (agree + disagree), 4) END AS rate FROM c"""


def cross_family_verified(spark: SparkSession, d: str) -> DataFrame:
    r = _readings(spark, d).withColumn("value", F.expr("value div 40"))
    family = F.when(F.col("reader").isin("click", "view"), "screen").when(F.col("reader") == "purchase", "till").otherwise("unknown")
    return rv.cross_family(r, CELL, family)


CROSS_FAMILY = f"""
WITH {READINGS}, k AS (SELECT *, value // 40 AS v, CASE WHEN reader IN ('click', 'view') THEN 'screen' WHEN reader = 'purchase' THEN 'till' ELSE 'unknown' END AS f FROM rd)
SELECT table_id, cell, min(v) AS value, count(DISTINCT f) AS families FROM k WHERE f <> 'unknown' GROUP BY ALL
HAVING count(DISTINCT f) >= 2 AND count(DISTINCT v) = 1 AND NOT bool_or(review_status IN ('accepted', 'corrected', 'rejected'))"""


def one_reading_per_cell(spark: SparkSession, d: str) -> DataFrame:
    return rv.one_reading_per_cell(_readings(spark, d), CELL, "review_status", "candidate_id").select(*CELL, "candidate_id", "reader", "review_status")


ONE_READING = f"WITH {READINGS} SELECT table_id, cell, candidate_id, reader, review_status FROM rd QUALIFY row_number() OVER (PARTITION BY table_id, cell ORDER BY review_status <> 'corrected', candidate_id) = 1"


def promote_cells(spark: SparkSession, d: str) -> DataFrame:
    """Verified cells become facts with their row's conditions beside them; cells promoted before stay out."""
    one = rv.one_reading_per_cell(_readings(spark, d), CELL, "review_status", "candidate_id").filter("review_status <> 'unreviewed' and not illegible")
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("table_id"), F.col("c_mktsegment").alias("condition"))
    done = _readings(spark, d).filter("candidate_id % 5 = 0").select("candidate_id").distinct()
    return one.join(done, "candidate_id", "left_anti").join(u, "table_id", "left").select("candidate_id", "table_id", "cell", rv.effective(F.col("value"), F.col("value") + 1, F.col("review_status")).alias("value"), "condition")


PROMOTE = f"""
WITH {READINGS}, o AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY table_id, cell ORDER BY review_status <> 'corrected', candidate_id) = 1)
SELECT candidate_id, table_id, cell, CASE WHEN review_status = 'corrected' THEN value + 1 ELSE value END AS value, c_mktsegment AS condition
FROM o LEFT JOIN customer ON c_custkey = table_id WHERE review_status <> 'unreviewed' AND NOT illegible AND candidate_id % 5 <> 0"""


def withdraw_stale(spark: SparkSession, d: str) -> DataFrame:
    """Promoted facts whose candidate is no longer its cell's reading."""
    r = _readings(spark, d)
    promoted = r.filter("review_status <> 'unreviewed'").select("candidate_id", *CELL)
    current = rv.one_reading_per_cell(r, CELL, "review_status", "candidate_id").select("candidate_id")
    return promoted.join(current, "candidate_id", "left_anti")


WITHDRAW = f"""
WITH {READINGS}, o AS (SELECT candidate_id FROM rd QUALIFY row_number() OVER (PARTITION BY table_id, cell ORDER BY review_status <> 'corrected', candidate_id) = 1)
SELECT candidate_id, table_id, cell FROM rd WHERE review_status <> 'unreviewed' AND candidate_id NOT IN (SELECT candidate_id FROM o)"""


def settled_readings(spark: SparkSession, d: str) -> DataFrame:
    r = _readings(spark, d).withColumn("value", F.when(~F.col("illegible"), F.expr("value div 60")))
    return rv.settle(r, CELL, "value")


SETTLED = f"""
WITH {READINGS}, v AS (SELECT *, CASE WHEN NOT illegible THEN value // 60 END AS w FROM rd)
SELECT table_id, cell, CASE WHEN count(w) = 0 THEN 'none' WHEN count(w) = 1 THEN 'single' WHEN count(DISTINCT w) = 1 THEN 'agreed' ELSE 'disagreed' END AS settled,
 CASE WHEN count(DISTINCT w) = 1 THEN min(w) END AS value FROM v GROUP BY ALL"""


def review_projection(spark: SparkSession, d: str) -> DataFrame:
    """Events as a review log on users: the last verdict applied to every customer, the first one's earlier status."""
    log = table(spark, d, "events").select(F.col("user_id").alias("fact"), F.col("ts"), F.col("event_id"), F.col("event_type").alias("verdict"), F.concat(F.lit("was "), F.col("event_type")).alias("before"), F.col("value").alias("value"))
    p = rv.project(log, ["fact"], ["ts", "event_id"], "verdict", "before", "value")
    facts = table(spark, d, "customer").select(F.col("c_custkey").alias("fact"), F.col("c_acctbal").alias("original"), F.lit("unreviewed").alias("review_status"))
    out = rv.apply_projection(facts, p, ["fact"], "review_status", "original")
    return out.join(p.select("fact", "status_before", "reviews"), "fact", "left")


REVIEW_PROJECTION = """
WITH p AS (SELECT user_id AS fact, arg_max(event_type, (ts, event_id)) AS s, arg_max(value, (ts, event_id)) AS v, 'was ' || arg_min(event_type, (ts, event_id)) AS status_before, count(*) AS reviews FROM events GROUP BY user_id)
SELECT c_custkey AS fact, c_acctbal AS original, coalesce(s, 'unreviewed') AS review_status, coalesce(v, c_acctbal) AS effective_value, status_before, reviews FROM customer LEFT JOIN p ON fact = c_custkey"""


def review_reattach(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("element"), F.col("event_type").alias("fact_type"), F.expr("cast(floor(value / 20) as bigint)").alias("value"), "event_id", F.dayofmonth("ts").alias("day"))
    old = e.filter("day = 3").withColumnRenamed("event_id", "old_id")
    new = e.filter("day = 4").withColumnRenamed("event_id", "new_id")
    return rv.reattach(old.drop("day"), new.drop("day"), ["element", "fact_type"], "value", "old_id", "new_id")


REATTACH = """
WITH e AS (SELECT user_id AS el, event_type AS ft, CAST(floor(value / 20) AS BIGINT) AS v, event_id, day(ts) AS dd FROM events), o AS (SELECT * FROM e WHERE dd = 3), n AS (SELECT * FROM e WHERE dd = 4),
g AS (SELECT o.event_id AS old_id, (SELECT count(*) FROM o x WHERE x.el = o.el AND x.ft = o.ft) AS n_old, (SELECT count(*) FROM n WHERE n.el = o.el AND n.ft = o.ft AND n.v = o.v) AS n_new,
 (SELECT min(event_id) FROM n WHERE n.el = o.el AND n.ft = o.ft AND n.v = o.v) AS nid, EXISTS (SELECT 1 FROM n WHERE n.el = o.el AND n.ft = o.ft) AS there FROM o),
r AS (SELECT old_id, nid, CASE WHEN n_old > 1 OR n_new > 1 THEN 'ambiguous' WHEN n_new = 1 THEN 'attached' WHEN there THEN 'value_changed' ELSE 'orphaned' END AS outcome FROM g)
SELECT old_id, CASE WHEN outcome = 'attached' THEN nid END AS new_id, outcome FROM r"""


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents of bad quality wait unless they were flagged toxic: the shortest first."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels")
    return rv.queue(docs.join(lab.filter("quality = 0").select("doc_id"), "doc_id"), lab.filter("toxic = 1"), "doc_id", [F.col("n_chars"), F.col("doc_id")], 25)


REVIEW_QUEUE = "SELECT doc_id, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY n_chars, doc_id LIMIT 25"


def ledger_import_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("review_id"), F.col("user_id").alias("fact"), F.col("event_type").alias("verdict"), "value")
    ledger = e.filter("review_id % 3 <> 0").withColumn("value", F.when(F.col("review_id") % 10 == 0, F.col("value") + 1).otherwise(F.col("value")))
    store = e.filter("review_id % 2 = 0")
    known = table(spark, d, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("fact"))
    return rv.import_status(ledger, store, "review_id", ["verdict", "value"], known, "fact")


LEDGER_IMPORT = """
SELECT event_id AS review_id, CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0) THEN 'unresolvable' WHEN event_id % 2 <> 0 THEN 'new' WHEN event_id % 10 = 0 THEN 'conflict' ELSE 'identical' END AS status
FROM events WHERE event_id % 3 <> 0"""


def ledger_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("review_id"), F.col("user_id").alias("fact"), "ts")
    store = e.filter("fact % 4 = 0 or review_id % 20 = 0").withColumn("rn", F.lit(1))
    first = store.filter("fact % 4 = 0").groupBy("fact").agg(F.min("ts").alias("ts0"))
    stored = store.join(first, "fact", "left").filter("ts0 is null or ts <= ts0 + interval 2 days").drop("rn", "ts0")
    return rv.order_conflicts(e, stored, "fact", ["ts"], "review_id")


LEDGER_ORDER = """
WITH s AS (SELECT event_id, user_id, ts FROM events WHERE user_id % 4 = 0 OR event_id % 20 = 0),
f AS (SELECT s.* FROM s LEFT JOIN (SELECT user_id, min(ts) AS ts0 FROM s WHERE user_id % 4 = 0 GROUP BY 1) USING (user_id) WHERE ts0 IS NULL OR ts <= ts0 + INTERVAL 2 DAY),
a AS (SELECT user_id, list(event_id ORDER BY ts) AS l FROM events GROUP BY 1), b AS (SELECT user_id, list(event_id ORDER BY ts) AS l FROM f GROUP BY 1)
SELECT user_id AS fact FROM b JOIN a USING (user_id) WHERE a.l[1:len(b.l)] <> b.l"""


def worklist_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels")
    frames = {"machine": docs.join(lab, "doc_id", "left_anti"), "review": docs.join(lab.filter("quality = 0").select("doc_id"), "doc_id"), "human": lab.filter("toxic = 1").select("doc_id")}
    return rv.piles(frames).groupBy("pile").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


WORKLIST = """
WITH w AS (SELECT 'machine' AS pile, doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'review', doc_id, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 0
 UNION ALL SELECT 'human', doc_id, NULL FROM labels WHERE toxic = 1) SELECT pile, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM w GROUP BY pile"""


def span_rows(spark: SparkSession, d: str) -> DataFrame:
    """Spans expanded to the rows they cover; the span of the last part wins a row."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 7).alias("a"), (F.col("p_size") % 7 + F.col("p_partkey") % 4).cast("int").alias("b"))
    return rv.expand_spans(p, "a", "b").groupBy("p_brand", "row").agg(F.max("p_partkey").alias("winner"))


SPAN_ROWS = 'WITH s AS (SELECT p_brand, p_partkey, unnest(generate_series(p_size % 7, CAST(p_size % 7 + p_partkey % 4 AS INT))) AS r FROM part) SELECT p_brand, CAST(r AS INT) AS "row", max(p_partkey) AS winner FROM s GROUP BY ALL'

_Q = {
    domain_points: f"WITH {RULES} SELECT * FROM dom",
    rule_matches: f"WITH {RULES} SELECT flag, status, band, rule FROM hits",
    uncovered_points: f"WITH {RULES} SELECT * FROM dom WHERE NOT EXISTS (SELECT 1 FROM hits h JOIN rules r USING (rule) WHERE h.rule LIKE '%-1' AND r.flag IS NOT NULL AND r.band IS NOT NULL AND h.flag = dom.flag AND h.status = dom.status AND h.band = dom.band)",
    rule_collisions: f"WITH {RULES} SELECT flag, status, band, count(DISTINCT value) AS n_values, count(*) AS n_rules FROM hits GROUP BY ALL HAVING count(DISTINCT value) > 1",
    dated_collisions: f"WITH {RULES} SELECT DISTINCT a.flag, a.status, a.band FROM hits a JOIN hits b ON a.flag = b.flag AND a.status = b.status AND a.band = b.band AND a.value < b.value AND a.valid_from <= b.valid_until AND b.valid_from <= a.valid_until WHERE a.rule NOT IN (SELECT rule FROM rules WHERE flag IS NULL AND status IS NULL AND band IS NULL) AND b.rule NOT IN (SELECT rule FROM rules WHERE flag IS NULL AND status IS NULL AND band IS NULL)",
    interval_overlap: INTERVAL_OVERLAP, interval_gaps: INTERVAL_GAPS,
    paired_schedule: "SELECT l_orderkey, CAST(min(l_quantity) FILTER (l_returnflag = 'A') AS BIGINT) AS a, CAST(min(l_quantity) FILTER (l_returnflag = 'R') AS BIGINT) AS r FROM lineitem GROUP BY 1 HAVING a IS NOT NULL AND r IS NOT NULL",
    value_conflicts: "SELECT l_partkey, l_linestatus, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS found, count(DISTINCT l_suppkey) AS authorities FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1",
    merged_citations: "SELECT l_partkey, l_returnflag, l_linestatus, array_to_string(list_sort(list(DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 8, '0'))), ',') AS cites FROM lineitem GROUP BY ALL",
    condition_match: CONDITION_MATCH, outside_domain: OUTSIDE, zone_brackets: ZONES, reader_agreement: AGREEMENT, cross_family_verified: CROSS_FAMILY, one_reading_per_cell: ONE_READING, promote_cells: PROMOTE,
    withdraw_stale: WITHDRAW, settled_readings: SETTLED, review_projection: REVIEW_PROJECTION, review_reattach: REATTACH, review_queue: REVIEW_QUEUE, ledger_import_status: LEDGER_IMPORT, ledger_order: LEDGER_ORDER,
    worklist_union: WORKLIST, span_rows: SPAN_ROWS,
}
QUERIES = {f.__name__: f for f in _Q}
SQL = {f.__name__: q for f, q in _Q.items()}
