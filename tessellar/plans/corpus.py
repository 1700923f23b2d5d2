"""Registered queries on text quality, duplicates, dates, quantities, editions and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as dt
from ..functions import quantity as qt
from ..functions import text as tx
from ..operators import graph, versions
from ..sources.tables import lines, table

NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
LINES = "(SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents)"


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(x).cast("bigint").alias("chars"), F.round(tx.control_ratio(x), 5).alias("control_ratio"), F.round(tx.ascii_token_ratio(x), 4).alias("ascii_token_ratio"), F.round(tx.cjk_share(x), 4).alias("cjk_share"))


ASCII = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) >= 3 AND regexp_matches(w, '\p{L}'))"
TEXT_QUALITY = rf"""
WITH w AS (SELECT doc_id, text, {ASCII} AS ws FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars,
 round((length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0E-\x1F\x{{80}}-\x{{9F}}]', '', 'g'))) / length(text), 5) AS control_ratio,
 round(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: length(w) = octet_length(encode(w)))) / len(ws) ELSE 1.0 END, 4) AS ascii_token_ratio,
 round((length(text) - length(regexp_replace(text, '[\x{{3000}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}]', '', 'g'))) / length(text), 4) AS cjk_share FROM w"""


def mojibake_flag(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document with its vowels swapped for control characters and letters for accented ones."""
    bad = F.when(F.col("doc_id") % 7 == 0, F.translate("text", "aeiountrs", "\x01é\x02ö\x03üßñç")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tx.is_mojibake(bad).alias("mojibake"))


MOJIBAKE = rf"""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN translate(text, 'aeiountrs', chr(1) || 'é' || chr(2) || 'ö' || chr(3) || 'üßñç') ELSE text END AS text FROM documents),
w AS (SELECT doc_id, text, {ASCII} AS ws FROM b)
SELECT doc_id, length(text) >= 200
 AND round((length(text) - length(regexp_replace(text, '[\x{{3000}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}]', '', 'g'))) / length(text), 4) < 0.2
 AND round((length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0E-\x1F\x{{80}}-\x{{9F}}]', '', 'g'))) / length(text), 5) > 0.005
 AND round(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: length(w) = octet_length(encode(w)))) / len(ws) ELSE 1.0 END, 4) < 0.85 AS mojibake FROM w"""


def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    lang = tx.detect_lang(F.col("text"))
    return table(spark, d, "documents").select("doc_id", lang.alias("lang"), tx.lang_basis(lang).alias("basis"))


def _markers(lang: str) -> str:
    # the SQL engine's word edges are ASCII ones: edges are spelled out
    edge = [p.replace("'", "''").removeprefix(r"\b").removesuffix(r"\b") for p in tx.MARKERS[lang]]
    left = [r"(^|[^\p{L}\p{N}_])" if p.startswith(r"\b") else "" for p in tx.MARKERS[lang]]
    right = [r"([^\p{L}\p{N}_]|$)" if p.endswith(r"\b") else "" for p in tx.MARKERS[lang]]
    return " + ".join(f"CAST(regexp_matches(x, '{a}{p}{z}') AS INT)" for a, p, z in zip(left, edge, right, strict=True))


LANG_DETECT = rf"""
WITH t AS (SELECT doc_id, lower(text) AS x FROM documents),
s AS (SELECT doc_id, x, {_markers("fr")} AS fr, {_markers("es")} AS es FROM t),
l AS (SELECT doc_id, CASE WHEN trim(x) = '' THEN 'und' WHEN regexp_matches(x, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]') THEN 'zh'
 WHEN NOT regexp_matches(x, '\p{{L}}{{2,}}') THEN 'und' WHEN fr >= 2 AND fr > es THEN 'fr' WHEN es >= 2 AND es > fr THEN 'es' ELSE 'en' END AS lang FROM s)
SELECT doc_id, lang, CASE WHEN lang = 'und' THEN 'unknown' ELSE 'assumed' END AS basis FROM l"""


def exact_duplicates_linked(spark: SparkSession, d: str) -> DataFrame:
    return graph.linked_duplicates(table(spark, d, "documents"), F.col("text"), "doc_id")


def content_duplicates_linked(spark: SparkSession, d: str) -> DataFrame:
    return graph.same_content(table(spark, d, "documents"), "text", "doc_id")


def _duplicates(key: str) -> str:
    return f"WITH k AS (SELECT doc_id, {key} AS k FROM documents), g AS (SELECT k, min(doc_id) AS p, count(*) AS copies FROM k GROUP BY k HAVING count(*) > 1) SELECT doc_id, p AS \"primary\", copies FROM k JOIN g USING (k)"


def slug_namespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.namespace(F.col("p_brand")).alias("ns"), tx.slug(F.concat_ws(" / ", "p_type", "p_name")).alias("slug"))


SLUG = "SELECT p_partkey, 'mfr/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS ns, trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part"


def reading_norms(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit(" "), F.col("p_size"), F.when(F.col("p_size") % 3 == 0, " inches").when(F.col("p_size") % 3 == 1, " in.").otherwise("''"), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", tx.norm_reading(x).alias("reading"), tx.norm_answer(F.concat(F.lit("“"), F.col("p_type"), F.lit("”  –"))).alias("answer"))


READING_NORMS = """SELECT p_partkey, CAST(p_size AS VARCHAR) || '"' AS reading, lower('"' || p_type || '" -') AS answer FROM part"""


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    h = lines(spark, d).withColumn("h", tx.is_heading(F.col("line")))
    return h.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("h").alias("headings"), F.min(F.when(F.col("h"), F.col("ordinal"))).cast("bigint").alias("first_heading"))


HEADING_LINES = rf"""
WITH h AS (SELECT doc_id, ordinal, length(trim(line)) > 0 AND length(trim(line)) <= 45 AND NOT regexp_matches(trim(line), '[.;:]$') AS h FROM {LINES})
SELECT doc_id, count(*) AS lines, count(*) FILTER (h) AS headings, min(ordinal) FILTER (h) AS first_heading FROM h GROUP BY doc_id"""


def phrase_ngrams(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").select("lang", F.explode(tx.ngrams(tx.tokens(F.col("text")), 2)).alias("gram"))
    n = g.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    return versions.latest(n, ["lang"], [F.col("n").desc(), F.col("gram")])


TOKENS = r"regexp_extract_all(translate(lower(text), '" + tx.DIACRITICS + "', '" + tx.PLAIN + r"'), '[\p{L}\p{N}]+')"
PHRASE_NGRAMS = f"""
WITH t AS (SELECT lang, {TOKENS} AS t FROM documents), g AS (SELECT lang, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM t),
n AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL)
SELECT lang, gram, n FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) = 1"""


def strict_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    x = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Effective "), F.date_format("o_orderdate", "M/d/yyyy"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" or so")))
    return o.select("o_orderkey", dt.strict_date(x).alias("strict"), dt.lenient_date(x).alias("lenient"))


STRICT_DATES = """
WITH p AS (SELECT o_orderkey, o_orderkey % 3 AS m, year(o_orderdate) AS y, month(o_orderdate) AS mo, day(o_orderdate) AS dd, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders),
s AS (SELECT *, CASE m WHEN 0 THEN mo ELSE dd END AS a, CASE m WHEN 0 THEN dd ELSE mo END AS b FROM p)
SELECT o_orderkey, CASE WHEN m = 1 THEN iso WHEN (a = b OR b > 12) AND a <= 12 THEN printf('%04d-%02d-%02d', y, a, b) END AS strict,
 CASE WHEN m = 1 THEN iso WHEN a <= 12 AND b <= day(last_day(make_date(y, a, 1))) THEN printf('%04d-%02d-%02d', y, a, b) END AS lenient FROM s"""


def edition_stamps(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    x = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "WEB REV ").otherwise("Revision 4 dated "), F.month("o_orderdate"), F.lit("."), F.date_format("o_orderdate", "yy"))
    return o.select("o_orderkey", dt.edition_stamp(x).alias("edition"))


EDITION_STAMPS = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '20%y-%m') END AS edition FROM orders"


def quantities_milli(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    x = F.concat(F.col("p_size"), F.when(F.col("p_partkey") % 4 == 0, F.lit(" 1/8")).when(F.col("p_partkey") % 4 == 1, F.lit("½")).otherwise(F.lit("")), F.when(F.col("p_partkey") % 3 == 0, '"').when(F.col("p_partkey") % 3 == 1, " ft.").otherwise(" mm"))
    m = qt.measure(x)
    return p.select("p_partkey", m["amount_milli"].alias("amount_milli"), m["unit"].alias("unit"))


QUANTITIES = """
WITH q AS (SELECT p_partkey, p_size * 8 + CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 0 END AS eighths, CASE p_partkey % 3 WHEN 0 THEN 25400 WHEN 1 THEN 304800 ELSE 1000 END AS f,
 CASE p_partkey % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'ft' ELSE 'mm' END AS unit FROM part)
SELECT p_partkey, CAST((2 * eighths * f + 8) // 16 AS BIGINT) AS amount_milli, unit FROM q"""


def current_edition(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return versions.latest(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


CURRENT_EDITION = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def latest_version_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the newest version only: events of each user's last day."""
    e = table(spark, d, "events").withColumn("version", F.to_date("ts"))
    last = e.groupBy("user_id").agg(F.max("version").alias("version"))
    return e.join(last, ["user_id", "version"]).groupBy("user_id").agg(F.count("*").alias("facts"), F.countDistinct("event_type").alias("kinds"), F.max("event_id").alias("last_event"))


LATEST_FACTS = "WITH v AS (SELECT *, CAST(ts AS DATE) AS version FROM events) SELECT user_id, count(*) AS facts, count(DISTINCT event_type) AS kinds, max(event_id) AS last_event FROM v WHERE version = (SELECT max(CAST(x.ts AS DATE)) FROM events x WHERE x.user_id = v.user_id) GROUP BY user_id"


def effective_as_of(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("document_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"))
    return versions.as_of(o, ["chain"], "effective", F.lit("1995-06-30"), "document_id")


EFFECTIVE = """
WITH o AS (SELECT o_custkey AS chain, o_orderkey AS document_id, strftime(o_orderdate, '%Y-%m-%d') AS effective FROM orders)
SELECT chain, document_id, effective FROM o WHERE effective <= '1995-06-30' QUALIFY row_number() OVER (PARTITION BY chain ORDER BY effective DESC, document_id DESC) = 1"""


def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.filter("event_type <> 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("seen"), F.col("value").alias("seen_value"))
    return versions.as_of_join(left, right, "user_id", "ts", "since", ["seen", "seen_value"]).select("user_id", "event_id", "seen", "seen_value")


AS_OF_JOIN = """
WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS seen, value AS seen_value, ts AS since FROM events WHERE event_type <> 'purchase')
SELECT l.user_id, l.event_id, r.seen, r.seen_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.since"""


def expiry(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    e = F.when(F.col("o_orderkey") % 10 != 0, F.date_format(F.date_add("o_orderdate", 365), "yyyy-MM-dd"))
    return o.select("o_orderkey", dt.expiry_status(e, F.lit("1996-01-01")).alias("status"))


EXPIRY = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN strftime(CAST(o_orderdate AS DATE) + 365, '%Y-%m-%d') < '1996-01-01' THEN 'expired' ELSE 'in_force' END AS status FROM orders"


def date_conflicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("value"), F.when(F.col("event_id") % 11 == 0, "flagged").when(F.col("event_id") % 2 == 0, "accepted").otherwise("corrected").alias("status"))
    return versions.agreement(e, ["user_id"], "value", "status")


DATE_CONFLICTS = """
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS value, CASE WHEN event_id % 11 = 0 THEN 'flagged' WHEN event_id % 2 = 0 THEN 'accepted' ELSE 'corrected' END AS status FROM events)
SELECT user_id, CASE WHEN count(DISTINCT value) = 1 THEN 'unanimous' ELSE 'conflict' END AS agreement, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value,
 CASE WHEN count(*) FILTER (status = 'flagged') > 0 THEN 'review_required' ELSE 'reviewed' END AS confidence, count(value) AS sources FROM e GROUP BY user_id"""


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a chain: each superseded by the next but for every seventh."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("next"))
    return o.filter(F.col("next").isNotNull() & (F.col("o_orderkey") % 7 != 0)).select(F.col("next").alias("a"), F.col("o_orderkey").alias("b"))


CHAIN = "e AS (SELECT next AS a, o_orderkey AS b FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders) WHERE next IS NOT NULL AND o_orderkey % 7 <> 0)"


def supersession_component(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_chains(spark, d))


COMPONENT = f"""
WITH RECURSIVE {CHAIN}, s AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r(node, reach) AS (SELECT DISTINCT x, x FROM s UNION SELECT s.y, r.reach FROM r JOIN s ON r.node = s.x)
SELECT node, min(reach) AS component FROM r GROUP BY node"""


def supersession_rank(spark: SparkSession, d: str) -> DataFrame:
    return graph.ranks(_chains(spark, d).select(F.col("b").alias("older"), F.col("a").alias("newer")))


RANK = f"""
WITH RECURSIVE {CHAIN}, r(node, rank) AS (SELECT b, CAST(0 AS BIGINT) FROM e UNION SELECT a, CAST(0 AS BIGINT) FROM e UNION SELECT e.a, r.rank + 1 FROM r JOIN e ON r.node = e.b)
SELECT node, max(rank) AS rank FROM r GROUP BY node"""


def relation_mirrors(spark: SparkSession, d: str) -> DataFrame:
    r = graph.mirrored(_chains(spark, d))
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("version_status"))
    return graph.status_from_edges(nodes, r, "document_id").groupBy("version_status").agg(F.count("*").alias("n"))


MIRRORS = f"WITH {CHAIN} SELECT CASE WHEN o_orderkey IN (SELECT b FROM e) THEN 'superseded' ELSE o_orderstatus END AS version_status, count(*) AS n FROM orders GROUP BY 1"


def select_active(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders")
    m = o.select(
        F.col("o_custkey").alias("chain"),
        F.col("o_orderkey").alias("document_id"),
        (F.col("o_orderkey") % 5).alias("content"),
        F.when(F.col("o_orderkey") % 6 == 0, "superseded").when(F.col("o_orderkey") % 31 == 0, "active").alias("version_status"),
        F.when(F.col("o_orderkey") % 4 != 0, F.date_format(F.date_add("o_orderdate", 300), "yyyy-MM-dd")).alias("expiration"),
        (F.col("o_orderkey") % 37 == 0).alias("expiration_conflict"),
        F.row_number().over(w).alias("position"),
    )
    return versions.select_active(m, "chain", "1998-03-01")


SELECT_ACTIVE = """
WITH m AS (SELECT o_custkey AS chain, o_orderkey AS id, o_orderkey % 5 AS content, CASE WHEN o_orderkey % 6 = 0 THEN 'superseded' WHEN o_orderkey % 31 = 0 THEN 'active' END AS vs,
  CASE WHEN o_orderkey % 37 = 0 OR o_orderkey % 4 = 0 THEN 'unknown' WHEN strftime(CAST(o_orderdate AS DATE) + 300, '%Y-%m-%d') < '1998-03-01' THEN 'expired' ELSE 'in_force' END AS st,
  o_orderkey % 37 = 0 AS cf, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
l AS (SELECT * FROM m WHERE vs IS DISTINCT FROM 'superseded'),
g AS (SELECT chain, count(DISTINCT CASE WHEN vs = 'active' THEN content END) AS nm, min(CASE WHEN vs = 'active' THEN id END) AS mid, count(DISTINCT CASE WHEN st = 'in_force' THEN content END) AS nv,
  min(CASE WHEN st = 'in_force' THEN id END) AS vid, arg_max(id, pos) AS pid FROM l GROUP BY chain),
c AS (SELECT DISTINCT m.chain, g.* EXCLUDE (chain), CASE WHEN nm = 1 THEN mid WHEN nm = 0 AND nv = 1 THEN vid WHEN nm = 0 AND nv = 0 THEN pid END AS cid FROM m LEFT JOIN g USING (chain)),
b AS (SELECT c.chain, cid, CASE WHEN pid IS NULL THEN 'none' WHEN nm > 1 OR (nm = 0 AND nv > 1) THEN 'conflict' WHEN l.cf THEN 'conflict' WHEN l.st = 'expired' THEN 'withdrawn'
  WHEN nm = 1 THEN 'marked' WHEN nv = 1 THEN 'inferred_in_force' ELSE 'assumed_newest' END AS basis FROM c LEFT JOIN l ON l.id = c.cid)
SELECT chain, CASE WHEN basis IN ('marked', 'inferred_in_force', 'assumed_newest') THEN cid END AS active, basis FROM b"""

_Q = {
    text_quality: TEXT_QUALITY, mojibake_flag: MOJIBAKE, lang_detect: LANG_DETECT, exact_duplicates_linked: _duplicates("text"), content_duplicates_linked: _duplicates(NORM.format("text")),
    slug_namespace: SLUG, reading_norms: READING_NORMS, heading_lines: HEADING_LINES, phrase_ngrams: PHRASE_NGRAMS, strict_dates: STRICT_DATES, edition_stamps: EDITION_STAMPS, quantities_milli: QUANTITIES,
    current_edition: CURRENT_EDITION, latest_version_facts: LATEST_FACTS, effective_as_of: EFFECTIVE, as_of_join: AS_OF_JOIN, expiry: EXPIRY, date_conflicts: DATE_CONFLICTS,
    supersession_component: COMPONENT, supersession_rank: RANK, relation_mirrors: MIRRORS, select_active: SELECT_ACTIVE,
}
QUERIES = {f.__name__: f for f in _Q}
SQL = {f.__name__: q for f, q in _Q.items() if q}
