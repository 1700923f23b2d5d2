"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import search as so
from ..sources.tables import lines, table

QUESTION = "the nation of thea tion licensed"
PHRASE = '"in the" "of the" that'
FROM, TO = tx.DIACRITICS, tx.PLAIN
TOK = r"regexp_extract_all(translate(lower({0}), '" + FROM + "', '" + TO + r"'), '[\p{{L}}\p{{N}}]+')"


def tok(column: str) -> str:
    return TOK.format(column)


def _bm25_sql(terms: list[so.Term], columns: dict[str, str], weights: dict[str, float], where: str = "", limit: int | None = 50) -> str:
    """SQL of bm25(): columns maps a weighted column to its expression."""

    def count(c: str, t: so.Term) -> str:
        if len(t.words) == 1:
            return f"len(list_filter(t_{c}, lambda w: w = '{t.words[0]}'))"
        n, wanted = len(t.words), "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        return f"len(list_filter(generate_series(1, len(t_{c}) - {n - 1}), lambda i: list_slice(t_{c}, i, i + {n - 1}) = {wanted}))"

    f = ", ".join(f"{' + '.join(f'{w} * {count(c, t)}' for c, w in weights.items())} AS f{i}" for i, t in enumerate(terms))
    dl = " + ".join(f"len(t_{c})" for c in weights)
    parts = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), {so.FLOOR}) * (f{i} * {so.K1 + 1}) / (f{i} + {so.K1} * (1 - {so.B} + {so.B} * dl / avgdl))" for i in range(len(terms)))
    return f"""
WITH t AS (SELECT doc_id, source, lang, {", ".join(f"{tok(e)} AS t_{c}" for c, e in columns.items())} FROM documents),
c AS (SELECT doc_id, source, lang, {dl} AS dl, {f} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(terms)))} FROM c),
r AS (SELECT doc_id, source, lang, round({parts}, 4) AS score FROM c, s WHERE {" OR ".join(f"f{i} > 0" for i in range(len(terms)))})
SELECT doc_id, score FROM r {where} ORDER BY score DESC, doc_id {f'LIMIT {limit}' if limit else ''}"""


TERMS, PHRASES = so.parse_question(QUESTION), so.parse_question(PHRASE)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return so.top(so.bm25(table(spark, d, "documents"), TERMS), 50)


def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return so.top(so.bm25(table(spark, d, "documents"), PHRASES), 50)


COLUMNS = {"text": 1.0, "source": 0.25, "lang": 0.15}
WEIGHTED = so.parse_question("nation src7 en tion")


def bm25_weighted_columns(spark: SparkSession, d: str) -> DataFrame:
    return so.top(so.bm25(table(spark, d, "documents"), WEIGHTED, weights=COLUMNS), 50)


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    scored = so.bm25(docs, TERMS)
    hits = docs.filter((F.col("lang") == "en") & F.col("source").startswith("src1")).select("doc_id").join(scored, "doc_id")
    return so.top(hits.filter("score >= 0.5"), 20)


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item's words as a question, all in one plan."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return so.batch(table(spark, d, "documents"), q, 10)


BM25_BATCH = f"""
WITH q AS (SELECT item_id AS question_id, unnest(list_distinct({tok("text")})) AS term FROM benchmark),
t AS (SELECT doc_id, {tok("text")} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
f AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM f WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
h AS (SELECT question_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), {so.FLOOR}) * (tf * {so.K1 + 1}) / (tf + {so.K1} * (1 - {so.B} + {so.B} * dl / avgdl))), 4) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 10"""


def term_df_idf(spark: SparkSession, d: str) -> DataFrame:
    return so.document_frequencies(table(spark, d, "documents"))


TERM_DF_IDF = f"""
WITH t AS (SELECT DISTINCT doc_id, unnest({tok("text")}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + any_value(n) / (1 + count(*))), 6) AS idf FROM t, n GROUP BY term"""


COMMON = [so.Term(("the",), "the")]


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """All matches by rank; equal texts have equal hashes."""
    docs = table(spark, d, "documents")
    r = so.ranked_all(so.bm25(docs, COMMON))
    return r.join(docs.select("doc_id", "source", "lang", F.sha2(so.dedupe_key(F.col("text"), F.col("lang")), 256).alias("dedupe_key")), "doc_id")


RANKED = _bm25_sql(COMMON, {"text": "text"}, {"text": 1.0}, limit=None)
NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
RANKED_CTE = f"""r0 AS ({RANKED}), r AS (SELECT r0.doc_id, r0.score, row_number() OVER (ORDER BY r0.score DESC, r0.doc_id) AS rank, d.source, d.lang, {NORM.format("d.text")} || chr(1) || d.lang AS k
FROM r0 JOIN documents d USING (doc_id))"""


def search_dedupe_links(spark: SparkSession, d: str) -> DataFrame:
    kept = so.linked_slots(_ranked(spark, d), 100)
    return kept.select("rank", "doc_id", F.array_join(F.col("linked").cast("array<string>"), ",").alias("linked"))


SEARCH_DEDUPE_LINKS = f"""
WITH {RANKED_CTE}, f AS (SELECT *, min(rank) OVER (PARTITION BY k) AS first FROM r),
kept AS (SELECT * FROM f WHERE rank = first ORDER BY rank LIMIT 100), z AS (SELECT max(rank) AS last, count(*) >= 100 AS full_list FROM kept),
l AS (SELECT first, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS linked FROM f, z WHERE rank > first AND (NOT full_list OR rank < last) GROUP BY first)
SELECT kept.rank, kept.doc_id, coalesce(l.linked, '') AS linked FROM kept LEFT JOIN l ON kept.first = l.first"""


def search_page_cap(spark: SparkSession, d: str) -> DataFrame:
    kept = so.capped_pages(_ranked(spark, d), 2, ["source", "lang"])
    return kept.orderBy("rank").limit(60).select("rank", "doc_id", "source", "lang")


SEARCH_PAGE_CAP = f"""
WITH {RANKED_CTE}, c AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY rank) AS n FROM r)
SELECT rank, doc_id, source, lang FROM c WHERE n <= 2 ORDER BY rank LIMIT 60"""


def matched_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(so.matched_terms(F.col("text"), TERMS), ",").alias("matched"))


MATCHED_TERMS = f"""
SELECT doc_id, array_to_string(list_filter({"[" + ", ".join(f"'{t.source}'" for t in TERMS) + "]"}, lambda t: contains(lower(text), lower(t))), ',') AS matched FROM documents"""


def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = so.top(so.bm25(docs, TERMS), 20)
    return hits.join(docs.select("doc_id", so.snippet(F.col("text"), TERMS).alias("snippet")), "doc_id")


def second_stage_attach(spark: SparkSession, d: str) -> DataFrame:
    """Pages are documents, elements their lines: what a top line's own document adds to it."""
    e = lines(spark, d).select(F.concat_ws("#", "doc_id", "ordinal").alias("element_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), "line", "source")
    terms = so.parse_question("nation theand erthe thati inner licensed")
    units = e.filter(F.length("line") > 0).withColumnRenamed("line", "text").withColumnRenamed("element_id", "unit_id")
    hits = so.ranked(so.bm25(units, terms, "unit_id"), 20, "unit_id").join(units, "unit_id").select("rank", "document_id", "page_no", "text")
    wanted = so.content_terms([t.source for t in terms], ngrams=True)
    df = units.agg(F.count("*").alias("n"), *[F.count_if(F.instr(F.lower("text"), t) > 0).alias(f"d{i}") for i, t in enumerate(wanted)]).first()
    import math

    idf = {t: math.log(1 + df["n"] / (1 + df[f"d{i}"])) for i, t in enumerate(wanted)}
    elements = e.select("element_id", "document_id", "page_no", F.col("line").alias("element_text"), F.col("source").alias("element_heading"))
    return so.attach_evidence(hits, elements, idf, wanted, df["n"])


def unsupported_terms(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item as a question, every fourth with an unknown word added: is every term known to the documents?"""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.array_distinct(tx.tokens(F.col("text"))).alias("t"))
    q = q.withColumn("t", F.when(F.col("question_id") % 4 == 0, F.array_append("t", F.lit("zzzunknown"))).otherwise(F.col("t")))
    terms = q.select("question_id", F.explode_outer("t").alias("term"))
    return so.unsupported(terms, so.postings(table(spark, d, "documents")).select("term").distinct())


UNSUPPORTED_TERMS = f"""
WITH q AS (SELECT item_id AS question_id, list_distinct({tok("text")}) AS t FROM benchmark),
x AS (SELECT question_id, unnest(CASE WHEN question_id % 4 = 0 THEN list_append(t, 'zzzunknown') ELSE t END) AS term FROM q),
v AS (SELECT DISTINCT unnest({tok("text")}) AS term FROM documents)
SELECT question_id, count(*) FILTER (v.term IS NULL) > 0 AS unsupported, count(*) FILTER (v.term IS NULL) AS missing
FROM x LEFT JOIN v ON x.term = v.term GROUP BY question_id"""


def element_context(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with the turns up to two before and one after it in its conversation."""
    c = table(spark, d, "conversations")
    o = c.select("conv_id", F.col("turn").alias("near"), F.substring("text", 1, 600).alias("near_text"))
    j = c.join(o, "conv_id").filter(F.col("near").between(F.col("turn") - 2, F.col("turn") + 1) & (F.col("near") != F.col("turn")))
    return j.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("near")).cast("array<string>")).alias("turns"), F.sum(F.length("near_text")).alias("chars"))


ELEMENT_CONTEXT = """
SELECT a.conv_id, a.turn, count(*) AS n, string_agg(CAST(b.turn AS VARCHAR), ',' ORDER BY b.turn) AS turns, CAST(sum(length(substr(b.text, 1, 600))) AS BIGINT) AS chars
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 1 AND b.turn <> a.turn GROUP BY ALL"""


def join_forward(spark: SparkSession, d: str) -> DataFrame:
    """A turn's text joined with up to four that follow, until one ends a sentence."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", *[F.lead("text", i).over(w).alias(f"n{i}") for i in range(1, 5)], "text")
    ends = lambda x: F.coalesce(x.rlike(r"[.!?]\s*$"), F.lit(True))
    parts, done = [F.col("text")], ends(F.col("text"))
    for i in range(1, 5):
        parts.append(F.when(~done, F.col(f"n{i}")))
        done = done | ends(F.col(f"n{i}"))
    joined = F.concat_ws(" ", *parts)
    return c.select("conv_id", "turn", F.length(joined).cast("bigint").alias("chars"), sum((p.isNotNull().cast("int") for p in parts), F.lit(0)).cast("bigint").alias("parts"))


JOIN_FORWARD = r"""
WITH c AS (SELECT conv_id, turn, text, lead(text, 1) OVER w AS n1, lead(text, 2) OVER w AS n2, lead(text, 3) OVER w AS n3, lead(text, 4) OVER w AS n4
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, coalesce(regexp_matches(text, '[.!?]\s*$'), true) AS e0, coalesce(regexp_matches(n1, '[.!?]\s*$'), true) AS e1,
      coalesce(regexp_matches(n2, '[.!?]\s*$'), true) AS e2, coalesce(regexp_matches(n3, '[.!?]\s*$'), true) AS e3 FROM c),
p AS (SELECT conv_id, turn, [text, CASE WHEN NOT e0 THEN n1 END, CASE WHEN NOT (e0 OR e1) THEN n2 END, CASE WHEN NOT (e0 OR e1 OR e2) THEN n3 END,
      CASE WHEN NOT (e0 OR e1 OR e2 OR e3) THEN n4 END] AS parts FROM e)
SELECT conv_id, turn, CAST(length(array_to_string(list_filter(parts, lambda x: x IS NOT NULL), ' ')) AS BIGINT) AS chars, CAST(len(list_filter(parts, lambda x: x IS NOT NULL)) AS BIGINT) AS parts FROM p"""

SNIPPETS = f"""
WITH h AS ({_bm25_sql(TERMS, {"text": "text"}, {"text": 1.0}, limit=20)}), t AS (SELECT doc_id, {tok("text")} AS t FROM documents),
f AS (SELECT doc_id, t, coalesce(list_min(list_filter(generate_series(1, len(t)), lambda i: list_contains({"[" + ", ".join(f"'{w}'" for q in TERMS for w in q.words) + "]"}, t[i]))) - 1, 0) AS hit FROM t)
SELECT h.doc_id, h.score, array_to_string(list_slice(t, greatest(1, hit - 6), greatest(1, hit - 6) + 27), ' ') AS snippet FROM h JOIN f ON f.doc_id = h.doc_id"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_phrase, bm25_weighted_columns, bm25_filtered, bm25_batch, term_df_idf, search_dedupe_links, search_page_cap, matched_terms, snippets, second_stage_attach, unsupported_terms, element_context, join_forward)}
SQL = {
    "bm25_topk": _bm25_sql(TERMS, {"text": "text"}, {"text": 1.0}),
    "bm25_phrase": _bm25_sql(PHRASES, {"text": "text"}, {"text": 1.0}),
    "bm25_weighted_columns": _bm25_sql(WEIGHTED, {c: c for c in COLUMNS}, COLUMNS),
    "bm25_filtered": _bm25_sql(TERMS, {"text": "text"}, {"text": 1.0}, "WHERE lang = 'en' AND starts_with(source, 'src1') AND score >= 0.5", 20),
    "bm25_batch": BM25_BATCH,
    "term_df_idf": TERM_DF_IDF,
    "search_dedupe_links": SEARCH_DEDUPE_LINKS,
    "search_page_cap": SEARCH_PAGE_CAP,
    "matched_terms": MATCHED_TERMS,
    "snippets": SNIPPETS,
    "unsupported_terms": UNSUPPORTED_TERMS,
    "element_context": ELEMENT_CONTEXT,
    "join_forward": JOIN_FORWARD,
}
