"""What a query moves stays small beside its input, and odd inputs still match the SQL."""

import collections
import re

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

from tessellar.operators import conditions, evaluation, search  # noqa: E402
from tessellar.plans import catalogue  # noqa: E402
from tessellar.plans.audits import RESULTS  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(i, f"alpha w{i % 7} beta gamma w{i % 3} delta {'epsilon zeta ' * (i % 2)}end", "en", "s", 9) for i in range(40)]
ODD += [(3, "another alpha row of three", "en", "s", 9), (3, "alpha alpha", "en", "s", 9), (50, None, "en", "s", 9), (51, "", "en", "s", 9), (None, "gamma delta of no id", "en", "s", 9)]
ITEMS = [(0, "Alpha w1"), (1, "beta gamma w2 delta epsilon zeta end"), (2, "gamma"), (3, "ta  gamma w0 delta end"), (4, "not there at all"), (5, "elta epsilon zeta e")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows that repeat an id, texts that are missing or empty, a missing id; items of few words and of parts of words."""
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(ODD, DOCS).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return f"file://{folder}", con


def same_as_sql(df, rel):
    at = [rel.columns.index(c) for c in df.columns]
    want = collections.Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    assert collections.Counter(map(tuple, df.collect())) == want


@pytest.mark.parametrize("name", ["page_ceiling", "evidence_support", "question_ranks", "recall_mrr"])
def test_odd_questions(spark, odd, name):
    folder, con = odd
    same_as_sql(catalogue.QUERIES[name](spark, folder), con.sql(catalogue.SQL[name]))


def test_blocks_of_questions(spark, odd):
    """Several blocks give what one gives."""
    _, con = odd
    docs = spark.createDataFrame(ODD, DOCS)
    q = spark.createDataFrame([(i, t) for i, x in ITEMS for t in dict.fromkeys(x.lower().split())], "question_id bigint, term string")
    rel = con.sql(f"WITH {RESULTS} SELECT question_id, doc_id, score, rank FROM results")
    same_as_sql(search.shared_words(docs, q, 10, size=2).select("question_id", "doc_id", "score", "rank"), rel)


def test_words_and_texts_stay(spark, odd):
    """No plan of the results or of the texts beside them deals out texts or words."""
    folder, _ = odd
    plan = catalogue.QUERIES["evidence_support"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "text" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_headings_with_references(spark, tmp_path):
    """References without an end, as where a title was cut, and others than the SQL's three."""
    titles = ["a &amp; b&amp", "&quot;x&quot; &lt;y&gt;", "&amp;lt; &#65; &eacute;", "AT&T & co", "plain"]
    rows = [(i, f"<html><body><h1>{t}</h1><p>&quot;p</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_as_sql(catalogue.QUERIES["html_headings"](spark, f"file://{tmp_path}"), con.sql(catalogue.SQL["html_headings"]))
    assert [r["text"] for r in catalogue.QUERIES["html_blocks"](spark, f"file://{tmp_path}").filter("page_id = 1 and ordinal = 0").collect()] == ['"x" <y>']


def test_overlaps_of_one_full_cell(spark, monkeypatch):
    """A group whose intervals fill one cell is dealt into parts, none of a whole group, and loses no pair."""
    monkeypatch.setattr(conditions, "CELL_ROWS", 7, raising=False)
    rows = [("g", i, None if i % 9 == 0 else float(i % 20), float(i % 20 + i % 3)) for i in range(80)] + [(None, 90, 1.0, 2.0), (None, 91, 1.0, 2.0)]
    df = conditions.interval_overlaps(spark.createDataFrame(rows, "g string, id bigint, lo double, hi double"), ["g"], "id", "lo", "hi", F.lit(25.0))
    meet = lambda x, y: (x[2] is None or x[2] <= y[3]) and (y[2] is None or y[2] <= x[3])
    want = sorted((x[1], y[1]) for x in rows[:80] for y in rows[:80] if x[1] < y[1] and meet(x, y))
    assert sorted((r["a"], r["b"]) for r in df.collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_part" in plan


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_overlaps_of_far_ends_and_equal_ones(spark, monkeypatch, kind):
    """Ends far beyond the cells, unbounded ends, equal low ends and repeated identities: each pair once, and no others are compared in a join."""
    for name, n in (("CELL_ROWS", 20), ("LIST_ROWS", 4), ("AGAINST_ROWS", 3), ("MADE_ROWS", 5)):
        monkeypatch.setattr(conditions, name, n, raising=False)
    far = [1e12, -1e12, None]
    rows = [(g, str(i % 55) if kind == "string" else i % 55, far[i % 3] if i % 11 == 0 else float(i * 7 % 13), float(i * 7 % 13 + i % 4) if i % 10 else far[i % 3]) for g in "gh" for i in range(60)]
    rows += [("one", rows[0][1], None, 1.0)]
    df = conditions.interval_overlaps(spark.createDataFrame(rows, f"g string, id {kind}, lo double, hi double"), ["g"], "id", "lo", "hi", F.lit(2.0))
    inf = float("inf")
    full = [(g, i, -inf if lo is None else lo, inf if hi is None else hi) for g, i, lo, hi in rows]
    full = [x for x in full if x[2] <= x[3]]
    want = sorted((x[0], x[1], y[1]) for x in full for y in full if x[0] == y[0] and x[1] < y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted(map(tuple, df.collect())) == want and len(want) > 1000
    assert not re.search(r"_id#\d+L? < _id#", df._jdf.queryExecution().optimizedPlan().toString())


def test_overlaps_take_few_bytes(spark, tmp_path):
    """The answer is all pairs: its rows come in an order that repeats itself when written."""
    rows = spark.range(4000).select((F.col("id") % 2).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("lo"))
    rows = rows.withColumn("hi", F.col("lo") + F.pmod(F.hash("id"), F.lit(50)))
    conditions.interval_overlaps(rows, ["g"], "id", "lo", "hi", F.lit(25.0)).write.parquet(f"file://{tmp_path}/pairs")
    pairs = spark.read.parquet(f"file://{tmp_path}/pairs").count()
    assert pairs > 3_000_000 and 2 * sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < pairs


def test_holders_of_items_of_any_length(spark):
    units = spark.createDataFrame([(1, "a bc d e fg"), (2, ""), (None, "c d e f")], "doc_id bigint, t string")
    items = spark.createDataFrame([(1, "c d e f"), (2, "bc"), (3, ""), (4, "c d"), (5, "a bc d e fg h")], "question_id bigint, item string")
    got = sorted((r[0], -1 if r[1] is None else r[1]) for r in evaluation.holders(units, items, size=2).collect())
    assert got == [(1, -1), (1, 1), (2, 1), (3, -1), (3, 1), (3, 2), (4, -1), (4, 1)]
