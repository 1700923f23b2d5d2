"""Queries read their whole input, as does their SQL: the cuts that either once had are gone."""

import collections
import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

from tessellar.plans import catalogue  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")

#: query: a cut that its SQL must not have
CUTS = {
    **dict.fromkeys(("rule_matches", "uncovered_points", "rule_collisions", "dated_collisions"), "l_orderkey % 997"),
    "date_conflicts": "event_id % 40",
    "lang_detect": "substr(text, 1, 400)",
    "ocr_recall": "ordinal < 3",
    "unsupported_terms": ", 1, 6)",
    **dict.fromkeys(("bm25_batch", "question_ranks", "recall_mrr", "evidence_support", "result_shares", "page_ceiling"), ", 1, 8)"),
    **dict.fromkeys(("search_dedupe_links", "search_page_cap"), "LIMIT 400"),
    "supersession_rank": "rank < 64",
}


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(CUTS))
def test_whole(spark, name):
    con = duckdb.connect()
    folder = LARGER if name.startswith("search_") else FOLDER  # more than 400 matches
    for t in ("lineitem", "orders", "documents", "benchmark", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert CUTS[name] not in catalogue.SQL[name]
    df = catalogue.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = collections.Counter(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert collections.Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want


def test_copies_beyond_the_first_ranks(spark, tmp_path):
    """500 copies stand before 120 other matches: the list is full, and every copy is linked."""
    rows = [(i, "the the the", "en", "s", 11) for i in range(500)] + [(500 + i, f"the the w{i} and more words", "en", "s", 20) for i in range(120)]
    rows += [(620 + i, "nothing of it", "en", "s", 13) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["search_dedupe_links"](spark, f"file://{tmp_path}").collect()
    assert len(got) == 100
    assert max(len(r["linked"].split(",")) for r in got) == 499


def test_ranks_of_long_chains_and_cycles(spark):
    from tessellar.operators import graph

    edges = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["node"]: r["rank"] for r in graph.ranks(spark.createDataFrame(edges, "older bigint, newer bigint")).collect()}
    assert {i: got[i] for i in range(71)} == {i: i for i in range(71)}
    assert [got[i] for i in (100, 101, 102)] == [3, 3, 3]
