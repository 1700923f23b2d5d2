"""The registered queries on the smallest tables: SQL twins, and the pipeline against brute force, stage by stage."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

from tessellar.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = queries.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in queries.SQL:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        rel = con.sql(queries.SQL[name])
        cols = sorted(df.columns)
        at = [rel.columns.index(c) for c in cols]
        assert collections.Counter(repr(tuple(r[c] for c in cols)) for r in rows) == collections.Counter(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def words(t):
    return (t or "").encode().lower().split()


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, tables[-1], FOLDER).persist()
        assert out.columns == docs.columns
        tables.append(out)
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables]
    # 1: what the classifier's query rejects is gone
    verdict = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op4_quality_fm"](spark, FOLDER).collect()}
    assert set(rows[1]) == {i for i in rows[0] if verdict[i]}
    # 2: lines
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, r in rows[1].items():
        for x in r["text"].split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    for i, r in rows[1].items():
        want = "\n".join(x for x in r["text"].split("\n") if not (len(held.get(key(x), ())) > 1 and i > min(held[key(x)])))
        assert rows[2][i]["text"] == want and rows[2][i]["n_chars"] == len(want)
    # 3: one of each group of near copies
    sets = {i: ({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for i, w in ((i, words(r["text"])) for i, r in rows[2].items())}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(list)
    for i, s in sets.items():
        for t in s:
            by[t].append(i)
    pairs = collections.Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert set(rows[3]) == {i for i in sets if find(i) == i}
    # 4: whole items are caught, and only documents with a run of words from an item are
    plain = lambda t: [w.translate(None, b".,;:!?\"'()[]{}*#_-") for w in words(t)]
    clean = lambda t: [w for w in plain(t) if w]
    items = [clean(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    known = {tuple(x[p : p + 3]) for x in items for p in range(len(x) - 2)}
    for i, r in rows[3].items():
        w = clean(r["text"])
        whole = any(w[p : p + len(x)] == x for x in items for p in range(len(w) - len(x) + 1) if w[p] == x[0])
        touched = sum(tuple(w[p : p + 3]) in known for p in range(len(w) - 2))
        if whole:
            assert i not in rows[4]
        if i not in rows[4]:
            assert touched >= 3
        if touched == 0:
            assert i in rows[4]
    # 5: the mix takes its share, of words that are there
    mix = cp.mixed(spark, tables[-1], FOLDER).collect()
    size = sum(len(words(r["text"])) for r in rows[4].values())
    assert abs(sum(m["n_words"] for m in mix) - 1.5 * size) <= 20
    used = collections.Counter(w for m in mix for w in m["text"].encode().lower().split())
    there = collections.Counter(w for r in rows[4].values() for w in words(r["text"]))
    assert all(n <= 2 * there[w] for w, n in used.items())
    assert {i for m in mix for i in m["doc_ids"]} <= set(rows[4])
    assert spark.createDataFrame(docs.rdd.context.emptyRDD(), docs.schema).transform(lambda d: cp.distinct_lines(spark, d, FOLDER)).select(F.count("*")).first()[0] == 0


def test_run_registers_as_a_query(spark):
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and "pipeline" not in e.oracle_sql()
