"""Every registered query of the engine's own operators runs, and matches its SQL where it has one."""

import collections
import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from tessellar.plans import catalogue  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = collections.Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name in catalogue.SQL:
        rel = con.sql(catalogue.SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == collections.Counter(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_entry_imports_without_the_training_package():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
