import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessellar.functions import text
from tessellar.operators import conditions as co
from tessellar.operators import layout, publication, records, validation
from tessellar.operators import reviews as rv
from tessellar.sources import documents as sd
from tessellar.sources import manifest as mf
from tessellar.streaming import ingest


def column(spark, x, rows):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, x string").orderBy("i").select(x).collect()]


def test_small_expressions(spark):
    x = F.col("x")
    assert column(spark, records.basename(x), ["a/b/c.pdf", "c.pdf"]) == ["c.pdf", "c.pdf"]
    assert column(spark, records.slot(x)["part"], ["Post (cap)", "Post"]) == ["cap", None]
    assert column(spark, text.terms_present(x, ["b", "a", "z"]), ["A b"]) == [["b", "a"]]
    assert column(spark, text.undecodable_ratio(x), ["ab\x01\x02", ""]) == [0.5, 0.0]
    assert column(spark, text.repaired_capital(x), ["T he post", "A post"]) == ["The post", "A post"]
    assert column(spark, text.first_bullet_with(x, "post"), ["• rail\n• the post......\n• a post here", "none"]) == ["a post here", None]
    assert column(spark, text.label(x, 8), ["a  b", "longer than eight"]) == ["a b", "longer…"]
    assert column(spark, mf.route(x, F.lit(2), F.lit(100)), ["pdf", "html", "png", "xyz"]) == ["ocr", "html", "image", "unsupported"]
    assert column(spark, mf.version_status(x, F.lit("")), ["old/active.pdf", "active.pdf", "x"]) == ["superseded", "active", "unknown"]
    assert column(spark, co.scope_verdict(x, F.lit("a")), ["a", "b"]) == ["exact", "other"]
    assert records.other_lengths("16 foot lengths for White (12 foot rails for Blend products)") == [(144.0, "Blend")]
    with pytest.raises(ValueError):
        publication.check_tenant("shared")
    assert publication.check_tenant("acme") == "acme"


def test_gathering(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 1, "c")], "key string, at int, v string")
    got = {r["key"]: (r["v"], [d["v"] for d in r["duplicates"]]) for r in mf.first_of(rows, "key", ["at"], ["at", "v"]).collect()}
    assert got == {"k": ("a", ["b"]), "m": ("c", [])}
    assert records.worst(rows, "key", F.count("*")).first()["key"] == "k"
    files = spark.createDataFrame([("d", "s", "t1"), ("d", "s", "t2")], "document_id string, sha256 string, tool_fingerprint string")
    assert [r["tool_fingerprint"] for r in mf.not_ingested(files, files.filter("tool_fingerprint = 't1'")).collect()] == ["t2"]
    wide = mf.with_columns(rows, {"at": "int", "new": "string"})
    assert wide.columns == ["key", "at", "v", "new"]
    shaped = records.first_present(rows, {"name": ["nothing", "v"], "none": ["nowhere"]}).collect()
    assert {r["name"] for r in shaped} == {"a", "b", "c"} and {r["none"] for r in shaped} == {None}
    reports = spark.createDataFrame([("see derived/p/a.png and x",)], "t string")
    assert [r["path"] for r in records.mentioned_paths(reports, "t").collect()] == ["derived/p/a.png"]
    facts = spark.createDataFrame([("accepted", None), ("accepted", "me"), ("flagged", None)], "review_status string, reviewer string")
    assert rv.without_reviewer(facts).count() == 1


def test_editions_replace_only_themselves(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    make = lambda *r: spark.createDataFrame(list(r), "version_id string, text string")
    records.write_edition(make(("v1", "a"), ("v2", "b")), path)
    for _ in range(2):
        records.write_edition(make(("v2", "c")), path)
    assert sorted((r["version_id"], r["text"]) for r in spark.read.parquet(path).collect()) == [("v1", "a"), ("v2", "c")]


def test_layout_pieces(spark):
    words = spark.createDataFrame([("p", 1, 0, 0.0), ("p", 2, 0, 100.0), ("p", 3, 1, 1.0), ("p", 4, 1, 101.0), ("p", 5, 2, 50.0), ("q", 6, 0, 3.0)], "page string, id int, row int, x0 double")
    assert {r["page"]: r["tabular"] for r in records.table_block(words, ["page"]).collect()} == {"p": True, "q": False}
    edges = spark.createDataFrame([("p", 0.0), ("p", 98.0)], "page string, edge double")
    assert {r["id"]: r["edge"] for r in layout.nearest_column(words, edges, "page", "id").collect()} == {1: 0.0, 2: 98.0, 3: 0.0, 4: 98.0, 5: 98.0}
    pages = spark.createDataFrame([("a", None, 0, 50.0, -5.0, 0.0, 5.0, 5.0), ("b", "x", 10, 90.0, 0.0, 0.0, 5.0, 5.0)], "page_id string, image_path string, chars int, confidence double, x0 double, y0 double, x1 double, y1 double").withColumns({"width": F.lit(100.0), "height": F.lit(100.0)})
    assert sorted(r["fault"] for r in sd.document_faults(pages).collect()) == ["box_outside_page", "empty_page", "low_confidence", "missing_image"]


def test_step_readings_and_references(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"source": "g", "page": 3, "steps": [{"text": "a", "kind": "step"}, {"text": "b", "kind": "note", "slot": "Post (cap)"}]}')
    assert [(r["ordinal"], r["text"], r["slot"]) for r in validation.step_readings(spark, f"file://{tmp_path}").orderBy("ordinal").collect()] == [(0, "a", None), (1, "b", "Post (cap)")]
    index = spark.createDataFrame([("r1", ["e1"]), ("r2", ["e1", "e2"])], "ref_id string, element_ids array<string>")
    elements = spark.createDataFrame([("e1", "one"), ("e2", "two")], "element_id string, text string")
    assert {r["ref_id"]: r["text"] for r in validation.reference_text(index, elements).collect()} == {"r1": "one", "r2": None}


def test_streamed_verdicts(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    log = spark.createDataFrame([("f1", day(1), "a"), ("f1", day(1), "a"), ("f2", day(2), "b")], "fact string, at timestamp, verdict string")
    log.write.parquet(f"file://{tmp_path}/log")
    q = ingest.latest_verdicts(spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/log"), "fact", "at").writeStream.format("memory").queryName("verdicts").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("verdicts").count() == 2
    held = spark.createDataFrame([("f1", day(1), "old"), ("f3", day(1), "c")], "fact string, at timestamp, verdict string")
    got = {r["fact"]: r["verdict"] for r in ingest.keep_latest(spark.createDataFrame([("f1", day(2), "new")], log.schema), held, ["fact"], ["at"], ["at", "verdict"]).collect()}
    assert got == {"f1": "new", "f3": "c"}
