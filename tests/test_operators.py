import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.operators import conditions as co
from tessellar.operators import evaluation as ev
from tessellar.operators import extract, graph, layout, versions
from tessellar.operators import publication as pb
from tessellar.operators import reviews as rv
from tessellar.operators import search as so
from tessellar.sources import documents as sd
from tessellar.sources import manifest as mf


def row(i, text, doc="d1", page=1, heading=()):
    return {"id": i, "text": text, "document_id": doc, "page_no": page, "heading_path": list(heading)}


def test_questions():
    words = lambda q: [" ".join(t.words) for t in so.parse_question(q)]
    assert "23 0314 05" in words("Find NOA 23-0314.05")
    assert "130 mph" in words("footing depth at 130 mph")
    assert words("the a of") == []
    assert words('"exact words" fence fence')[:2] == ["exact words", "fence"]


def test_slots():
    texts = lambda kept: [r["text"] for r in kept]
    twice = [row(1, "a"), row(2, "a"), row(3, "b", page=2)]
    assert texts(so.walk_slots(twice, 2, False, None)[0]) == ["a", "a"]
    kept, links = so.walk_slots([row(1, "keep"), row(2, "keep", "d2", 9)], 10, True, None)
    assert [r["document_id"] for r in kept] == ["d1"] and links[0][0]["document_id"] == "d2"
    assert texts(so.walk_slots([row(1, "a"), row(2, "a", "d2", 2), row(3, "b", "d3", 3)], 2, True, None)[0]) == ["a", "b"]
    assert len(so.walk_slots([row(1, "1. None."), row(2, "1.  none.\n", "d2")], 5, True, None)[0]) == 1
    assert len(so.walk_slots([row(1, "x", heading=["A"]), row(2, "x", heading=["B"])], 5, True, None)[0]) == 2
    assert len(so.walk_slots([row(1, ""), row(2, "")], 5, True, None)[0]) == 2
    # a row that the cap turned away holds no slot: its later duplicate can be kept
    kept, _ = so.walk_slots([row(1, "a"), row(2, "b"), row(3, "b", page=2)], 5, True, 1)
    assert [r["id"] for r in kept] == [1, 3]


def test_search_end_to_end(spark):
    units = spark.createDataFrame([(1, "steel post in the ground", "d1", 1, ["A"]), (2, "steel  POST in the ground", "d2", 4, ["A"]), (3, "vinyl rail", "d3", 1, []), (4, "post cap", "d4", 2, [])], "unit_id bigint, text string, document_id string, page_no int, heading_path array<string>")
    got = list(so.search(units, "steel post", k=2))
    assert got[0]["unit_id"] == 1 and got[0]["duplicates_suppressed"] == [2] and got[1]["unit_id"] == 4
    assert list(so.search(units, "the of")) == []
    with pytest.raises(ValueError):
        list(so.search(units, "post", filters={"colour": "x"}))


def test_index_gives_what_the_scan_gives(spark, tmp_path):
    units = spark.createDataFrame([(i, " ".join(w for j, w in enumerate("steel post in the ground vinyl rail cap".split()) if (i >> j) & 1)) for i in range(40)], "doc_id bigint, text string")
    asked = {1: ["steel", "cap"], 2: ["post", "ground", "post"], 3: ["nowhere"]}
    q = spark.createDataFrame([(k, t) for k, v in asked.items() for t in dict.fromkeys(v)], "question_id bigint, term string")
    so.write_index(units, f"file://{tmp_path}/index")
    rows = lambda df: sorted((r["question_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert rows(so.search_index(spark, f"file://{tmp_path}/index", asked, 5)) == rows(so.batch(units, q, 5)) != []


def facts_of(spark, *texts, heading=None):
    """Per text, its facts in no order."""
    rows = spark.createDataFrame([(i, t, heading) for i, t in enumerate(texts)], "id int, text string, heading string")
    out = [[] for _ in texts]
    for r in extract.facts(rows, ["id"]).collect():
        out[r["id"]].append(r)
    return out


def test_facts(spark):
    got = facts_of(
        spark, "3 ft deep", '36" deep', "Dig hole 8 inches in diameter by 30 inches deep.", "6 in. (152 mm) diameter 24 in. (609.6 mm) deep", "1 1/2 in. diameter x 18 in. auger bit", "hog rings 24 in. on center",
        "Footing .75 in. deep", "30 1\u20448 in. deep", "Hole size for 4x4 posts = approximately 10\"", "depth 30 in. and depth 30 in., then 130\u00a0mph", None, "40 1/2\" On Center", "900 mph",
    )
    found = [sorted((f["fact_type"], f["value"]) for f in x) for x in got]
    assert found[:2] == [[("footing_depth_in", 36.0)]] * 2
    assert [f["raw"] for f in got[2] if f["fact_type"] == "footing_diameter_in"] == ["8"]
    assert ("footing_diameter_in", 24.0) not in found[3] and ("footing_depth_in", 24.0) in found[3]
    assert found[4:7] == [[], [], []]
    assert [(f["fact_type"], f["raw"], f["value"]) for f in got[7]] == [("footing_depth_in", "1\u20448", None)]
    assert [(f["value"], f["conditions"], f["condition_basis"]) for f in got[8]] == [(10.0, '{"post_size":"4x4"}', "stated")]
    assert found[9:] == [[("footing_depth_in", 30.0), ("wind_speed_mph", 130.0)], [], [], []]


def test_stated_conditions_and_numbers(spark):
    row = spark.createDataFrame([("Exposure C at 130 mph for 6 ft high fence", "Installation HVHZ")], "text string, heading string")
    got = row.select(*[c.alias(k) for k, c in extract.conditions(F.col("text"), F.col("heading")).items()]).first()
    assert got.asDict() == {"wind_speed_mph": "130.0", "exposure_category": "C", "fence_height": "6 ft", "hvhz": "true"}
    numbers = spark.createDataFrame([(i, x) for i, x in enumerate(("2½", "3/4", "x", "1/0"))], "i int, x string").select("i", extract.number(F.col("x")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in numbers] == [2.5, 0.75, None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab12 .()\nmc\"'ftinhdeph", max_size=80), min_size=1, max_size=60))
def test_blanking_keeps_places(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    assert all(r[0] == r[1] for r in rows.select(F.length("text"), F.length(extract.blanked(F.col("text")))).collect())
    for t, found in zip(texts, facts_of(spark, *texts), strict=True):
        for f in found:
            assert t[f["start"] : f["end"]].strip() == f["match_text"]


@given(st.text(alphabet="•-*abN. \n1)Note:", max_size=120), st.sampled_from(["text", "ocr"]))
def test_steps_slice_back_and_lose_nothing(t, source):
    steps = extract.split_steps(t, source)
    assert all(a.end <= b.start for a, b in zip(steps, steps[1:], strict=False))
    covered = "".join(t[s.start : s.end] for s in steps)
    assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", t)


def test_steps():
    block = "• Be sure to call underground (811) prior to digging\n• Assemble gates\n• Stake out the fence line"
    assert [s.kind for s in extract.split_steps(block)] == ["step"] * 3
    assert extract.split_steps("• N\never strike the post")[0].kind == "prohibition"
    assert extract.repaired("A cut panel") == (None, None)
    assert extract.repaired("B\ne sure") == ("Be sure", "high")


def test_html():
    html = "<h1>A</h1><p>b <b>c</b></p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>"
    e = sd.html_elements(html)
    assert e[0][1:4] == ("heading", 1, "A") and e[1][1:4] == ("paragraph", 0, "b c") and e[1][4] == ["A"]
    assert sd.html_cells(html) == [(0, 1, 0, "1"), (0, 1, 1, "2")]
    assert sd.html_elements(None) == []
    path = sd.HeadingPath()
    path.push(1, "a"), path.push(3, "b")
    assert path.push(2, "c") == ["a", "c"]
    with pytest.raises(ValueError):
        sd.extractor_of("x.bin")


def test_word_boxes():
    xml = '<html xmlns="http://www.w3.org/1999/xhtml"><doc><page><word xMin="1" yMin="2" xMax="3" yMax="4">a</word></page><page><word xMin="0" yMin="0" xMax="1" yMax="1">b</word></page></doc></html>'
    assert sd.layout_words(xml) == [(1, "a", 1.0, 2.0, 3.0, 4.0), (2, "b", 0.0, 0.0, 1.0, 1.0)]
    hocr = '<div><span class="ocrx_word" title="bbox 10 20 30 40; x_wconf 91">word</span><span class="ocrx_word" title="x">no</span></div>'
    assert sd.hocr_words(hocr, 0.5) == [("word", 5.0, 10.0, 15.0, 20.0, 91.0)]


def test_gold(spark, tmp_path):
    from tessellar.operators import validation as va

    (tmp_path / "set-a.jsonl").write_text('{"id": "q1", "question": "x", "answerable": true}\n{"id": "q2", "question": "y", "interface": "facts"}\n')
    got = {r["id"]: (r["interface"], r["set"]) for r in va.gold(spark, f"file://{tmp_path}").collect()}
    assert got == {"q1": ("search", "set-a"), "q2": ("facts", "set-a")}
    (tmp_path / "set-b.jsonl").write_text('{"id": "q3", "interface": "guess"}\n')
    with pytest.raises(Exception, match="unknown interface"):
        va.gold(spark, f"file://{tmp_path}").collect()


def test_docx():
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    assert [x[1:] for x in sd.docx_elements(buffer.getvalue())] == [("heading", 2, "Top", ["Top"]), ("paragraph", 0, "text", ["Top"]), ("table", 0, "1 | 2", ["Top"])]


def test_units_fold():
    e = lambda i, t, kind="paragraph", head="": {"page_no": 1, "ordinal": i, "element_type": kind, "heading": head, "text": t}
    units = sd.fold_units([e(0, "a"), e(1, "H", "heading"), e(2, "b"), e(3, "", "paragraph"), e(4, "t", "table"), e(5, "x" * 1401), e(6, "y"), e(7, "z", head="H")])
    assert [u["text"] for u in units] == ["a\nb", "t", "x" * 1401, "y", "z"]


def test_components_and_ranks(spark):
    e = spark.createDataFrame([(5, 3), (3, 9), (7, 8), (8, 8), (1, 2), (2, 4), (4, 1)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7, 1: 1, 2: 1, 4: 1}
    chain = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "older bigint, newer bigint")
    assert {r["node"]: r["rank"] for r in graph.ranks(chain, 10).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert graph.components(e.limit(0)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_match_union_find(spark, pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    want = {x: min(y for y in root if find(y) == find(x)) for x in root}
    got = graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == want


def test_relations_mirror(spark):
    r = graph.mirrored(spark.createDataFrame([(1, 2), (3, 3)], "a bigint, b bigint")).collect()
    assert sorted((x["from_id"], x["to_id"], x["relation"]) for x in r) == [(1, 2, "supersedes"), (2, 1, "superseded_by")]


def test_select_active(spark):
    rows = [("c1", "d1", "x", None, "2030-01-01", False, 1), ("c1", "d2", "x", None, "2030-01-01", False, 2), ("c2", "d3", "y", "superseded", None, False, 1), ("c3", "d4", "z", None, "2001-01-01", False, 1), ("c4", "d5", "p", "active", None, False, 1), ("c4", "d6", "q", "active", None, False, 2), ("c5", "d7", "r", None, None, False, 1), ("c5", "d8", "s", None, None, False, 2)]
    m = spark.createDataFrame(rows, "chain string, document_id string, content string, version_status string, expiration string, expiration_conflict boolean, position int")
    got = {r["chain"]: (r["active"], r["basis"]) for r in versions.select_active(m, "chain", "2020-01-01").collect()}
    assert got == {"c1": ("d1", "inferred_in_force"), "c2": (None, "none"), "c3": (None, "withdrawn"), "c4": (None, "conflict"), "c5": ("d8", "assumed_newest")}


def test_conditions(spark):
    rules = spark.createDataFrame([("r1", "B", None, 24), ("r2", None, 1, 30), ("r3", None, None, 24)], "rule string, e string, h int, value int")
    pts = co.points([spark.createDataFrame([("B",), ("C",)], "e string"), spark.createDataFrame([(0,), (1,)], "h int")])
    got = {(r["e"], r["h"], r["rule"]) for r in co.matches(rules, pts, ["e", "h"]).collect()}
    assert got == {("B", 0, "r1"), ("B", 1, "r1"), ("B", 1, "r2"), ("C", 1, "r2"), *[(e, h, "r3") for e in "BC" for h in (0, 1)]}
    two = rules.filter("rule <> 'r3'")
    assert [(r["e"], r["h"]) for r in co.uncovered(two, pts, ["e", "h"]).collect()] == [("C", 0)]
    assert [(r["e"], r["h"]) for r in co.collisions(two, pts, ["e", "h"], "value").collect()] == [("B", 1)]
    gaps = co.interval_gaps(spark.createDataFrame([("p", 0, 48), ("p", 49, 76), ("p", 10, 20)], "g string, lo int, hi int"), ["g"], "lo", "hi").collect()
    assert [(g["gap_min"], g["gap_max"]) for g in gaps] == [(48, 49)]
    with pytest.raises(ValueError):
        co.check_dimensions({"colour": 1}, {"exposure"})


def test_three_values(spark):
    df = spark.createDataFrame([("130", "130.0"), ("130", "131"), (None, "1"), ("b", "B")], "a string, b string")
    assert [r[0] for r in df.select(co.satisfies(F.col("a"), F.col("b"))).collect()] == [True, False, None, True]


def test_answers_from_a_snapshot():
    payload = {"parameter_tables": [{"parameter": "depth", "domain": {"exposure": ["B", "C"]}, "scope": {"mfr": "x"}, "rows": [{"conditions": {"exposure": "B"}, "value": "24 in"}, {"conditions": {"exposure": "C"}, "value": {"amount_milli": 762000}}]}]}
    got = pb.answer(payload, {"exposure": "c"}, {"mfr": "x"})
    assert [v["value"] for v in got["values"]] == [{"amount_milli": 762000}] and got["values"][0]["scope"] == "exact" and not got["conflicts"]
    assert pb.answer(payload, {})["conflicts"] == ["depth"] and pb.answer(payload, {})["unstated"] == ["exposure"]
    assert pb.answer(payload, {"exposure": "D"})["outside"] == [("depth", "exposure")]
    with pytest.raises(ValueError):
        pb.answer(payload, {"colour": "red"})
    with pytest.raises(ValueError):
        pb.required(None, None)


def test_snapshot_store(spark, tmp_path):
    store = pb.SnapshotStore(spark, f"file://{tmp_path}/snapshots")
    snap = pb.Snapshot({"source_docs": [{"id": "s1"}], "parameters": [{"id": "p1", "cites": ["s1"]}], "gaps": []})
    name = store.put(snap)
    assert store.put(pb.Snapshot(dict(reversed(snap.payload.items())))) == name
    assert store.get(name) == snap.payload and store.verify() == {name: "ok"}
    store.tombstone(name, "wrong")
    assert store.verify() == {name: "tombstone"} and store.list() == [name]
    bad = pb.Snapshot({"source_docs": [], "parameters": [{"id": "p", "cites": ["s"]}, {"id": "p", "cites": []}], "gaps": [{"kind": "odd"}]})
    assert len(bad.faults()) == 3
    with pytest.raises(ValueError):
        store.put(bad)


def test_reviews(spark):
    log = spark.createDataFrame([("f1", 1, "a", "accepted", "unreviewed", None), ("f1", 2, "b", "corrected", "accepted", "9"), ("f2", 1, "c", "rejected", "flagged", None)], "fact string, t int, id string, verdict string, before string, value string")
    p = {r["fact"]: r.asDict() for r in rv.project(log, ["fact"], ["t", "id"], "verdict", "before", "value").collect()}
    assert p["f1"]["status"] == "corrected" and p["f1"]["reviewed_value"] == "9" and p["f1"]["status_before"] == "unreviewed"
    old = spark.createDataFrame([("e", 1, "o1"), ("g", 1, "o2"), ("h", 1, "o3"), ("i", 1, "o4"), ("i", 2, "o5")], "el string, v int, o string")
    new = spark.createDataFrame([("e", 1, "n1"), ("g", 2, "n2"), ("i", 1, "n4")], "el string, v int, n string")
    got = {r["o"]: (r["n"], r["outcome"]) for r in rv.reattach(old, new, ["el"], "v", "o", "n").collect()}
    assert got == {"o1": ("n1", "attached"), "o2": (None, "value_changed"), "o3": (None, "orphaned"), "o4": (None, "ambiguous"), "o5": (None, "ambiguous")}
    grid = spark.createDataFrame([("r", [(0, 0, "a"), (0, 0, "b")], [(2, 1, 0, "x"), (0, 9, 0, "y")])], "review_id string, g array<struct<row:int,col:int,value:string>>, s array<struct<row_from:int,row_to:int,col:int,text:string>>")
    assert sorted(r["fault"] for r in rv.grid_faults(grid, "g", "s").collect()) == ["cell given twice", "span outside the grid", "span runs back"]


def test_ledger_round_trip(spark, tmp_path):
    log = spark.createDataFrame([("fact", "i2", "a", "me", "2020-01-02", "accepted", None), ("fact", "i1", "a", "me", "2020-01-01", "corrected", "3")], mf.LEDGER)
    mf.write_ledger(log, f"file://{tmp_path}/ledger")
    assert [r["id"] for r in mf.read_ledger(spark, f"file://{tmp_path}/ledger").orderBy("reviewed_at").collect()] == ["i1", "i2"]
    spark.createDataFrame([('{"kind":"header","count":5}',)], "value string").write.text(f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        mf.read_ledger(spark, f"file://{tmp_path}/bad")


def test_manifest(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    found = mf.inspect(spark, f"file://{tmp_path}")
    assert found.first()["file_type"] == "html" and found.first()["bytes"] == 8
    curated = spark.createDataFrame([("gone.pdf", "superseded")], "source_path string, note string")
    assert {r["source_path"].rsplit("/", 1)[-1]: r["on_disk"] for r in mf.manifest(found, curated).collect()} == {"a.html": True, "gone.pdf": False}
    old = spark.createDataFrame([(1, "t", "x"), (2, None, "y")], "id int, owner string, title string")
    rows, refused = mf.upsert(old, spark.createDataFrame([(1, "u", "z"), (3, "t", "w"), (2, None, "q")], "id int, owner string, title string"), "id", "owner")
    assert {r["id"]: r["title"] for r in rows.collect()} == {1: "x", 2: "q", 3: "w"}
    assert [r["id"] for r in refused.collect()] == [1]


def test_readings(spark, tmp_path):
    import json

    (tmp_path / "r.json").write_text(json.dumps({"crop_path": "c", "source_path": "s", "page_no": 1, "reader": "x", "is_table": True, "grid": {"headers": ["a", "b"], "rows": [{"cells": ["1", "2?"], "illegible": []}, {"cells": ["3", "4"], "illegible": [0]}]}}))
    (tmp_path / "n.json").write_text(json.dumps({"crop_path": "c", "source_path": "s", "page_no": 2, "reader": "x", "is_table": False}))
    got = sorted((r["page_no"], r["row_index"], r["col_index"], r["illegible"]) for r in mf.readings(spark, f"file://{tmp_path}").collect())
    assert got == [(1, 0, 0, False), (1, 0, 1, True), (1, 1, 0, True), (1, 1, 1, False), (2, -1, -1, False)]


def test_gates_are_not_rounded():
    assert not ev.gates(0.81, 0.699512, 0.7, 0.1)["support"]
    assert ev.gates(0.8, 0.70, 0.66, 0.2) == {"recall": True, "support": True, "no_answer_precision": True, "false_unsupported": True}


def test_layout(spark):
    words = spark.createDataFrame([("p", i, float(y), float(y + 2)) for i, y in enumerate((0, 5, 9, 30))], "page string, x0 int, y0 double, y1 double")
    assert [r["row"] for r in layout.cluster_rows(words, "page").orderBy("x0").collect()] == [0, 0, 1, 2]
    df = spark.createDataFrame([('#8 X 1 1/2" SET SCREWS',), ("1 3/4\" X 3 1/2\" RAIL",), ("HOURGLASS G-60 STEEL CHANNEL X 92",), (".5 INCH BULLET CLIP",), ("FULL LENGTH - 2",), ("SNAP CAP",)], "x string")
    got = [r[0] for r in df.select(layout.parse_description(F.col("x"))).collect()]
    assert got[0]["gauge"] == "#8" and got[0]["length"] == "1 1/2" and got[0]["type_phrase"] == "SET SCREWS" and got[0]["section"] is None
    assert got[1]["section"] == "1 3/4 X 3 1/2" and got[2]["length"] == "92" and got[3]["size"] == ".5" and got[4] is None and got[5]["pattern"] == "type_only"
    assert [r[0] for r in df.select(layout.spine_type(F.col("x"))).collect()][5] is None


def test_stream_of_files(spark, tmp_path):
    from tessellar.streaming.ingest import extract_new

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>A</h1><p>b</p>")
    for _ in range(2):  # a second run finds nothing new
        extract_new(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
