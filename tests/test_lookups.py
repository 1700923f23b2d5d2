"""Look-ups, labels, approvals, warnings' classes and filings on small rows, nulls and ties among them."""

from pyspark.sql import functions as F

from tessellar.operators import lookups as lo


def one(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in given.items()])
    return row.select(column.alias("x")).first().x


def test_text_falls_back(spark):
    assert one(spark, lo.text_or_ocr(F.col("a"), F.col("b")), a=" \t", b=" seen\n") == "seen"
    assert one(spark, lo.text_or_ocr(F.lit(None).cast("string"), F.lit(None).cast("string")), a=1) == ""


def test_labels_take_the_first_match(spark):
    said = lambda x, t: one(spark, lo.labelled(F.col("a"), t), a=x)
    assert said(" Min. Footing Depth", lo.VALUE_LABELS) == "footing_depth_in"
    assert said("exposures", lo.CONDITION_LABELS) is None and said("", lo.VALUE_LABELS) is None
    assert one(spark, lo.labelled(F.lit(None).cast("string"), lo.VALUE_LABELS), a=1) is None


def test_fact_lookup_filters_before_its_limit(spark):
    facts = spark.createDataFrame([(i, 1 if i < 9 else 2, "depth", 5 - i % 3, "rejected" if i == 0 else None if i == 1 else "extracted", {"h": "6"} if i % 2 else None) for i in range(12)], "fact_id int, document_id int, fact_type string, page_no int, review_status string, conditions map<string,string>")
    docs = spark.createDataFrame([(1, "a", None), (2, "b", "active")], "document_id int, manufacturer string, version_status string")
    got = [r.fact_id for r in lo.fact_lookup(facts, docs, "depth", {"h": 6}, limit=3).collect()]
    assert got == [11, 9, 5]
    assert lo.fact_lookup(facts.limit(0), docs).count() == 0 and lo.fact_lookup(facts, docs, maker="c").count() == 0


def test_approvals(spark):
    who = lambda p, t: one(spark, lo.approval_id(F.col("p"), F.col("t")), p=p, t=t)
    assert who("a/12-0345.06.pdf", "99-0000.00") == "12-0345.06" and who("a/112-0345.06", "is 99-0000.00") == "99-0000.00" and who("a", "b") is None
    docs = spark.createDataFrame([(1, "12-0345.06"), (2, "11-0345.06"), (3, None), (4, "11-0345.06")], "document_id int, approval string")
    said = spark.createDataFrame([(1, 1, "Renewal of NOA # 11 - 0345 . 06"), (1, 7, "previous approval 12-0345.06"), (2, 2, "previous approval 11-0345.06"), (3, 1, "PREVIOUS  approval #12-0345.06"), (3, 1, None)], "document_id int, page_no int, text string")
    assert sorted(map(tuple, lo.approval_edges(docs, said).collect())) == [(1, 2), (1, 4), (3, 1)]


def test_warning_classes(spark):
    said = lambda x: one(spark, lo.warning_class(F.col("a")), a=x)
    for x, kind in {"NOTE:": "alone", "* Caution - hot": "led", "30 * Caution – hot": "led", "it can result in harm": "hazard", "Never strike a post": "rule", "NOTICE OF ACCEPTANCE: x": "excluded", "Note that": "none", "": "none", "AVERTISSEMENT !": "alone"}.items():
        assert said(x) == kind, x
    assert one(spark, lo.dangling(F.col("a")), a="dig to the ") and not one(spark, lo.dangling(F.col("a")), a="éto")
    assert one(spark, lo.interleaved(F.col("a")), a="tighten the Note: line up") and not one(spark, lo.interleaved(F.col("a")), a="Note: line up")


def test_kit_tables(spark):
    grid = lambda t, head, below: [(t, 2, c, x) for c, x in enumerate(head)] + [(t, 3 + i, c, x) for i, r in enumerate(below) for c, x in enumerate(r)]
    three = [("1", "post", None), (" 2 ", "cap", ""), ("3", "rail", "x")]
    cells = grid(1, ("Qty", "Item", "Dimensions"), three) + grid(2, ("Qty", "Item", None), [*three[:2], ("3 pcs", "rail", "")]) + grid(3, ("Qty", "Colour", ""), three)
    got = lo.kit_tables(spark.createDataFrame(cells, "t int, row int, col int, text string"), ["t"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 2, 3)]


def test_records_classes_and_places(spark):
    unlike = F.map_entries(lo.differences(F.expr("map('b', '1', 'a', 'x', 'c', null)"), F.expr("map('b', '1', 'a', 'y', 'd', 'z')")))
    assert [(e.key, tuple(e.value)) for e in spark.range(1).select(unlike.alias("d")).first().d] == [("a", ("x", "y")), ("d", (None, "z"))]
    filed = spark.createDataFrame([("s", "u"), ("s", "k1"), ("t", "u"), ("t", None), ("v", "k1"), ("v", "k2")], "sha string, kind string")
    got = lo.source_classes(filed, "sha", F.col("kind"), {"k1": "high", "k2": "low", "u": "low"}, ("u",), "low")
    assert sorted(map(tuple, got.collect())) == [("s", "high", None), ("t", "low", "source_class_unclassified"), ("v", None, "source_class_disagreement")]
    found = spark.createDataFrame([("e", 0, 4), ("e", 0, 4), ("e", 5, 9)], "element_id string, start int, end int")
    assert lo.proposed(found, found.limit(0)).count() == 2 and lo.proposed(found, found).count() == 0
    assert one(spark, lo.curation_level(F.col("a")), a="corrected") == 2 and one(spark, lo.curation_level(F.lit(None).cast("string")), a=1) == 0


def test_same_family_needs_an_unreviewed_first_reading(spark):
    rows = [(1, "c", "a", '6"', False, "unreviewed"), (2, "c", "b", "6 in.", False, "accepted"), (3, "d", "a", "7", False, "accepted"), (4, "d", "b", "7", False, "unreviewed"), (5, "e", "a", "8", True, "unreviewed"), (6, "e", "b", "8", False, "unreviewed"), (7, "f", "a", None, False, "unreviewed")]
    r = spark.createDataFrame(rows, "candidate_id int, cell string, reader string, value string, illegible boolean, review_status string")
    assert sorted(x.candidate_id for x in lo.same_family(r, ["cell"], "a", "b").collect()) == [1, 2]


def test_words_of_values_and_points(spark):
    assert one(spark, lo.value_lexemes(F.col("a"), F.col("b")), a=" 6 in ", b=["6 in", "", "150 mm"]) == ["6 in", "150 mm"]
    assert one(spark, lo.value_lexemes(F.lit(None).cast("string"), F.lit(None).cast("array<string>")), a=1) == []
    none = F.lit(None)
    assert one(spark, lo.point_words(none.cast("string"), none.cast("boolean"), {}), a=1) == "any conditions"
    assert one(spark, lo.point_words(F.lit("C"), F.lit(False), {"soil_type": F.lit(2)}), a=1) == "exposure C, non-HVHZ, soil type 2"
    to = one(spark, lo.attachment(F.col("k"), F.col("p"), F.lit("sha")), k="manual", p=["Step 1", "STEP 2", "Tools"])
    assert tuple(to) == ("step", "STEP 2")
