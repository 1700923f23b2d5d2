from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.functions import dates, ids, quantity, text


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column).collect()]


def test_strict_dates(spark):
    cases = {"04/04/2013": "2013-04-04", "04/24/2025": "2025-04-24", "05/04/2023": None, "13/05/2023": None, "02/30/2020": None, "2015-02-30": None, "Expiration Date: 03/13/2018": "2018-03-13", "12-1106.11": None, "03/13/20188": None, "2020-01-01 to 2021-01-01": None, "2020-01-01 and 2020-01-01": "2020-01-01", "": None}
    assert values(spark, dates.strict_date(F.col("x")), list(cases)) == list(cases.values())


def test_lenient_dates(spark):
    cases = {"3/4/69": "2069-03-04", "3/4/70": "1970-03-04", "March 5, 2020": "2020-03-05", "on 2011-02-03": "2011-02-03", "Foo 5, 2020": None, "31/31/2020": None}
    assert values(spark, dates.lenient_date(F.col("x")), list(cases)) == list(cases.values())


def test_edition_stamps(spark):
    cases = {"WEB REV 3.21": "2021-03", "REV. 4.24": "2024-04", "Sheet 7 | Revised 2/2026": "2026-02", "Revision 4 dated 09/16/2009": None, "REV 13.21": None}
    assert values(spark, dates.edition_stamp(F.col("x")), list(cases)) == list(cases.values())


def test_measures_and_intervals(spark):
    got = values(spark, quantity.measure(F.col("x"))["amount_milli"], ['96 1/8"', "2½ in.", '3/4"', "8'", "10 mm", "nothing", "1.5 cm"])
    assert got == [2441575, 63500, 19050, 2438400, 10000, None, 15000]
    got = values(spark, quantity.interval(F.col("x")), ['Up to 48"', '49" to 76"', "8'"])
    assert [(g["min"], g["max"]) for g in got] == [(None, 1219200), (1244600, 1930400), (2438400, 2438400)]


def test_half_away_from_zero(spark):
    pairs = [(1, 2), (-1, 2), (3, 2), (5, 4), (-7, 4), (0, 3), (769 * 25400, 8)]
    rows = spark.createDataFrame(pairs, "n bigint, d bigint").select("n", "d", quantity.half_away(F.col("n"), F.col("d")).alias("r")).collect()
    for r in rows:
        f = Fraction(r["n"], r["d"])
        assert r["r"] == (1 if f >= 0 else -1) * int(abs(f) + Fraction(1, 2))


def test_touching_intervals_overlap_only_if_both_ends_count(spark):
    kind = "struct<min:bigint,max:bigint,min_inclusive:boolean,max_inclusive:boolean>"
    rows = [((0, 5, True, True), (5, 9, True, True), True), ((0, 5, True, False), (5, 9, True, True), False), ((None, 5, True, True), (6, None, True, True), False), ((None, None, True, True), (6, None, True, True), True)]
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}, want boolean").select(quantity.overlap(F.col("a"), F.col("b")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_numbers_compare_as_numbers(spark):
    assert values(spark, quantity.scalar_text(F.col("x")), ["130", "130.0", "130.50", " B ", "0.0"]) == ["130", "130", "130.5", "b", "0"]


def test_language(spark):
    cases = {"": "und", '30" 1-1/2': "und", "vous les avec pour": "fr", "para una seguridad": "es", "PREFACE 05 OUR ADVANTAGES": "en", "型号 A5": "zh", "panel de force": "en"}
    assert values(spark, text.detect_lang(F.col("x")), list(cases)) == list(cases.values())


def test_mojibake_needs_both_signals(spark):
    bad = "é\x01öü ßñç " * 60
    assert values(spark, text.is_mojibake(F.col("x")), [bad, "\x01 plain words here " * 20, "é\x01ö", "型" * 300]) == [True, False, False, False]


def test_folds(spark):
    assert values(spark, text.norm_ws(F.col("x")), ["1. None.", "1.  none.\n"]) == ["1. none."] * 2
    assert values(spark, text.norm_reading(F.col("x")), ["36 inches", "36''", " 36 IN. ", "36″"]) == ['36"'] * 4
    assert values(spark, text.slug(F.col("x")), ["Acme & Co.", "--x--"]) == ["acme-co", "x"]
    assert values(spark, text.bracket_of_span(F.col("x")), ["HVHZ and non-HVHZ", "Non-HVHZ only", "HVHZ", "", "x"]) == ["both", "non-hvhz", "hvhz", "none printed", None]


def test_phrases_overlap(spark):
    words = F.split("x", " ")
    assert values(spark, text.phrase_hits(words, ["a", "a"]), ["a a a b", "b", "aa a"]) == [2, 0, 0]
    assert values(spark, text.ngrams(words, 2), ["a b c", "a"]) == [["a b", "b c"], []]


def test_ids_are_functions_of_content(spark):
    import hashlib

    got = values(spark, ids.ref_id(F.col("x"), F.lit(3), F.lit(None)), ["abc"])
    assert got == [hashlib.sha256(b"abc:3:None").hexdigest()[:16]]
    with pytest.raises(ValueError):
        ids.no_floats(T.StructType([T.StructField("a", T.ArrayType(T.DoubleType()))]))


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8))
def test_canonical_bytes_ignore_insertion_order(value):
    def turned(v):
        if isinstance(v, dict):
            return {k: turned(v[k]) for k in reversed(list(v))}
        return [turned(x) for x in v] if isinstance(v, list) else v

    assert ids.canonical_bytes(value) == ids.canonical_bytes(turned(value))


def test_canonical_bytes_refuse_floats():
    with pytest.raises(ValueError):
        ids.canonical_bytes({"a": [1.5]})
