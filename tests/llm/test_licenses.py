"""Every license and every place of it is reported."""

from tessellar.llm import licenses

MIT, GPL, NOTICE = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-header"], licenses.TEMPLATES["MIT-notice"]
SCANNER = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE)


def prose(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def found(text):
    return [(p[0], p[1], p[4]) for p in SCANNER.places(text.encode())]


def test_all_licenses_and_places(spark):
    gpl = GPL.replace("useful", "handy", 1)
    text = f"{NOTICE} {prose(50)} {gpl} {prose(40, 'x')} {NOTICE}"
    n = len(GPL.split())
    assert found(text) == [("MIT-notice", 1.0, 0), ("MIT-notice", 1.0, 5 + 50 + n + 40), ("GPL-3.0-header", (n - 1) / n, 55), ("GPL-3.0-notice", 10 / 12, 55)]  # the header holds ten of the notice's words
    row = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, None), (3, prose(9))], "doc_id bigint, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [r["license"] for r in row] == ["MIT-notice", None, None] and [len(r["places"]) for r in row] == [4, 0, 0]
    assert row[0]["places"][2]["license"] == "GPL-3.0-header"


def test_repeated_places():
    assert [p[2] for p in found((NOTICE + " ") * 3)] == [0, 5, 10]
    assert [p[:2] for p in found(f"{MIT} {prose(30)} {MIT}")] == [("MIT", 1.0)] * 2


def test_interrupted_license():
    words = MIT.split()
    half = len(words) // 2
    text = " ".join([prose(20, "a"), *words[:half], prose(5 * len(words)), *words[half:], prose(20, "b")])
    assert found(text) == [("MIT", 1.0, 20)]
