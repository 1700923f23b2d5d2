"""Stages keep other columns as they are, whatever their names; rows that repeat stay rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from tessellar.llm.hashing import runs, word_hashes

NAMES = ["_id", "_gone", "_row1", "_row2", "_likely", "_hit", "_parts", "_edges", "gone", "hit", "likely", "gone_of_lines", "kept", "n"]


@pytest.fixture(scope="module")
def named(spark):
    texts = ["one shared line of this\nown " + "x" * i for i in range(6)]
    return spark.createDataFrame([(i, t, "en", "s", len(t), *range(len(NAMES))) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in NAMES))


def unchanged(out):
    rows = out.collect()
    assert rows and all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows)
    return rows


def test_stages_keep_clashing_columns(spark, named):
    labels = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id bigint, quality int")
    assert {r["n_dropped"] for r in unchanged(line_dedup.dedup_lines(named))} == {0, 1}
    unchanged(quality.keep_good(named, labels))
    unchanged(jaccard_join.keep_first(named))
    items = spark.createDataFrame([(1, "own xxx")], "item_id bigint, text string")
    assert {r["doc_id"] for r in unchanged(decontaminate.clean(named, items, telling=1))} == {0, 1, 2, 4, 5}


def test_a_line_of_every_document_and_rare_ones(spark):
    """Hot keys and others go by different ways; both drop all but the smallest id's."""
    rows = [(i, f"the line that all hold\nthe line of two, number {i // 2}\nonly this one has {i}") for i in range(300)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {i: (i > 0) + i % 2 for i in range(300)}


def test_the_classifier_reads_a_bounded_number_of_rows(spark, monkeypatch):
    """Ids that repeat count once: rows, not ids, are bounded."""
    rows = spark.createDataFrame([(i % 7, f"word{i} and more", i) for i in range(700)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda starts, index, value, label: seen.append(len(label)))
    quality.train(rows, labels, max_train=5)
    assert 0 < seen[0] <= 5


def test_mixing_keeps_repeated_rows(spark):
    rows = [(1, "s", None), (1, "s", None), (1, "s", ""), (None, None, ""), (None, None, ""), (2, "s", "a b c"), (2, "s", "a b c"), (2, "s", "a b c")]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), block=2, slots=4).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((i or 0, len((t or "").split())) for i, _, t in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def plain_overlaps(doc, item, min_match):
    """(equal, start, item start, words) by trying every diagonal with a seed, one run at a time."""
    n, m = len(doc), len(item)
    if m < min_match:
        starts = [p for p in range(n - m + 1) if m and doc[p : p + m] == item]
        return (m, starts[0], 0, m) if starts else None
    best = None
    for d in range(1 - m, n):
        same = {j: doc[d + j] == item[j] for j in range(m) if 0 <= d + j < n}
        if not any(all(same.get(j + k) for k in decontaminate.positions(mask)) for mask in decontaminate.MASKS for j in range(m)):
            continue
        # the run of the highest score that ends first and, of those, begins last
        top = None
        total, low, begin = 0, 0, min(same)
        for j in sorted(same):
            total += 1 if same[j] else -2
            if total - low > (top[0] if top else 0):
                top = (total - low, begin, j + 1)
            if total <= low:
                low, begin = total, j + 1
        if top is None:
            continue
        equal = sum(same[j] for j in range(top[1], top[2]))
        mine = (equal, d + top[1], top[1], top[2] - top[1])
        if best is None or (-mine[0], mine[1]) < (-best[0], best[1]):
            best = mine
    return best if best and best[0] >= min_match else None


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("crowded", [0, decontaminate.CROWDED])
def test_overlaps_against_all_diagonals(seed, crowded, monkeypatch):
    """Few words, so that seeds meet everywhere; both ways of comparing diagonals give the plain result."""
    monkeypatch.setattr(decontaminate, "CROWDED", crowded)
    rng = np.random.default_rng(seed)
    letters = [chr(97 + i) for i in range(2 + 3 * (seed % 3))]
    draw = lambda n: [letters[i] for i in rng.integers(0, len(letters), n)]
    docs = [draw(60), draw(3), [], ["a"] * 40, draw(25)]
    items = [draw(20), docs[0][10:30], docs[0][5:17] + draw(1) + docs[0][18:40], ["a"] * 30, draw(2), [], docs[4][:11], ["a", "b"] * 8, draw(20)]
    blob = lambda parts: [" ".join(p).encode() for p in parts]
    index = decontaminate.Index(list(range(len(items))), blob(items))
    h, at = word_hashes(blob(docs), decontaminate.DROP)
    got = index.found(h, at)
    want = {(r, i): x for r, d in enumerate(docs) for i, t in enumerate(items) if (x := plain_overlaps(d, t, decontaminate.MIN_MATCH))}
    assert got == want


def test_overlaps_of_repeated_words_end(spark):
    """A long document and a long item of one word: the pairs of positions are never formed."""
    docs = spark.createDataFrame([(1, "w " * 200_000), (2, "w " * 500 + "v")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "w " * 1000), (None, "w " * 300)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["n_match"]) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 1): (0, 1000), (1, None): (0, 300), (2, 1): (0, 500), (2, None): (0, 300)}


def test_runs_are_shorter_than_their_mask():
    assert len(runs(np.zeros(3, np.uint64), (0, 1, 2, 3))) == 0


def test_short_items_match_whole(spark):
    docs = spark.createDataFrame([(1, "so say yes now"), (2, "say no"), (3, "Yes")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "yes"), (8, "say yes"), (9, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 7), (1, 8), (3, 7)}
    assert decontaminate.clean(docs, items).filter(F.col("doc_id") > 0).count() == 3
