"""The lattice and the scores made of it, against enumeration of all segmentations."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from tessellar.llm import lattice


def test_long_pieces_are_in_the_marginal():
    long = b" internationalisation"
    la = lattice.Lattice({long: 0.5, b" international": 0.3, b"isation": 0.2, b"s": 0.1})
    p = dict(zip(la.pieces, np.exp(la.logs[0]), strict=False))
    end = np.exp(la.logs[0][-1])

    def brute(text):
        ways = [0.0] * len(text) + [end]
        for i in range(len(text) - 1, -1, -1):
            ways[i] = sum(p[text[i:j]] * ways[j] for j in range(i + 1, len(text) + 1) if text[i:j] in p and (i == 0 or text[i : i + 1] != b" "))
        return ways[0]

    assert la.longest == len(long)
    assert np.exp(la.forward([b"internationalisation", b"internationals"])[0]) == pytest.approx([brute(b" internationalisation"), brute(b" internationals")])


@pytest.mark.skipif(not os.path.exists(lattice.VOCABULARY), reason="no vocabulary")
def test_all_lower_case_pieces_are_loaded():
    assert {b" international", b" organization", b" relationship"} <= set(lattice.load_pieces(lattice.VOCABULARY))


def segmentations(word, weights):
    """[(pieces, product of weights)] of a word (its blank included), tried out one by one."""
    if not word:
        return [((), 1.0)]
    return [((word[:n], *rest), weights[word[:n]] * p) for n in range(1, len(word) + 1) if word[:n] in weights for rest, p in segmentations(word[n:], weights)]


def plain_scores(rows, pieces, scored):
    """The docstring's model by enumeration: (doc_id, score), logarithms to base 10."""
    pieces = {bytes([b]): 1e-7 for b in range(256)} | {b" ": 1e-3} | pieces
    longest = max(map(len, pieces))
    starts = {p: p[:1] == b" " for p in pieces}
    kind = {p: (starts[p], len(p)) for p in pieces} | {None: (None, 0)}

    def normal(w):
        total = {s: sum(x for p, x in w.items() if (p is not None and starts[p]) == s) for s in (True, False)}
        return {p: x / total[p is not None and starts[p]] for p, x in w.items()}

    assert longest < 9
    prior = normal(pieces | {None: 0.4 * sum(x for p, x in pieces.items() if not starts[p])})
    words = lambda t: [w for w in (t or "").lower().encode().split()]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    langs = [x for x, _ in sorted(Counter(r[1] for r in train if r[1]).items(), key=lambda x: (-x[1], x[0]))][: lattice.CLASSES]
    of = lambda lang: langs.index(lang) if lang in langs else len(langs)
    counts = [Counter() for _ in range(len(langs) + 1)]
    ends = [0] * len(counts)
    for i, lang, t in train:
        counts[of(lang)].update(words(t))
        ends[of(lang)] += 1
    both = sum(counts, Counter())
    models = []
    for c in counts:
        w = prior
        for _ in range(lattice.PASSES):
            if not c:
                break
            expected = Counter()
            for word in c:
                every = segmentations(b" " + word, w)
                total = sum(p for _, p in every)
                for seg, p in every:
                    for x in seg:
                        expected[x] += p / total
                expected[None] += 1
            counted = {p: expected[p] + lattice.PRIOR * prior[p] for p in prior}
            mass, own = Counter(), Counter()
            for p in prior:
                mass[kind[p]] += counted[p]
                own[kind[p]] += prior[p]
            w = normal({p: scored * prior[p] * mass[kind[p]] / own[kind[p]] + (1 - scored) * counted[p] for p in prior})
        models.append(w)
    out = []
    for i, _, t in rows:
        total = 0.0
        for c, e, w in zip(counts, ends, models, strict=True):
            if not e:
                continue
            n = sum(c.values()) + e
            one, two = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
            d = one / (one + 2 * two) if one and two else 0.5
            p = e / sum(ends) * e / (n + 0.5)
            for word in words(t):
                spelled = w[None] * sum(x for _, x in segmentations(b" " + word, w))
                q = lattice.BACK * both[word] / sum(both.values()) + (1 - lattice.BACK) * spelled
                p *= (max(c[word] - d, 0) + (d * len(c) + 0.5) * q) / (n + 0.5)
            total += p
        out.append((i, math.log10(total)))
    return out


SMALL = {b" th": 0.05, b" the": 0.1, b"e": 0.2, b"he": 0.1, b" a": 0.1, b"b": 0.05, b"ab": 0.02, b"c": 0.01, b"at": 0.03, b" c": 0.04}
TEXTS = [(i, ("en", "de", None)[i % 3], ("the cat", "abab the", "The bat at", "", "c", None, "hat the the", "beta ab", "tab cab the", "cat cat")[i % 10]) for i in range(24)]


@pytest.mark.parametrize("scored", [1.0, 0.5, 0.0])
def test_scores_against_enumeration(spark, monkeypatch, scored):
    monkeypatch.setattr(lattice, "SCORED", scored)
    monkeypatch.setattr(lattice, "load_pieces", lambda path: dict(SMALL))
    docs = lattice.folded(spark.createDataFrame(TEXTS, "doc_id bigint, lang string, text string"))
    got = {r["doc_id"]: r["score"] for r in lattice.scored(docs, lattice.train(docs)).collect()}
    assert got == pytest.approx(dict(plain_scores(TEXTS, dict(SMALL), scored)), abs=1e-6)


def test_the_vocabulary_s_scores_weigh(spark, monkeypatch):
    """With all scores set equal, rows come out otherwise."""
    docs = lattice.folded(spark.createDataFrame(TEXTS, "doc_id bigint, lang string, text string"))
    out = []
    for pieces in (SMALL, dict.fromkeys(SMALL, 0.07)):
        monkeypatch.setattr(lattice, "load_pieces", lambda path, pieces=pieces: dict(pieces))
        out.append({r["doc_id"]: r["score"] for r in lattice.scored(docs, lattice.train(docs)).collect()})
    assert sum(abs(out[0][i] - out[1][i]) > 1e-3 for i in out[0]) > 6
