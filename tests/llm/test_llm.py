"""The training-data operators against brute force, on small tables that hold the odd cases."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.llm import decontaminate, hashing, jaccard_join, lattice, licenses, line_dedup, media, mixing, quality, suffix_dedup, token_rollup

WORDS = "the of and in to a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (str(i) if i % 7 == 0 else "") for i in rng.integers(0, len(WORDS), n))


BASE = prose(1, 400)
NEAR = BASE.replace(" water ", " fire ", 1).replace(" people ", " folk ", 1)
LINES = "A shared line of text\n" + prose(3, 30) + "\n  A SHARED line of text \nshort\n\nshort"
ROWS = [
    (1, BASE, "en", "s1"), (2, NEAR, "en", "s1"), (3, BASE, "en", None), (4, None, None, None), (5, "", "fr", "s2"), (6, LINES, "en", "s2"), (7, LINES, "en", "s3"),
    (7, LINES, "en", "s3"), (8, prose(4, 20000), "en", "s1"), (9, "word", "xx", "s4"), (None, prose(5, 50), "fr", "s1"), (10, "größe 日本 x\tb\x0bc", "de", "s2"), (11, "abc " * 300, "en", "s1"),
    *[(20 + i, prose(100 + i, 80 + 13 * i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(25)],
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, size string, gone int, score string, k string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 7, "x", 3, "y", "z") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def same(got, want):
    assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


SPACES = " \t\n\x0b\x0c\r"


def test_line_dedup(docs, none):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(SPACES))
    low = lambda i: -(2**63) if i is None else i
    held = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(low(i))
    want = []
    for i, t, *_ in ROWS:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(held.get(key(x), ())) > 1 and low(i) > min(held[key(x)]))]
        want.append((i, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    out = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    same([tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()], want)
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(docs, min_docs=3).agg(F.sum("n_dropped")).first()[0] <= sum(w[2] for w in want)


def tokens(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize(("k", "num", "bounds"), [(3, 90, {}), (5, 80, {}), (2, 50, {}), (2, 50, {"block_shingles": 300}), (3, 80, {"block_shingles": 300, "many": 1})])
def test_jaccard(docs, none, k, num, bounds):
    sets = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        w = tokens(t)
        s = frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[-1 if i is None else i].add(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(s and t and 100 * len(s & t) >= num * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = jaccard_join.near_duplicates(docs, k, num, 100, **bounds).collect()
    assert len(got) == len(ROWS)
    for r in got:
        i = -1 if r["doc_id"] is None else r["doc_id"]
        want = min(x for x in sets if find(x) == find(i))
        assert (-1 if r["component_id"] is None else r["component_id"]) == want
        assert r["n_shingles"] in {len(s) for s in sets[i]}
    assert jaccard_join.near_duplicates(none).count() == 0
    kept = {r["doc_id"] for r in jaccard_join.keep_first(docs).collect()}
    assert 1 in kept and 3 not in kept and 4 in kept and 5 in kept


def test_jaccard_chains_are_dealt_by_keys(spark):
    """400 sets that meet in a chain are no 40 copies of each; near copies, whose keys all meet, stay in blocks."""
    chain = [(i, 100, i, i, 0) for i in range(400)]
    copies = [(i, 100, i, i, 1000) for i in range(1000, 1030)]
    members = spark.createDataFrame(chain + copies, "id bigint, n bigint, c1 bigint, c2 bigint, component bigint")
    met = [(i, k, k) for k in range(399) for i in (k, k + 1)]
    met += [(i, 5000 + k, 1000) for k in range(90) for i in range(1000, 1030) if (i * 7 + k) % 10]  # a key lacks three of them
    got = jaccard_join.dealt(members, spark.createDataFrame(met, "c1 bigint, key bigint, low bigint"), 1000).collect()
    homes = collections.defaultdict(set)
    for r in got:
        homes[r["id"]].add((r["kind"], r["home"]))
    assert sum(r["blocks"] for r in got if r["id"] < 1000) <= 2 * 400
    assert all(homes[i] & homes[i + 1] for i in range(399))
    assert sorted((r["id"], r["kind"], r["blocks"]) for r in got if r["id"] >= 1000) == [(i, "component", 3) for i in range(1000, 1030)]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_pigeonhole_loses_no_pair(data):
    """Two sets above the threshold share a key, whatever differs."""
    num = data.draw(st.sampled_from([50, 80, 90]))
    plan = jaccard_join.Plan(num, 100, data.draw(st.sampled_from([1, 10**4, 10**6, 10**10])))
    n = data.draw(st.integers(1, 160))
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    whole = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
    a, b = (np.unique(np.concatenate([whole[rng.random(len(whole)) > 0.04], rng.integers(1, 2**63, rng.integers(0, 3), dtype=np.uint64)])) for _ in "ab")
    both = len(np.intersect1d(a, b))
    if len(a) and len(b) and jaccard_join.linked(len(a), len(b), both, num, 100):
        assert len(np.intersect1d(plan.keys(a), plan.keys(b)))


@pytest.mark.parametrize("num", [80, 90])
def test_neighbourhoods_and_spare_weight_are_allotted(num):
    """At both thresholds in use, small sets have neighbourhoods, larger ones leave empty keys out, and unrelated sets
    hardly meet."""
    plan = jaccard_join.Plan(num, 100, 10**6)
    allotted = [plan.allot(k) for k in range(30)]
    assert any(two for _, two, _ in allotted) and any(spare for *_, spare in allotted)
    rng = np.random.default_rng(2)
    for n in (12, 40, 150, 700):
        keys = collections.Counter(k for _ in range(400) for k in plan.keys(np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))).tolist())
        assert max(keys.values()) <= (12 if n < 15 else 3)


def test_verified_edges_connect_what_is_linked():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.06], rng.integers(1, 2**63, 2, dtype=np.uint64)])) for _ in range(40)] + [np.unique(rng.integers(1, 2**63, 30, dtype=np.uint64)) for _ in range(5)]

    def parts(edges):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            p, q = sorted((find(a), find(b)))
            root[q] = p
        return [find(x) for x in range(len(sets))]

    for num in (80, 90):
        brute = [(x, y) for x in range(len(sets)) for y in range(x) if jaccard_join.linked(len(sets[x]), len(sets[y]), len(np.intersect1d(sets[x], sets[y])), num, 100)]
        assert parts(jaccard_join.verified_edges(list(range(len(sets))), None, sets, num, 100)) == parts(brute)
        side = [x % 2 for x in range(len(sets))]
        across = jaccard_join.verified_edges(list(range(len(sets))), side, sets, num, 100)
        assert parts(across) == parts([(x, y) for x, y in brute if side[x] != side[y]])


@pytest.mark.parametrize("shard_bytes", [suffix_dedup.SHARD_BYTES, 700])
def test_suffix_dedup(docs, none, shard_bytes):
    n = suffix_dedup.LENGTH
    blobs = [(i, (t or "").encode()) for i, t, *_ in ROWS]
    seen = collections.Counter(b[p : p + n] for _, b in blobs for p in range(len(b) - n + 1))
    want = []
    for i, b in blobs:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), sha(kept)))
    got = suffix_dedup.dedup_bytes(docs, shard_bytes=shard_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    same([tuple(r) for r in got], want)
    assert suffix_dedup.dedup_bytes(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=300).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(8, 40))
def test_suffix_order_and_prefixes(data, n):
    if len(data) < n:
        return
    shard = suffix_dedup.Shard([data], n)
    starts = list(range(len(data) - n + 1))
    assert [data[p : p + n] for p in shard.order] == sorted(data[p : p + n] for p in starts)
    count = collections.Counter(data[p : p + n] for p in starts)
    marked = shard.repeated()
    assert [bool(marked[p]) for p in starts] == [count[data[p : p + n]] > 1 for p in starts]
    other = suffix_dedup.Shard([data[len(data) // 3 :] + b"b" * n], n)
    theirs = {bytes(other.data[p : p + n]) for p in other.starts}
    found = shard.found_in(other)
    assert [bool(found[p]) for p in starts] == [data[p : p + n] in theirs for p in starts]


def test_media(docs, none, tmp_path):
    rows, index = media.media_columns(docs, f"file://{tmp_path}/media")
    full = {r["digest"]: r for r in media.with_features(index).collect()}
    places = {r["digest"]: r for r in index.collect()}
    got = rows.collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in ROWS)
    wanted = {sha(media.payload((t or "").encode())) for _, t, *_ in ROWS}
    assert set(full) == wanted == set(places)
    for _, t, *_ in ROWS:
        x = media.payload((t or "").encode())
        r, p = full[sha(x)], places[sha(x)]
        assert len(x) % 192 == 0 and x
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(x), sha(x), zlib.crc32(x[-16:]))
        assert p["width"] * p["height"] == len(x) and p["bits"] == 8
        disk, path = media.open_store(p["shard"])
        with disk.open_input_file(path) as f:
            stored = f.read_at(p["length"], p["offset"])
        assert sha(stored) == r["media_sha256"] and media.decode(stored) == x
    import tarfile

    with tarfile.open(media.open_store(next(iter(places.values()))["shard"])[1]) as tar:
        assert all(m.name.endswith(".png") and m.size for m in tar.getmembers())
    assert media.write_shards(none, f"file://{tmp_path}/empty").count() == 0


def water(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(docs, none):
    got = mixing.taken(docs, block=16, slots=32).collect()
    size = collections.Counter()
    for _, t, _, s in ROWS:
        size[s] += len(tokens(t))
    target = water(dict(size))
    source = collections.defaultdict(list)
    for i, t, _, s in ROWS:
        source[i, len(tokens(t))].append(s)
    took = collections.Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        s = next(x for x in source[r["doc_id"], r["size"]] if size[x] == r["source_size"])
        assert r["target"] == pytest.approx(target[s])
        took[s] += r["taken"]
    assert len(got) == len(ROWS)
    for s, t in target.items():
        assert abs(took[s] - t) <= 1
    same([tuple(r) for r in got], [tuple(r) for r in mixing.taken(docs.repartition(5), block=16, slots=32).collect()])
    assert mixing.taken(none).count() == 0
    blocks = mixing.mixed_blocks(docs, 16, 32).collect()
    assert all(len(b["text"].split(" ")) == b["n_words"] for b in blocks)
    assert sum(b["n_words"] for b in blocks) == sum(r["taken"] for r in got)
    per = collections.Counter(b["shard"] for b in blocks)
    assert max(per.values()) <= 32
    words = collections.Counter(w for b in blocks for w in b["text"].split(" "))
    assert set(words) <= {w for _, t, *_ in ROWS for w in re.split(r"[\x20\x09-\x0d]+", t or "")}


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10**9))
def test_permutation(spark, n, key):
    df = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("bigint").alias("n"), F.lit(key).cast("bigint").alias("key"))
    there = mixing.permuted(df, "y", "x", "n", "key")
    rows = mixing.permuted(there, "z", "y", "n", "key", back=True).collect()
    assert sorted(r["y"] for r in rows) == list(range(n)) and all(r["z"] == r["x"] for r in rows)


VOCABULARY = lattice.VOCABULARY


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_lattice(docs, none):
    d = lattice.folded(docs)
    model = lattice.train(d, head=20)
    got = lattice.scored(d, model).collect()
    count = collections.Counter()
    for i, t, *_ in ROWS:
        if fold(i) != 1:
            count.update([*tokens(t), b""])
    n, v = sum(count.values()), len(count)
    assert model.total == n
    want = [(i, fold(i) == 1, len(tokens(t)) + 1, sum(count[w] > 0 for w in [*tokens(t), b""])) for i, t, *_ in ROWS]
    same([(r["doc_id"], r["held"], r["n_tokens"], r["n_known"]) for r in got], want)
    base = sorted(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*tokens(t), b""]) for _, t, *_ in ROWS)
    assert sorted(r["base_score"] for r in got) == pytest.approx(base)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    wide = lattice.scored(d, lattice.train(d, head=10**6)).collect()
    assert sorted(r["score"] for r in wide) == pytest.approx(sorted(r["score"] for r in got))
    assert lattice.scored(lattice.folded(none), model).count() == 0
    empty = lattice.train(lattice.folded(none))
    assert all(math.isfinite(r["score"]) for r in lattice.scored(d, empty).collect())


def test_lattice_sums_all_segmentations():
    la = lattice.Lattice({b" a": 0.5, b"b": 0.3, b"ab": 0.1, b" ab": 0.2, b"ba": 0.2})
    p = dict(zip(la.pieces, np.exp(la.logs[0]), strict=False))
    end = np.exp(la.logs[0][-1])

    def brute(text, first=True):
        if not text:
            return end
        return sum(p[text[:k]] * brute(text[k:], False) for k in range(1, len(text) + 1) if text[:k] in p)

    words = [b"ab", b"abba", b"b", b"zzz", b"abab" * 3]
    assert np.exp(la.forward(words)[0]) == pytest.approx([brute(b" " + w) for w in words])


def test_quality(spark, docs, none):
    good = [(1000 + i, prose(i, 60), 1) for i in range(120)]
    bad = [(2000 + i, " ".join(w + "$$$" for w in prose(500 + i, 60).split()), 0) for i in range(40)]
    rows = spark.createDataFrame([(i, t, len(t)) for i, t, _ in good + bad], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(1000, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.train(rows, labels)
    truth = {i: q for i, _, q in good + bad}
    held = [r for r in quality.scored(rows, model).collect() if fold(r["doc_id"]) == 0]
    assert held and all((r["score"] >= 0.3) == truth[r["doc_id"]] for r in held)
    odd = quality.scored(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.scored(none, model).count() == 0
    untrained = quality.train(rows, labels.limit(0))
    assert {round(r["score"], 1) for r in quality.scored(rows.limit(3), untrained).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"y"}


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = (0.3, rng.standard_normal(quality.WIDTH), rng.standard_normal((quality.WIDTH, 3)))
    index, value = np.array([3, 9, 40]), np.array([0.5, 1.0, 2.0])
    z, _ = quality.forward(model, np.array([0, 3]), index, value)
    pairs = sum(model[2][index[a]] @ model[2][index[b]] * value[a] * value[b] for a in range(3) for b in range(a))
    assert z[0] == pytest.approx(0.3 + model[1][index] @ value + pairs)


def test_decontaminate(spark, docs, none):
    item = prose(900, 40)
    words = item.split()
    changed = [w if i % 6 else "xyzzy" for i, w in enumerate(words)]
    rows = [(1, "before " + item + " after"), (2, " ".join(changed)), (3, prose(901, 300)), (4, None), (5, " ".join(words[:9])), (6, item.upper().replace(" ", "\n"))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(d, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (6, 7)}
    assert got[1, 7]["doc_start"] == 1 and got[1, 7]["n_match"] == 40 and got[2, 7]["n_match"] == sum(a == b for a, b in zip(words, changed, strict=True)) - (changed[0] == "xyzzy") * 0
    assert {r["doc_id"] for r in decontaminate.clean(d, items).collect()} == {3, 4, 5}
    in_blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, items, block_bytes=50).collect()}
    assert in_blocks == set(got)
    assert decontaminate.overlaps(none, items).count() == 0 and decontaminate.overlaps(docs, items.limit(0)).count() == 0


def test_licenses(spark, docs, none):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, prose(1, 500) + "\nReleased under the MIT License.\n" + prose(2, 500)), (2, "Copyright someone\n" + mit.replace("without restriction", "with no restriction")), (3, prose(3, 100)), (4, None), (5, "Released under the MIT License. " * 3), (6, "the mit license")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 7)] == ["MIT-notice", "MIT", None, None, "MIT-notice", None]
    assert got[1]["coverage"] == 1.0 and got[1]["first_word"] == 500 and 0.9 < got[2]["coverage"] < 1
    assert licenses.scan_licenses(docs).count() == len(ROWS) and licenses.scan_licenses(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=25), st.lists(st.integers(0, 12), max_size=25))
def test_patience(a, b):
    x, y = [[str(v).encode() for v in s] for s in (a, b)]
    got = licenses.align(x, y)
    assert all(x[i] == y[j] for i, j in got)
    assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:], strict=False))
    if x == y:
        assert len(got) == len(x)


def test_token_rollup(spark, docs, none, tmp_path):
    counts = [(1, "s1", "en", "t@1", 10), (2, "s1", "en", "t@1", 5), (3, None, "fr", "t@1", 0)]
    schema = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint"
    rows = spark.createDataFrame(counts, schema)
    ledger = token_rollup.Ledger(spark, f"file://{tmp_path}/ledger")
    total = lambda: {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in ledger.totals().collect()}
    assert total() == {}
    assert ledger.commit("1", token_rollup.inserts(rows))
    assert total() == {("s1", "en", "t@1"): (2, 15), (None, "fr", "t@1"): (1, 0)}
    one = rows.filter("doc_id = 1")
    assert ledger.commit("2", token_rollup.inserts(one, -1)) and not ledger.commit("2", token_rollup.inserts(one, -1))
    assert total()["s1", "en", "t@1"] == (1, 5)
    two = rows.filter("doc_id = 2")
    ledger.commit("3", token_rollup.revisions(two, two.withColumn("tokens", F.lit(8).cast("bigint"))))
    assert total()["s1", "en", "t@1"] == (1, 8)
    (tmp_path / "ledger" / "batch=4").mkdir()  # cut off: no _SUCCESS
    assert ledger.batches() == ["1", "2", "3"] and ledger.commit("4", token_rollup.inserts(one))
    if os.path.exists(f"{token_rollup.TOKENIZERS}/{token_rollup.BPE}.tiktoken"):
        enc = token_rollup.load_bpe(f"{token_rollup.TOKENIZERS}/{token_rollup.BPE}.tiktoken")
        got = token_rollup.count_tokens(docs).collect()
        same([(r["doc_id"], r["words"], r["pieces"]) for r in got], [(i, len(tokens(t)), len(enc.encode_ordinary(t or ""))) for i, t, *_ in ROWS])
        assert token_rollup.count_tokens(none).count() == 0


@given(st.lists(st.text(alphabet="aAbB \t\né日", max_size=30), max_size=8))
def test_word_hashes(rows):
    h, at = hashing.word_hashes([t.encode() for t in rows])
    words = [w for t in rows for w in t.encode().lower().split()]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert np.diff(at).tolist() == [len(t.encode().split()) for t in rows]
