"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that starts more than once go.

Which strings can repeat is narrowed first: of each window of LENGTH bytes, the anchor is the k-gram of least hash in
it (the leftmost of equals). Equal windows have equal anchors at equal offsets, so a window whose anchor's k-gram occurs
once in the corpus is unique, and only the anchors of k-grams that repeat go on. Neighbouring windows share an anchor;
the bytes they span are the anchor's stretch. Equal stretches (by the k-gram's hash and 128 bits of their own) travel
together: two of them at most are cut out of their texts, and go to the shard of their k-gram.

A shard's suffix array is built by Larsson-Sadakane refinement: ranks by 5 or 8 bytes, then doubled, where only groups
that are not yet single are sorted again, down to LENGTH bytes. Common prefixes of neighbours follow Kasai's rule: along
text positions whose neighbour moves along by one, the prefix shrinks by one, so only the first of such a run is
compared byte by byte. A window repeats if it shares LENGTH bytes with a neighbour: nothing else decides.

A k-gram with more stretches than a shard should hold is dealt to several; each pair of them is merged in a task, where
the windows of one are looked up among the other's sorted windows by binary search.

Results in the odd cases: null and empty texts, and texts under LENGTH bytes, stay whole (no spans); rows that repeat
are documents that repeat each other, also under one id or a null id (two 64-bit hashes of the text tell different rows
of one id apart); a null doc_id is carried; very long texts are scanned in parts of STEP bytes that overlap by a window;
an empty table gives an empty table; other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, columns, cut, discard, small_batches, texts
from .hashing import OF_BYTE, mix, powers

LENGTH, GRAM = 200, 40
#: Bytes of text that one task scans at once, and of stretches that a shard holds.
STEP, SHARD_BYTES = 1 << 19, 3 << 19
PLACE_BITS = 22


# ---- windows and anchors


def _segments(blobs: list[bytes], length: int, step: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, first byte, bytes) of about `step` bytes; longer texts are cut so that each window is in one."""
    group, held = [], 0
    for row, b in enumerate(blobs):
        for first in range(0, max(1, len(b) - length + 1), step):
            part = b[first : first + step + length - 1]
            if len(part) < length:
                continue
            group.append((row, first, part))
            held += len(part)
            if held >= step:
                yield group
                group, held = [], 0
    if group:
        yield group


def anchors(group: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(part, first window, last window, k-gram hash, two stretch hashes) of all anchors; windows are counted in their part."""
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    size = np.array([len(p) for _, _, p in group])
    begin = np.concatenate(([0], np.cumsum(size)))
    n, w = len(data), length - gram + 1
    up, down = powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(OF_BYTE[data] * up[:n], dtype=np.uint64, out=run[1:])
    grams = mix((run[gram:] - run[: n - gram + 1]) * down[: n - gram + 1])
    # a sliding minimum of (hash, place) over w k-grams, from minima that run forth and back in blocks of w
    place = np.arange(len(grams), dtype=np.uint64)
    key = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    square = padded.reshape(-1, w)
    forth = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(back[:windows], forth[w - 1 : w - 1 + windows])
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    part = np.repeat(np.arange(len(group)), size)[:windows]
    valid = np.arange(windows) + length <= begin[part + 1]
    ok = np.flatnonzero(valid)
    new = np.ones(len(ok), bool)
    new[1:] = (at[ok][1:] != at[ok][:-1]) | (part[ok][1:] != part[ok][:-1])
    first = ok[new]
    last = np.append(ok[np.flatnonzero(new)[1:] - 1], ok[-1:])
    owner = part[first]
    stretch = mix((run[last + length] - run[first]) * down[first] + (last - first).astype(np.uint64))
    whole, ends = data.tobytes(), last + length
    second = b"".join([hashlib.blake2b(whole[p:q], digest_size=8).digest() for p, q in zip(first.tolist(), ends.tolist(), strict=True)])
    return owner, first - begin[owner], last - begin[owner], grams[at[first]], stretch, np.frombuffer(second, np.uint64)


# ---- suffix arrays


def words_at(data: np.ndarray) -> np.ndarray:
    """At each position, the next 8 bytes as a number that sorts like them (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def placed(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of key, key in order). Keys of `width` bits that leave room for a place are sorted with it
    as one number, which is several times as fast as sorting places by key."""
    bits = max(1, len(key).bit_length())
    if width + bits > 64:
        by = np.argsort(key, kind="stable")
        return by, key[by]
    both = np.sort((key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)


def refine(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): `starts` sorted by the `length` bytes from each, and a number that equal ones share.

    Larsson-Sadakane: a rank is the place of a group's first member; groups of one are never sorted again.
    """
    n = len(data)
    depth = 5 if n < 1 << 24 and length >= 5 else min(8, length)
    order, ordered = placed(words_at(data) >> np.uint64(64 - 8 * depth), 8 * depth)
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + length, np.uint64)
    rank[n:] = 0
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, n))
    rank[order] = np.repeat(head, count).astype(np.uint64)
    active = order[np.repeat(count > 1, count)]
    bits = max(1, n.bit_length())
    while depth < length and len(active):
        jump = min(depth, length - depth)
        if depth + jump == length:
            use = np.zeros(n, bool)
            use[starts] = True
            active = active[use[active]]  # the last turn: strings of full length begin at starts only
            if not len(active):
                break
        by, key = placed((rank[active] << np.uint64(bits)) | rank[active + jump], 2 * bits)
        active = active[by]
        old = key >> np.uint64(bits)
        group = np.ones(len(key), bool)
        group[1:] = key[1:] != key[:-1]
        top = np.ones(len(key), bool)
        top[1:] = old[1:] != old[:-1]
        head, top = np.flatnonzero(group), np.flatnonzero(top)
        count = np.diff(np.append(head, len(key)))
        inside = head - top[np.searchsorted(top, head, "right") - 1]
        rank[active] = np.repeat(old[head] + inside.astype(np.uint64), count)
        active = active[np.repeat(count > 1, count)]
        depth += jump
    by, final = placed(rank[starts], bits)
    return starts[by], final.astype(np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, group: np.ndarray, cap: int) -> np.ndarray:
    """For each entry of the sorted starts, the bytes it shares with the one before (0 for a group's first, where
    they share less than the sorted length). Only entries whose neighbour does not move along are compared."""
    out = np.zeros(len(order), np.int64)
    same = np.flatnonzero(np.concatenate(([False], group[1:] == group[:-1])))
    if not len(same):
        return out
    text, neighbour = order[same], order[same - 1]
    by = np.argsort(text)
    text, neighbour = text[by], neighbour[by]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1] + 1) | (neighbour[1:] != neighbour[:-1] + 1)
    head = np.flatnonzero(new)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = words_at(padded)
    a, b = text[head], neighbour[head]
    room = len(data) - np.maximum(a, b)
    got = np.zeros(len(head), np.int64)
    # the first of a run is compared far enough to serve the whole run
    need = cap + np.diff(np.append(head, len(text)))
    todo = np.arange(len(head))
    while len(todo):
        p, q = a[todo] + got[todo], b[todo] + got[todo]
        x = word[np.minimum(p, len(data))] ^ word[np.minimum(q, len(data))]
        lead = np.full(len(todo), 8)
        for k in range(8):
            lead = np.where((lead == 8) & ((x >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0), k, lead)
        got[todo] += lead
        todo = todo[(lead == 8) & (got[todo] < need[todo]) & (got[todo] < room[todo])]
    got = np.minimum(got, room)
    along = np.arange(len(text)) - np.repeat(head, np.diff(np.append(head, len(text))))
    value = np.repeat(got, np.diff(np.append(head, len(text)))) - along
    out[same[by]] = value
    return out


class Shard:
    """Stretches laid end to end, and their windows in sorted order."""

    def __init__(self, stretches: list[bytes], length: int = LENGTH):
        self.length = length
        size = np.array([len(s) for s in stretches], np.int64)
        self.data = np.frombuffer(b"".join(stretches), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        windows = size - length + 1
        self.starts = np.repeat(self.begin[:-1] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
        self.order, self.group = refine(self.data, self.starts, length)

    def repeated(self) -> np.ndarray:
        """For each byte position, whether a window starts there that starts at another, too."""
        lcp = common_prefixes(self.data, self.order, self.group, self.length)
        after = np.append(lcp[1:], 0)
        out = np.zeros(len(self.data), bool)
        out[self.order[np.maximum(lcp, after) >= self.length]] = True
        return out

    def distinct(self) -> np.ndarray:
        first = np.ones(len(self.order), bool)
        first[1:] = self.group[1:] != self.group[:-1]
        return self.order[first]

    def found_in(self, other: Shard) -> np.ndarray:
        """For each byte position, whether a window starts there that the other shard has: by binary search of each
        distinct window among the other's."""
        mine, theirs = self.distinct(), other.distinct()
        a, b = words_at(self.data), words_at(other.data)
        low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs), np.int64)
        hit = np.zeros(len(mine), bool)
        while True:
            todo = np.flatnonzero((low < high) & ~hit)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) // 2
            side = self._compare(a, mine[todo], b, theirs[mid])
            hit[todo[side == 0]] = True
            low[todo[side > 0]] = mid[side > 0] + 1
            high[todo[side < 0]] = mid[side < 0]
        out = np.zeros(len(self.data), bool)
        where = np.searchsorted(np.unique(self.group), self.group)
        out[self.order[hit[where]]] = True
        return out

    def _compare(self, a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        side, open_ = np.zeros(len(p), np.int8), np.arange(len(p))
        for k in [*range(0, self.length - 7, 8), self.length - 8]:
            x, y = a[p[open_] + k], b[q[open_] + k]
            side[open_] = np.where(x > y, 1, np.where(x < y, -1, 0))
            open_ = open_[x == y]
        return side

    def runs(self, marked: np.ndarray) -> Iterator[list[int]]:
        """Of each stretch, the marked windows as first, last, first, last, ..."""
        edge = np.diff(np.concatenate(([False], marked, [False])).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        # a run may not pass from one stretch to the next: windows end LENGTH - 1 bytes before it
        own = np.searchsorted(self.begin, first, "right") - 1
        out: list[list[int]] = [[] for _ in range(len(self.begin) - 1)]
        for o, f, z in zip(own.tolist(), first.tolist(), last.tolist(), strict=True):
            out[o] += [f - int(self.begin[o]), z - int(self.begin[o])]
        return iter(out)


# ---- the distributed plan


ROW = ["id", "t1", "t2"]
CLASS = ["g", "x1", "x2"]


def scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, t1, t2, lo, hi, g, x1, x2): a row an anchor of every document, written."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            blobs, keys = texts(b), [b.column(c).to_numpy() for c in ROW]
            for group in _segments(blobs, length, STEP):
                row = np.array([r for r, _, _ in group])
                shift = np.array([f for _, f, _ in group])
                part, lo, hi, *hashes = anchors(group, length, gram)
                place = [(x + shift[part]).astype(np.int32) for x in (lo, hi)]
                yield pa.record_batch([pa.array(x) for x in (*[k[row[part]] for k in keys], *place, *[h.view(np.int64) for h in hashes])], names=[*ROW, "lo", "hi", *CLASS])

    return cut(docs.mapInArrow(run, "id bigint, t1 bigint, t2 bigint, lo int, hi int, g bigint, x1 bigint, x2 bigint"), "anchors")


def keyed(docs: DataFrame) -> DataFrame:
    """id (never null), t1 and t2 (hashes that tell rows of one id apart) and text."""
    d = columns(docs, "doc_id", "text")
    return d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")


def of_repeated_grams(found: DataFrame) -> DataFrame:
    """The anchors whose k-gram occurs more than once, written. Counts are combined before the shuffle, and the join's
    left side is one that adaptive execution splits where a k-gram is hot."""
    grams = cut(found.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "grams")
    out = cut(found.join(grams, "g", "left_semi"), "repeated")
    discard(found, grams)
    return out


def repeated_runs(docs: DataFrame, live: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(g, x1, x2, runs): of each class of equal stretches, the windows that repeat, counted in the stretch; written."""
    place = F.struct(*ROW, "lo", "hi")
    classes = live.groupBy(*CLASS).agg(F.count("*").alias("m"), F.min(place).alias("a"), F.max(place).alias("z"))
    size = F.col("a.hi") - F.col("a.lo") + length
    classes = cut(classes.withColumn("size", size * F.least("m", F.lit(2))), "classes")
    # a k-gram's shard, or for a heavy one its blocks: each pair of them is a task
    grams = classes.groupBy("g").agg(F.sum("size").alias("bytes"))
    # written, so that the join below is one that adaptive execution splits where a k-gram is hot
    heavy = cut(grams.filter(F.col("bytes") > shard_bytes).select("g", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("blocks")), "heavy")
    shards = max(1, -(-(classes.agg(F.sum("size")).first()[0] or 0) // shard_bytes))
    dealt = classes.join(heavy, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("x1", "x2"), F.col("blocks")).cast("int"))
    # a class of one sends its stretch, a larger one two of them, the second for its own block only
    both = F.when(F.col("m") > 1, F.array(F.struct("a", F.lit(False).alias("second")), F.struct(F.col("z").alias("a"), F.lit(True).alias("second")))).otherwise(F.array(F.struct("a", F.lit(False).alias("second"))))
    dealt = dealt.withColumn("p", F.explode(both)).select(*CLASS, "blocks", "block", "p.second", "p.a.*")
    # a document's stretches are cut out of its text at once, so texts are not repeated by the join
    per = dealt.groupBy(*ROW).agg(F.collect_list(F.struct(*CLASS, "blocks", "block", "second", "lo", "hi")).alias("w"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [*CLASS, "blocks", "block", "second", "s"]
        kinds = [*[pa.int64()] * 3, pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        last = None
        for b in batches:
            rows, held = [], 0
            keys = zip(*[b.column(c).to_pylist() for c in ROW], strict=True)
            for key, t, w in zip(keys, texts(b), b.column("w"), strict=True):
                if key == last:  # a row that repeats: its stretches are the same
                    continue
                last = key
                for v in w.as_py():
                    rows.append((*[v[c] for c in names[:-1]], t[v["lo"] : v["hi"] + length]))
                    held += v["hi"] - v["lo"] + length
                    if held > STEP:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    cutout = docs.join(per, ROW).select(*ROW, "text", "w").mapInArrow(read, "g bigint, x1 bigint, x2 bigint, blocks int, block int, second boolean, s binary")
    home = F.when(F.col("blocks") > 1, F.col("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(shards)))
    others = F.when(F.col("second"), F.array("block")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    cutout = cutout.withColumn("home", home).withColumn("other", F.explode(others))
    cutout = cutout.select((F.col("blocks") > 1).alias("heavy"), "home", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "second", *CLASS, "s")

    def decide(t):
        import pyarrow as pa

        block, i, j = t.column("block").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        name = [t.column(c).to_numpy() for c in CLASS]
        second = t.column("second").to_numpy(zero_copy_only=False)
        s = t.column("s").to_pylist()
        out: list[tuple] = []

        def tell(rows: list[int], shard: Shard, marked: np.ndarray) -> None:
            for r, runs in zip(rows, shard.runs(marked), strict=True):
                if runs and not second[r]:
                    out.append((*[c[r] for c in name], runs))

        if i == j:
            shard = Shard(s, length)
            tell(list(range(len(s))), shard, shard.repeated())
        else:
            sides = [np.flatnonzero(block == k).tolist() for k in (i, j)]
            if all(sides):
                one, two = (Shard([s[r] for r in rows], length) for rows in sides)
                tell(sides[0], one, one.found_in(two))
                tell(sides[1], two, two.found_in(one))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.list_(pa.int32()))], names=[*CLASS, "runs"])

    out = cut(cutout.groupBy("heavy", "home", "i", "j").applyInArrow(decide, "g bigint, x1 bigint, x2 bigint, runs array<int>"), "runs")
    discard(classes, heavy)
    return out


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of every row: spans are first, end, first, end, ... bytes."""
    small_batches(docs.sparkSession)
    d = keyed(docs)
    live = of_repeated_grams(scan(d, length, gram))
    runs = repeated_runs(d, live, length, shard_bytes)
    hit = live.join(runs, CLASS).select(*ROW, F.transform("runs", lambda r: r + F.col("lo")).alias("r"))
    # a set: rows that repeat say the same
    per = hit.groupBy(*ROW).agg(F.flatten(F.collect_set("r")).alias("r"))
    full = d.join(per, ROW, "left")

    def take(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for t, r in zip(texts(b), b.column("r"), strict=True):
                spans: list[int] = []
                if r.is_valid:
                    flat = r.values.to_numpy()
                    pairs = np.stack([flat[0::2], flat[1::2].astype(np.int64) + length], 1)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    new = np.ones(len(pairs), bool)
                    new[1:] = pairs[1:, 0] > reach[:-1]
                    head = np.flatnonzero(new)
                    ends = reach[np.append(head[1:], len(pairs)) - 1]
                    spans = np.stack([pairs[head, 0], ends], 1).ravel().tolist()
                kept = b"".join(t[p:q] for p, q in zip([0, *spans[1::2]], [*spans[0::2], len(t)], strict=True))
                out.append((len(t), len(t) - len(kept), len(spans) // 2, spans, kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    cleaned = full.select("id", "text", "r").mapInArrow(take, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<bigint>, kept binary")
    return cleaned.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op7_suffix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
h AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM (SELECT doc_id, x, unnest(generate_series(0, n - 200)) AS i FROM d WHERE n >= 200)),
m AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM m)),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM sp UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(n) FROM d LEFT JOIN sp ON sp.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT gaps.doc_id, string_agg(substr(x, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)), '' ORDER BY s) AS x FROM gaps JOIN d ON d.doc_id = gaps.doc_id GROUP BY gaps.doc_id),
c AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
