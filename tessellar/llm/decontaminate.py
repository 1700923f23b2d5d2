"""Benchmark decontamination: spaced-seed hashes of test and training text, joined, then verified around each hit.

A seed is a fixed mask of word positions; words under its zeros are ignored, so a substituted word there does not hide
a copied passage. Every hit fixes a diagonal (document position less item position); on it the words are compared and
the best run, a match scoring 1 and a substitution -2, counts if it has at least ``min_match`` equal words. An item with
fewer words than that must be there whole and unchanged: its words' hash is looked up among the document's runs of that
many words.

Where a document and an item repeat the same words, their seeds meet at far more pairs of positions than there are
diagonals. Then no pair is formed: all diagonals are compared, in batches, and those without a seed left out, which
gives the same result. Diagonals are taken from the left and end at the first that holds the whole item, as none after
it can be better.

The benchmark is indexed in blocks of about ``BLOCK_BYTES`` of text; a block's index, some ten times that, is what
travels to the workers, and a larger benchmark takes more passes over the documents. Document texts are never shuffled.

Results in the odd cases: null and empty texts and items match nothing; of equally good runs of a document and an item
the one that begins first counts; a row for each document row and item, so rows that repeat (documents or items) are
each reported; a null doc_id or item_id is carried; a text of any length is searched whole; empty tables give an empty
result; other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches, texts, union_all, unused
from .hashing import runs, word_hashes

MASKS = ("110100110011", "1110010101", "11101101")
MIN_MATCH = 12
#: Words that an item must have for `clean` to drop a document over it: shorter ones turn up by chance.
TELLING = 8
#: Pairs of positions a seed hit may have for each diagonal before all diagonals are compared instead.
CROWDED = 8
#: Cells of the table that a batch of diagonals is compared in.
CELLS = 1 << 20
BLOCK_BYTES = 4 << 20
DROP = b".,;:!?\"'()[]{}*#_-"
FILTER_BITS = 22
OUT = "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint, n_match bigint"


def positions(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): the numbers first[i], first[i] + 1, ... of each i, count[i] of them."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def best_run(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, masks: list[tuple[int, ...]] | None = None) -> tuple | None:
    """(equal words, doc start, item start, words) of the best run on these ascending diagonals: most equal words, then
    the first. With masks, only diagonals count on which all words under one of the masks are equal somewhere."""
    n, m = len(doc), len(item)
    best, column = None, np.arange(m + 1)
    step = max(1, CELLS // (m + 1))
    for a in range(0, len(diagonals), step):
        d = diagonals[a : a + step, None]
        at = d + column[:m]
        inside = (at >= 0) & (at < n)
        same = inside & (doc[np.clip(at, 0, n - 1)] == item)
        total = np.zeros((len(d), m + 1), np.int32)
        np.cumsum(np.where(same, 1, np.where(inside, -2, 0)), axis=1, out=total[:, 1:])
        floor = np.minimum.accumulate(total, axis=1)
        end = np.argmax(total - floor, axis=1)
        row = np.arange(len(d))
        level = (total == floor[row, end][:, None]) & (column <= end[:, None])
        start = m - np.argmax(level[:, ::-1], axis=1)
        equal = np.zeros((len(d), m + 1), np.int32)
        np.cumsum(same, axis=1, out=equal[:, 1:])
        score = equal[row, end] - equal[row, start]
        if masks is not None:
            seeded = np.zeros(len(d), bool)
            for mask in masks:
                k = m - mask[-1]
                if k > 0:
                    seeded |= np.logical_and.reduce([same[:, i : i + k] for i in mask]).any(axis=1)
            score = np.where(seeded, score, 0)
        begin = d[:, 0] + start
        k = int(np.lexsort((begin, -score))[0])
        if score[k] and (best is None or (-score[k], begin[k]) < (-best[0], best[1])):
            best = (int(score[k]), int(begin[k]), int(start[k]), int(end[k] - start[k]))
        if best and best[0] == m:
            break
    return best


class Index:
    """Seeds of a block of items, sorted by hash and item, behind a bit filter; the items' words; short items' hashes."""

    def __init__(self, ids: list[int], blobs: list[bytes], min_match: int = MIN_MATCH):
        self.ids, self.min_match = ids, min_match
        self.h, self.at = word_hashes(blobs, DROP)
        self.masks = [positions(m) for m in MASKS]
        size = np.diff(self.at)
        owner = np.repeat(np.arange(len(ids)), size)
        self.seeds = []
        for mask in self.masks:
            r = runs(self.h, mask)
            place = np.arange(len(r))
            inside = np.flatnonzero((place + mask[-1] < self.at[1:][owner[: len(r)]]) & (size[owner[: len(r)]] >= min_match))
            place = inside[np.lexsort((inside, r[inside]))]
            keys, item = r[place], owner[place]
            new = np.ones(len(place), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])
            first = np.flatnonzero(new)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[keys >> np.uint64(64 - FILTER_BITS)] = True
            self.seeds.append((mask[-1] + 1, keys[first], item[first], first, np.diff(np.append(first, len(place))), place, bits))
        self.short = {}
        for n in np.unique(size[(size > 0) & (size < min_match)]).tolist():
            some = np.flatnonzero(size == n)
            r = runs(self.h, tuple(range(n)))[self.at[some]]
            order = np.argsort(r, kind="stable")
            self.short[n] = (r[order], some[order])

    def _words(self, item: int) -> np.ndarray:
        return self.h[self.at[item] : self.at[item + 1]]

    def found(self, h: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple]:
        """(row, item) -> (equal words, doc start, item start, words), for texts with words h that begin at `at`."""
        items, out = len(self.ids), {}
        pairs, met = [], []
        for mask, (span, keys, item, first, count, place, bits) in zip(self.masks, self.seeds, strict=True):
            r = runs(h, mask)
            p = np.flatnonzero(bits[r >> np.uint64(64 - FILTER_BITS)])
            row = np.searchsorted(at, p, "right") - 1
            ok = p + span <= at[row + 1]
            p, row = p[ok], row[ok]
            low = np.searchsorted(keys, r[p], "left")
            which, group = spread(low, np.searchsorted(keys, r[p], "right") - low)
            pairs.append((p[which], row[which], item[group], first[group], count[group], place))
            met.append((row[which] * items + item[group], count[group]))
        pair, back = np.unique(np.concatenate([m[0] for m in met]), return_inverse=True)
        total = np.bincount(back, np.concatenate([m[1] for m in met]), len(pair))
        size = np.diff(at)[pair // items] + np.diff(self.at)[pair % items]
        crowded = pair[total > CROWDED * size]
        shift, codes = 1 << 40, [np.zeros(0, np.int64)]
        for p, row, item, first, count, place in pairs:
            ok = ~np.isin(row * items + item, crowded)
            which, k = spread(first[ok], count[ok])
            diagonal = (p[ok] - at[row[ok]])[which] - (place[k] - self.at[item[ok]][which])
            pair_at = np.searchsorted(pair, (row * items + item)[ok][which])
            codes.append(np.unique(pair_at * shift + diagonal + (shift >> 1)))
        code = np.unique(np.concatenate(codes))
        pair_at, diagonal = code // shift, code % shift - (shift >> 1)
        edge = np.searchsorted(pair_at, np.arange(len(pair) + 1))
        hot = set(crowded.tolist())
        for k, both in enumerate(pair.tolist()):
            row, item = divmod(both, items)
            doc, words = h[at[row] : at[row + 1]], self._words(item)
            if both in hot:
                best = best_run(doc, words, np.arange(1 - len(words), len(doc)), self.masks)
            else:
                best = best_run(doc, words, diagonal[edge[k] : edge[k + 1]])
            if best and best[0] >= self.min_match:
                out[row, item] = best
        for n, (keys, item) in self.short.items():
            r = runs(h, tuple(range(n)))
            low = np.searchsorted(keys, r, "left")
            p = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == r) if len(r) else np.zeros(0, np.int64)
            row = np.searchsorted(at, p, "right") - 1
            ok = p + n <= at[row + 1]
            p, row = p[ok], row[ok]
            # the first place of each key in a row: the others are no better
            _, once = np.unique(np.stack([row, low[p]], 1), axis=0, return_index=True)
            for x in once.tolist():
                a = int(p[x])
                for i in item[low[a] : np.searchsorted(keys, r[a], "right")].tolist():
                    if np.array_equal(h[a : a + n], self._words(i)):
                        out[int(row[x]), i] = (n, a - int(at[row[x]]), 0, n)
        return out


def overlaps(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best verified overlap of each document row and item that have one."""
    spark = docs.sparkSession
    small_batches(spark)
    d = columns(docs, "doc_id", "text")
    known = items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"].cast("string").alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for k in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # a block of bounded size
        part.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        index = spark.sparkContext.broadcast(Index([r["item_id"] for r in part], [(r["text"] or "").encode() for r in part], min_match))

        def scan(batches: Iterator, index=index) -> Iterator:
            import pyarrow as pa

            x = index.value
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                h, at = word_hashes(texts(b), DROP)
                best = x.found(h, at) if len(h) and len(x.h) else {}
                rows = [(ids[r], x.ids[i], start, item_start, n, equal) for (r, i), (equal, start, item_start, n) in sorted(best.items())]
                if rows:
                    names = [c.split()[0] for c in OUT.split(", ")]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        found.append(d.mapInArrow(scan, OUT))
    return union_all(found)


def clean(docs: DataFrame, items: DataFrame, telling: int = TELLING) -> DataFrame:
    """docs without the rows whose id has a verified overlap of `telling` equal words or more."""
    name = unused(docs, "hit")
    hit = overlaps(docs, items).filter(F.col("n_match") >= telling).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, docs["doc_id"].cast("bigint").eqNullSafe(hit[name]), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
