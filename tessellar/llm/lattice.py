"""LM scoring by subword lattice likelihood.

The pieces of an existing vocabulary and their scores give each word a lattice of all its segmentations; the forward
recursion sums over them in log space, and the text's log probability is that of its words and one end. Of a piece's
weight, ``SCORED`` is what the vocabulary's scores say among the pieces of its length (a score that is a rank, as in a
vocabulary of merges, is read as a Zipf law); the rest, and the mass of each length, are learned from all distinct
training words by expectation maximisation, as texts may be of other words than the vocabulary's. With 1 the scores
alone decide within a length. Whole words seen in training are edges too, with their count less an absolute discount;
the discounted mass goes to the lattice.

The text is marginal over classes as well, one for each frequent language of the training rows and one for the rest;
the scored row's own language is not read:

    P(text)   = sum over k of share(k) * product over words and the end of P_k
    P_k(word) = (max(c_k - D_k, 0) + (D_k V_k + 1/2) Q_k(word)) / (N_k + 1/2),   P_k(end) = c_k(end) / (N_k + 1/2)
    Q_k(word) = BACK * c(word) / sum of c + (1 - BACK) * P_lattice,k(word)

P_lattice sums to 1 over all byte strings (single bytes are pieces, and an end of word is drawn), so P does too, up to
the pseudo-half of unseen ends.

Counts, discounts and expectations cover all training rows. Frequent words, ``HEAD`` at most, travel to the workers;
the others are joined in a shuffle. Texts are never shuffled.

Results in the odd cases: null and empty texts are one end; without training rows there is one class, of the lattice
alone; rows that repeat are each scored (and each trained on); a null doc_id counts as empty text for the fold, a null
lang belongs to the rest; a text of any length is taken whole, and a word of any length goes through the recursion,
whose memory grows with the word's length; an empty table gives an empty table; other columns are never read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, columns, cut, remainder, small_batches, texts
from .hashing import mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD = 100_000
CLASSES, BACK = 7, 0.2
PASSES, PRIOR = 3, 20.0
#: The part of a length's mass that goes by the vocabulary's scores.
SCORED = 0.5
FLUSH = 250_000
BITS = 22
STEP = 4096
#: Words that go through the recursions at once: batches come smaller than arrays pay off.
TOGETHER = 60_000
END = b""
_T = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> dict[bytes, float]:
    """Lower-case pieces of a vocabulary file as bytes (a blank first: starts a word), each with its score's weight."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    for i in range(p.get_piece_size()):
        if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i):
            continue
        s = p.id_to_piece(i).replace("▁", " ").encode()
        if b" " in s[1:] or s.lower() != s or s in (b"", b" "):
            continue
        out[s] = 1.0 / (10.0 - p.get_score(i)) if p.get_score(i) <= 0 else float(np.exp(p.get_score(i)))
    return out


class Lattice:
    """Pieces in a hash table; batches of words of one length go through the recursions together.

    Each class has an array of log weights, of three groups: pieces that start a word, that go on, and the end of a word.
    """

    def __init__(self, pieces: dict[bytes, float], classes: int = 1):
        pieces.setdefault(b" ", 1e-3)
        for b in range(256):
            pieces.setdefault(bytes([b]), 1e-7)
        self.pieces = sorted(pieces)
        self.longest = max(map(len, self.pieces))
        self.starts = np.array([p[:1] == b" " for p in self.pieces] + [False])
        # start pieces by length, then the others by length; the end of a word has length 0
        self.kind = np.array([len(p) + (0 if p[:1] == b" " else self.longest) for p in self.pieces] + [0])
        weight = np.array([pieces[p] for p in self.pieces] + [0.0])
        weight[-1] = 0.4 * weight[~self.starts].sum()
        self.prior = self.normal(weight)
        self.logs = [np.log(self.prior) for _ in range(classes)]
        keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int64)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self.keys >> np.uint64(64 - BITS)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = np.zeros(1, np.uint64)
        for b in piece:
            h = h * _B + _T[b]
        return int(mix(h + np.uint64(len(piece)))[0])

    def normal(self, weight: np.ndarray) -> np.ndarray:
        out = weight.copy()
        out[self.starts] /= out[self.starts].sum()
        out[~self.starts] /= out[~self.starts].sum()
        return out

    def reweigh(self, k: int, expected: np.ndarray) -> None:
        """Maximisation: SCORED of a length's mass goes by the scores, the rest by expected counts; the scores count as
        PRIOR more in all."""
        counted = expected + PRIOR * self.prior
        mass, own = np.bincount(self.kind, counted), np.bincount(self.kind, self.prior)
        self.logs[k] = np.log(self.normal(SCORED * self.prior * mass[self.kind] / own[self.kind] + (1 - SCORED) * counted))

    def _edges(self, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: (word, start, piece) of all pieces in the words, an array of (words, bytes)."""
        n, width = data.shape
        h = np.zeros((n, width), np.uint64)
        values = _T[data]
        out = []
        for size in range(1, min(self.longest, width) + 1):
            h = h[:, : width - size + 1] * _B + values[:, size - 1 :]
            full = mix(h + np.uint64(size))
            w, s = np.nonzero(self.bits[full >> np.uint64(64 - BITS)])
            k = full[w, s]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            ok = self.keys[at] == k
            out.append((w[ok], s[ok], self.ids[at[ok]]))
        return out

    def forward(self, words: list[bytes], classes: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's marginal probability, a row a class. With classes (rows of words by class, true
        or false) only those are filled, and the pieces' expected counts are added to `expected`, a row a class."""
        out = np.zeros((len(self.logs), len(words)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, all_rows in by_length.items():
            for rows in by_batches(iter(all_rows), max(1, STEP * 16 // (length + 1))):
                data = np.frombuffer(b"".join([b" " + words[i] for i in rows]), np.uint8).reshape(len(rows), length + 1)
                edges, at = self._edges(data), np.array(rows)
                for k in range(len(self.logs)):
                    if classes is None:
                        out[k, at] = self._sums(k, edges, len(rows), length + 1, np.ones(len(rows), bool), None)
                    elif classes[k, at].any():
                        out[k, at] = self._sums(k, edges, len(rows), length + 1, classes[k, at], expected)
        return out

    def _sums(self, k: int, edges: list, n: int, width: int, use: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
        log, place = self.logs[k], np.cumsum(use) - 1
        n = int(use.sum())
        lp, kept = [], []
        for size, (w, s, piece) in enumerate(edges, 1):
            if n < len(use):
                ok = use[w]
                w, s, piece = place[w[ok]], s[ok], piece[ok]
            m = np.full((n, width - size + 1), -np.inf)
            m[w, s] = log[piece]
            lp.append(m)
            kept.append((w, s, piece))
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for e in range(1, width + 1):
            alpha[:, e] = _log_sum([alpha[:, e - z] + lp[z - 1][:, e - z] for z in range(1, min(e, len(lp)) + 1)])
        out = np.zeros(len(use))
        out[use] = alpha[:, width] + log[-1]
        if expected is not None:
            beta = np.full((n, width + 1), -np.inf)
            beta[:, width] = 0
            for b in range(width - 1, -1, -1):
                beta[:, b] = _log_sum([beta[:, b + z] + lp[z - 1][:, b] for z in range(1, min(width - b, len(lp)) + 1)])
            for size, (w, s, piece) in enumerate(kept, 1):
                post = np.exp(alpha[w, s] + log[piece] + beta[w, s + size] - alpha[w, width])
                expected[k] += np.bincount(piece, post, expected.shape[1])
            expected[k, -1] += n
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    m = np.stack(terms)
    top = m.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(m - safe).sum(axis=0))


def together(batches: Iterator) -> Iterator:
    """Batches joined to tables of TOGETHER rows or a little more."""
    import pyarrow as pa

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(word, c0, c1, ...) of all distinct words: counts by class, of training rows only. The end is the empty word."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, other = [Counter() for _ in range(classes)], set()

        def flush():
            keys = list(set().union(other, *counts))
            yield pa.record_batch([pa.array(keys, pa.binary()), *[pa.array([c.get(w, 0) for w in keys], pa.int64()) for c in counts]], names=["word", *names])
            for c in (*counts, other):
                c.clear()

        for b in batches:
            for x, held, k in zip(texts(b), b.column("held").to_pylist(), b.column("k").to_pylist(), strict=True):
                if held:
                    other.update(x.lower().split())
                else:
                    counts[k].update(x.lower().split())
                    counts[k][END] += 1
            if sum(map(len, counts)) + len(other) > FLUSH:
                yield from flush()
        if other or any(counts):
            yield from flush()

    names = [f"c{k}" for k in range(classes)]
    rows = docs.select("text", "held", "k").mapInArrow(run, ", ".join(["word binary", *[f"{c} bigint" for c in names]]))
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


class Model:
    """The corpus totals, the classes' shares, and the table of all words with their log10 probabilities by class."""

    def __init__(self, table: DataFrame, lattice: Lattice, total: int, shares: list[float], ends: list[float], end_base: float, head: int):
        self.table, self.lattice, self.total, self.shares, self.ends, self.end_base, self.head = table, lattice, total, shares, ends, end_base, head


def classed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with a class k: its language's place among the CLASSES most frequent of training rows, or the rest's."""
    found = docs.filter("not held and lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    names = [r["lang"] for r in found.orderBy(F.col("n").desc(), "lang").limit(CLASSES).collect()]
    k = F.lit(len(names))
    for i, name in enumerate(names):
        k = F.when(F.col("lang") == name, i).otherwise(k)
    return docs.withColumn("k", k), len(names) + 1


def train(docs: DataFrame, vocabulary: str = VOCABULARY, head: int = HEAD) -> Model:
    spark = docs.sparkSession
    docs, classes = classed(docs)
    names = [f"c{k}" for k in range(classes)]
    counts = cut(word_counts(docs, classes), "word-counts")
    word, both = F.length("word") > 0, sum((F.col(c) for c in names), F.lit(0))
    wanted = [F.sum(both).alias("total"), F.count_if(both > 0).alias("distinct"), F.sum(F.when(~word, both)).alias("ends")]
    for c in names:
        wanted += [F.sum(c).alias(f"{c}_n"), F.count_if(word & (F.col(c) > 0)).alias(f"{c}_v"), F.count_if(word & (F.col(c) == 1)).alias(f"{c}_1"), F.count_if(word & (F.col(c) == 2)).alias(f"{c}_2"), F.sum(F.when(~word, F.col(c))).alias(f"{c}_e")]
    seen = {k: int(v or 0) for k, v in counts.agg(*wanted).first().asDict().items()}
    lattice = Lattice(load_pieces(vocabulary), classes)
    for _ in range(PASSES if seen["total"] > seen["ends"] else 0):
        shared = spark.sparkContext.broadcast(lattice)  # of the vocabulary's size

        def expect(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            model = shared.value
            expected = np.zeros((classes, len(model.prior)))
            for b in together(batches):
                use = np.array([b.column(c).to_numpy() > 0 for c in names])
                model.forward(b.column("word").to_pylist(), use, expected)
            k, some = np.nonzero(expected)
            if len(some):
                yield pa.record_batch([pa.array(k.astype(np.int64)), pa.array(some.astype(np.int64)), pa.array(expected[k, some])], names=["k", "piece", "x"])

        got = counts.filter(word & (both > 0)).mapInArrow(expect, "k bigint, piece bigint, x double").groupBy("k", "piece").agg(F.sum("x").alias("x")).toArrow()  # a row a piece and class
        expected = np.zeros((classes, len(lattice.prior)))
        expected[got.column("k").to_numpy(), got.column("piece").to_numpy()] = got.column("x").to_numpy()
        for k in range(classes):
            if seen[f"c{k}_v"]:
                lattice.reweigh(k, expected[k])
    n, v, ends = (np.array([seen[f"c{k}_{x}"] for k in range(classes)], float) for x in "nve")
    one, two = (np.array([seen[f"c{k}_{x}"] for k in range(classes)], float) for x in "12")
    discount = np.where((one > 0) & (two > 0), one / np.maximum(1, one + 2 * two), 0.5)
    escape, mass = discount * v + 0.5, np.where(n > 0, n + 0.5, 1.0)
    end = np.where(ends > 0, ends / mass, 0.5)
    shares = ends / ends.sum() if ends.sum() else np.ones(classes) / classes
    total, spoken = seen["total"], max(1, seen["total"] - seen["ends"])
    base = total + 0.5 * (seen["distinct"] + 1)
    back = BACK if total > seen["ends"] else 0.0
    shared = spark.sparkContext.broadcast(lattice)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in together(batches):
            keys = b.column("word").to_pylist()
            c = np.array([b.column(x).to_numpy().astype(float) for x in names])
            both = c.sum(axis=0)
            lattice = shared.value.forward(keys)
            known = np.maximum(c - discount[:, None], 0) + escape[:, None] * back * both / spoken
            # in logs where the lattice is all there is and its probability has no float
            lp = np.logaddexp(np.log(np.maximum(known, 1e-300)), np.log(escape * (1 - back))[:, None] + lattice)
            lp = np.where(known > 0, lp, np.log(escape * (1 - back))[:, None] + lattice)
            lp = (lp - np.log(mass)[:, None]) / np.log(10)
            yield pa.record_batch([b.column("word").chunk(0), pa.array(both.astype(np.int64)), pa.array(np.log10((both + 0.5) / base)), *map(pa.array, lp)], names=["word", "c", "base", *lps])

    lps = [f"lp{k}" for k in range(classes)]
    table = cut(counts.mapInArrow(score, ", ".join(["word binary", "c bigint", "base double", *[f"{x} double" for x in lps]])), "word-scores")
    end_base = float(np.log10((seen["ends"] + 0.5) / base))
    return Model(table.filter(word), lattice, total, shares.tolist(), np.log10(end).tolist(), end_base, head)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held, n_tokens, n_known, base_score, score) of every row of docs."""
    spark, classes = docs.sparkSession, len(model.shares)
    lps = [f"lp{k}" for k in range(classes)]
    # the frequent words are those above a step of the counts' logarithm, the lowest at which they are `head` at most
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = model.table.filter("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # 16 rows a doubling
    held, lowest = 0, 1 << 30
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["n"]
        if held > model.head:
            break
        lowest = r["step"]
    frequent = model.table.filter("c > 0").filter(step >= lowest).select("word", "base", *lps).toArrow()  # at most `head` words
    shared = spark.sparkContext.broadcast((frequent.column("word").to_pylist(), np.stack([frequent.column(c).to_numpy() for c in ("base", *lps)], 1)))
    fixed = np.array([model.end_base, *model.ends])
    end_known = int(model.total > 0)
    sums = ["base", *lps]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        head, values = shared.value
        get = dict(zip(head, range(len(head)), strict=True)).get
        for b in batches:
            if not b.num_rows:
                continue
            keys, mine = [], []
            n, known = [], []
            for r, x in enumerate(texts(b)):
                tokens = x.lower().split()
                at = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
                seen = at[at >= 0]
                tie = hashlib.blake2b(x, digest_size=8).digest()
                # the row's own entry: its key starts with a blank, which no word does
                rare = Counter([tokens[k] for k in np.flatnonzero(at < 0).tolist()])
                keys += [b" " + tie + r.to_bytes(4), *rare]
                mine += [(r, tie, values[seen].sum(axis=0) + fixed)] + [(r, tie, None)] * len(rare)
                n += [len(tokens) + 1, *rare.values()]
                known += [len(seen) + end_known] + [0] * len(rare)
            at = pa.array([m[0] for m in mine], pa.int64())
            own = [m[2] is not None for m in mine]
            zero = np.zeros(classes + 1)
            total = np.stack([zero if m[2] is None else m[2] for m in mine], 1)
            cols = [b.column("doc_id").take(at), b.column("held").take(at), pa.array([m[1] for m in mine], pa.binary()), pa.array(keys, pa.binary()), pa.array(np.array(own, np.int64)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), *map(pa.array, total)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held", "tie", "key", "rows", "n", "known", *[f"sum_{c}" for c in sums]])

    schema = "doc_id bigint, held boolean, tie binary, key binary, rows bigint, n bigint, known bigint, " + ", ".join(f"sum_{c} double" for c in sums)
    parts = docs.select("doc_id", "held", "text").mapInArrow(run, schema)
    j = parts.join(model.table, parts["key"] == model.table["word"], "left")
    rare = F.col("rows") == 0
    # rows that repeat fall in one group: it is divided by their number and given back as often
    per = j.groupBy("doc_id", "held", "tie").agg(
        F.sum("rows").alias("copies"),
        F.sum(F.when(~rare, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(rare, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("known"))).alias("n_known"),
        *[F.sum(F.when(rare, F.col("n") * F.col(c)).otherwise(F.col(f"sum_{c}"))).alias(f"sum_{c}") for c in sums],
    )
    each = lambda c: F.col(c) / F.col("copies")
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    live = [k for k, s in enumerate(model.shares) if s > 0]
    terms = [each(f"sum_lp{k}") + float(np.log10(model.shares[k])) for k in live]
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    marginal = top + F.log10(sum((F.pow(F.lit(10.0), t - top) for t in terms), F.lit(0.0)))
    return per.select("doc_id", "held", each("n_tokens").cast("bigint").alias("n_tokens"), each("n_known").cast("bigint").alias("n_known"), each("sum_base").alias("base_score"), marginal.alias("score"))


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, and whether the row is held out of training."""
    small_batches(docs.sparkSession)
    d = columns(docs, "doc_id", "lang", "text")
    return d.withColumn("held", remainder(F.col("doc_id"), 5) == 1)


def op1_lattice(spark, sf_dir: str) -> DataFrame:
    docs = folded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    model = train(docs)
    out = scored(docs, model)
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")
