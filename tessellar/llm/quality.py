"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the number of features.
Labels are read for training rows only: at most ``MAX_TRAIN`` ids in hash order, a row each (the documented bound; of
rows that share an id the one of least text). The label, lang, source and doc_id never enter a score.

Results in the odd cases: a null text counts as empty and is scored by its structure; a null n_chars has a feature of
its own; labels that are null or not 0/1 are ignored, an id labelled both ways counts as 0; without any label every score is 0.5; rows that
repeat are each scored; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, remainder, small_batches, texts, unused
from .hashing import word_hashes

HASHED, FACTORS, EPOCHS, RATE, DECAY, SEED = 1 << 16, 8, 5, 0.08, 1e-5, 4
MAX_TRAIN = 8000
CUT = 0.3
BINS = 12
#: Features past the hashed words: a bin of each statistic.
STATS = ("upper", "digit", "blank", "line", "symbol", "wide", "tail", "word_length", "distinct", "most_common", "repeat", "log_words", "log_chars", "declared")
WIDTH = HASHED + len(STATS) * (BINS + 1)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-;:()")
_MARK = bytes(112 if 33 <= b < 127 and not chr(b).isalnum() else 32 if b in (9, 10, 11, 12, 13, 32) else 120 for b in range(256))


def _statistics(b: bytes, n_words: int, distinct: int, top: int, again: int, declared: int | None) -> list[float]:
    n = max(1, len(b))
    marked = b.translate(_MARK) + b" "
    share = lambda chars: (n - len(b.translate(None, chars))) / n if b else 0.0
    w = max(1, n_words)
    scale = lambda x: np.log2(1 + max(0, x)) / 16
    return [share(_UPPER), share(_DIGIT), share(b" "), min(1.0, 20 * share(b"\n")), min(1.0, 5 * share(_SYMBOL)), share(bytes(range(128, 256))), marked.count(b"p ") / w, min(1.0, n / w / 16), distinct / w, top / w, again / w, scale(n_words), scale(n), -1.0 if declared is None else scale(declared)]


def features(blobs: list[bytes], declared: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, index, value): each text's features, distinct and in order; every text has len(STATS) at least."""
    h, at = word_hashes(blobs)
    owner = np.repeat(np.arange(len(blobs), dtype=np.int64), np.diff(at))
    key, count = np.unique(owner * HASHED + (h % np.uint64(HASHED)).astype(np.int64), return_counts=True)
    doc, word = key // HASHED, key % HASHED
    first = np.searchsorted(doc, np.arange(len(blobs) + 1))
    tf = 1 + np.log(count)
    norm = np.sqrt(np.maximum(1e-9, np.bincount(doc, tf * tf, len(blobs))))
    again = np.zeros(len(h) + 1, np.int64)  # up to each word, how many repeat the one before
    again[2:] = np.cumsum(h[1:] == h[:-1])
    stats = []
    for i, b in enumerate(blobs):
        c = count[first[i] : first[i + 1]]
        stats.append(_statistics(b, int(at[i + 1] - at[i]), len(c), int(c.max()) if len(c) else 0, int(again[at[i + 1]] - again[min(at[i] + 1, at[i + 1])]), declared[i]))
    s = np.array(stats).reshape(len(blobs), len(STATS))
    bins = np.where(s < 0, BINS, np.minimum(BINS - 1, (np.clip(s, 0, 1) * BINS).astype(np.int64)))
    slot = HASHED + np.arange(len(STATS)) * (BINS + 1) + bins
    all_doc = np.concatenate([doc, np.repeat(np.arange(len(blobs)), len(STATS))])
    index = np.concatenate([word, slot.ravel()])
    value = np.concatenate([tf / norm[doc], np.full(slot.size, 0.5)])
    order = np.lexsort((index, all_doc))
    starts = np.concatenate(([0], np.cumsum(np.bincount(all_doc, minlength=len(blobs)))))
    return starts, index[order].astype(np.int32), value[order].astype(np.float32)


def forward(model: tuple, starts: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margin, sums): the sum-of-squares identity over each row's features."""
    w0, w, v = model
    at = starts[:-1]
    x = v[index] * value[:, None]
    sums = np.add.reduceat(x, at, axis=0)
    squares = np.add.reduceat(x * x, at, axis=0)
    return w0 + np.add.reduceat(w[index] * value, at) + 0.5 * (sums * sums - squares).sum(axis=1), sums


def fit(starts: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, batch: int = 128) -> tuple:
    """Adagrad on the logistic loss, rows in a seeded order."""
    rng = np.random.default_rng(SEED)
    w0, w, v = 0.0, np.zeros(WIDTH, np.float32), (rng.standard_normal((WIDTH, FACTORS)) * 0.02).astype(np.float32)
    if not len(label):
        return w0, w, v
    g0, gw, gv = 1e-6, np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, FACTORS), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            sizes = starts[rows + 1] - starts[rows]
            part = np.concatenate(([0], np.cumsum(sizes)))
            take = np.repeat(starts[rows] - part[:-1], sizes) + np.arange(part[-1])
            i, x = index[take], value[take]
            z, sums = forward((w0, w, v), part, i, x)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
            e = np.repeat(error, sizes).astype(np.float32)
            used, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, e * x, len(used)).astype(np.float32) + DECAY * w[used]
            dv = np.zeros((len(used), FACTORS), np.float32)
            np.add.at(dv, back, (e * x)[:, None] * (np.repeat(sums, sizes, axis=0) - v[i] * x[:, None]))
            dv += DECAY * v[used]
            d0 = float(error.sum())
            g0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            w0 -= RATE * d0 / g0**0.5
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * 0.3 * dv / np.sqrt(gv[used])
    return w0, w, v


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple:
    """A model from the labelled rows whose remainder is not 0."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_train)
    rows = columns(docs, "doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id")  # at most max_train ids
    # a row an id, combined before the shuffle: what reaches the driver is bounded however often an id repeats
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("least")).select("doc_id", "quality", "least.*")

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                starts, index, value = features(texts(b), b.column("n_chars").to_pylist())
                cut = lambda a: pa.array([a[p:q].tobytes() for p, q in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
                yield pa.record_batch([b.column("doc_id"), b.column("quality"), cut(index), cut(value)], names=["doc_id", "quality", "i", "x"])

    got = rows.mapInArrow(extract, "doc_id bigint, quality int, i binary, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["i"]), bytes(r["x"])))
    index = [np.frombuffer(r["i"], np.int32) for r in got]
    starts = np.concatenate(([0], np.cumsum([len(i) for i in index]))).astype(np.int64)
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return fit(starts, flat(index, np.int32), flat([np.frombuffer(r["x"], np.float32) for r in got], np.float32), np.array([r["quality"] for r in got], np.float32))


def scored(docs: DataFrame, model: tuple, name: str = "score") -> DataFrame:
    """docs with a column `name` added (and one of that name replaced): how likely label 1 is."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: WIDTH * (FACTORS + 1) numbers
    keep = [f for f in docs.schema.fields if f.name != name]
    spare = [c for c in ("text", "n_chars") if c not in docs.columns]
    full = docs.select(*[docs[f.name] for f in keep], *[F.lit(None).cast("string").alias(c) for c in spare])

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                declared = [None if x is None else int(x) for x in b.column("n_chars").to_pylist()]
                z, _ = forward(shared.value, *features(texts(b), declared))
                s = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [pa.array(s, pa.float64())], names=[f.name for f in keep] + [name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return full.mapInArrow(score, StructType([*keep, StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that the classifier does not reject, with their columns as they were."""
    name = unused(docs, "likely")
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= cut).drop(name)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
