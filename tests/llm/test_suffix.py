"""Suffix-array dedup in the cases where keys collide, and on long texts, against brute force."""

from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from tessellar.llm import suffix_dedup


def brute(texts: list[str], n: int = suffix_dedup.LENGTH) -> Counter:
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out: Counter = Counter()
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(len(d), sum(gone), spans, sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest())] += 1
    return out


def found(docs, **kw) -> Counter:
    got = suffix_dedup.dedup_bytes(docs, **kw).select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("k")).collect()
    return Counter(tuple(r) for r in got)


def test_rows_of_a_null_id_whose_short_hashes_collide(spark):
    """Two texts with one 32-bit hash and no id stay two documents, each with its own repeats."""
    made = spark.range(200_000).select(F.concat(*[F.sha2(F.concat(F.lit(k), "id").cast("string"), 256) for k in "abcde"]).alias("text"))
    pairs = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter(F.size("t") > 1).select(F.explode("t").alias("text")).collect()
    texts = [r["text"] for r in pairs]
    assert len(texts) > 1
    texts += ["x" + t[20:280] for t in texts]
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    assert found(rows) == brute(texts)


def test_rows_that_repeat_under_one_id(spark):
    text = "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(90))
    texts = [text, text, "ab" + text[10:], text[:150], ""]
    rows = spark.createDataFrame([(5, t) for t in texts], "doc_id bigint, text string")
    assert found(rows) == brute(texts)
    assert found(rows, shard_bytes=300) == brute(texts)


def test_long_texts_and_periodic_ones(spark):
    """A megabyte of one letter, and a text longer than a scanned part with one passage at both of its ends."""
    passage = "".join(f"{i * i * 31 % 9973:x} " for i in range(120))
    filler = "".join(f"{i * 2654435761 % 4294967296:08x}" for i in range(90_000))
    texts = ["a" * 1_000_000, passage + filler + passage, "short"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_bytes(rows).collect()}
    assert (got[0]["n_removed"], got[0]["n_spans"]) == (1_000_000, 1)
    assert (got[1]["n_removed"], got[1]["n_spans"], bytes(got[1]["kept"])) == (2 * len(passage), 2, filler.encode())
    assert got[2]["n_removed"] == 0


def test_other_columns_are_not_read(spark):
    rows = spark.createDataFrame([(1, "z" * 300, 1, 2, 3)], "doc_id bigint, text string, g int, t1 int, id int")
    assert found(rows) == brute(["z" * 300])
