"""Token counts: rollups kept by signed deltas.

A batch holds inserts, deletes and revised counts. Each becomes signed rows (documents, tokens) per source, language
and tokenizer version: an insert adds, a delete subtracts what the document had, a revision subtracts the old count
and adds the new one. A batch is committed once: its deltas, summed, go to a folder named after the batch, which
counts when its _SUCCESS file is there; a second commit of the same batch does nothing, and a commit that was cut off
is written anew. Totals are the sum over all committed batches: batches aren't
compacted, and one writer commits at a time.

Results in the odd cases: null or empty texts count 0 tokens and 1 document; a null source or language is a group of
its own; rows that repeat an id each count; groups whose documents all went keep a row with zeros; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, cut, remainder, scratch, small_batches, texts

KEYS = ("source", "lang", "tokenizer")
TOKENIZERS = "/opt/tokenizers"
BPE = "byte_bpe_50k"
# fixed value: the pattern that the vocabulary's publishers split text with before merging
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_bpe(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, folder: str = TOKENIZERS, tokenizer: str = BPE) -> DataFrame:
    """(doc_id, source, lang, words, pieces) of every row. The vocabulary is read on each worker, from `folder`."""
    small_batches(docs.sparkSession)
    path = f"{folder}/{tokenizer}.tiktoken"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoding = load_bpe(path)
        for b in batches:
            if b.num_rows:
                blobs = texts(b)
                words = pa.array([len(x.split()) for x in blobs], pa.int64())
                pieces = pa.array([len(encoding.encode_ordinary(x.decode())) for x in blobs], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang")), words, pieces], names=["doc_id", "source", "lang", "words", "pieces"])

    return columns(docs, "doc_id", "source", "lang", "text").mapInArrow(run, "doc_id bigint, source string, lang string, words bigint, pieces bigint")


def inserts(counts: DataFrame, sign: int = 1) -> DataFrame:
    """Signed rows for counts: (source, lang, tokenizer, tokens) each with one document added (or taken)."""
    return counts.select(*KEYS, F.lit(sign).cast("bigint").alias("docs"), (F.col("tokens") * sign).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return inserts(old, -1).unionByName(inserts(new))


class Ledger:
    """A folder of committed batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, batch: str) -> str:
        return f"{self.folder}/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self._at(batch)}/_SUCCESS"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """False if the batch was there already: its deltas are not even computed."""
        if self.committed(batch):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.mode("overwrite").parquet(self._at(batch))
        return True

    def batches(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n.split("=", 1)[1] for n in names if n.startswith("batch=") and self.committed(n.split("=", 1)[1]))

    def totals(self) -> DataFrame:
        schema = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
        found = self.batches()
        rows = self.spark.read.schema(schema).parquet(*map(self._at, found)) if found else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def by_tokenizer(counts: DataFrame, versions: dict[str, str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(c).alias("tokens")) for v, c in versions.items()]))
    return counts.withColumn("t", each).select("doc_id", "source", "lang", "t.tokenizer", "t.tokens")


def op5_token_rollup(spark, sf_dir: str) -> DataFrame:
    """All documents inserted with two tokenizers; every fifth then deleted; a further fifth moved from the words of
    version 1 to those of version 2 (which counts the end of text too); one batch committed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    counts = cut(count_tokens(docs), "counts")
    fold = remainder(F.col("doc_id"), 5)
    rows = by_tokenizer(counts, {"words@1": "words", f"{BPE}@1": "pieces"})
    ledger = Ledger(spark, scratch(spark, "ledger"))
    ledger.commit("0001-insert", inserts(rows))
    ledger.commit("0002-delete", inserts(rows.filter(fold == 0), -1))
    ledger.commit("0002-delete", inserts(rows.filter(fold == 0), -1))
    old = rows.filter((fold == 1) & (F.col("tokenizer") == "words@1"))
    ledger.commit("0003-revise", revisions(old, old.withColumns({"tokenizer": F.lit("words@2"), "tokens": F.col("tokens") + 1})))
    return ledger.totals()
