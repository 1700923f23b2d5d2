"""Mixing sources to target weights [native]: blocks of words, multinomial shard counts, index permutations, a join.

Words of each source are laid end to end (documents in hash order) and packed into blocks of ``block`` words. Each
output shard draws a multinomial count of blocks per source; a source's draws, numbered through all shards, are mapped
through a pseudorandom permutation of its block indices (a new one for each pass over the source) and joined to the
blocks by index. A source stops exactly at its rounded target: surplus draws are void, missing ones are drawn in
closing shards, and its last block may be cut.

Results in the odd cases: null or empty texts have size 0 and are never taken, each of them keeps its row; a null source
is a source of its own, last in order; rows that repeat, also with one id or none, are separate documents; a very long
text is cut into blocks like any other; an empty table gives an empty table; columns other than doc_id, source and text
are never read, whatever their names.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, columns, cut, discard, words

BLOCK, SLOTS, SEED, ROUNDS = 128, 1024, 20, 16
#: Drawn blocks that a task makes.
DRAWS = 1 << 20
SHARE, CAP = 1.5, 2
WEIGHTS = (5, 2, 1)
PRIME = 2147483647


def mixed_bits(x: Column, a: Column, b: int) -> Column:
    """A pseudorandom number below PRIME, in whole-number arithmetic that any SQL engine repeats."""
    x, a = x.cast("bigint"), a.cast("bigint")
    y = (x % PRIME * 48271 + a % PRIME * 1103515245 + b) % PRIME
    return (y * 1664525 + 1013904223) % PRIME


def turns() -> list[tuple[int, int, int, int]]:
    made = random.Random(SEED)
    return [tuple(made.randrange(1 << 20, PRIME) for _ in range(4)) for _ in range(ROUNDS)]


def permuted(df: DataFrame, name: str, x: str, n: str, key: str, back: bool = False) -> DataFrame:
    """df with column `name`: swap-or-not shuffle of x in 0..n-1, a permutation for any n, without tables or rejection.

    Each turn swaps x with its mirror place or not, and undoes itself, so `back` runs the turns in reverse. A turn is
    a projection of its own: the chain stays one span of generated code.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, F.col(x).cast("bigint").alias("_x"))
    for a, b, c, d in reversed(turns()) if back else turns():
        k = (F.col(key) % PRIME * a + b) % PRIME * 2097143 % F.col(n)
        df = df.select(*keep, "_x", ((k - F.col("_x")) % F.col(n) + F.col(n)).alias("_m"))
        df = df.select(*keep, "_x", (F.col("_m") % F.col(n)).alias("_m"))
        bit = F.expr(f"((greatest(_x, _m) % {PRIME} * {c} + {key} % {PRIME} * 7919 + {d}) % {PRIME}) div 65536 % 2")
        df = df.select(*keep, F.when(bit == 1, F.col("_m")).otherwise(F.col("_x")).alias("_x"))
    return df.select(*keep, F.col("_x").alias(name))


def tie() -> Column:
    return F.xxhash64("text", "source")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): the words of each document; tie tells apart rows that share an id."""
    d = columns(docs, "doc_id", "source", "text")
    return d.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), tie().alias("tie"))


def targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """A row a source: number (by code point, null last), size, target, words to take and blocks.

    A target is min(cap * size, level * weight); the level is the one at which the targets add up. Sources stand in
    one window here: it sees one row a source, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    per = per.withColumn("number", F.row_number().over(order).cast("bigint") - 1).withColumn("weight", w.cast("bigint"))
    per = per.withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("most") / F.col("weight"), "number")
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    # the first source, in order of most / weight, that its level does not fill: it and all after it are open
    first = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("number"), F.col("level")))).over(everything)
    per = per.withColumn("first", first).withColumn("rank", F.struct(F.col("most") / F.col("weight"), F.col("number"), F.col("level")))
    shared = F.col("first")["level"] * F.col("weight")
    is_open = F.col("first").isNotNull() & ((F.col("rank")["col1"] > F.col("first")["col1"]) | ((F.col("rank")["col1"] == F.col("first")["col1"]) & (F.col("number") >= F.col("first")["number"])))
    per = per.withColumn("target", F.when(is_open, F.least(shared, F.col("most").cast("double"))).otherwise(F.col("most").cast("double")))
    return per.select("source", "number", "source_size", "target", F.least(F.floor(F.col("target") + 0.5), F.col("most")).cast("bigint").alias("quota"))


def laid_out(sizes: DataFrame, per: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a document: its first word's place in its source's run of words.

    Places are prefix sums in two levels, (source, bucket) and then inside a bucket, so no task holds a whole source.
    """
    # as many buckets as a bucket has stretches of 64 words: neither level's windows outgrow a task
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / 64))).cast("bigint")
    d = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).drop(per["source"])
    # a bucket holds neighbours in no order of ids; in whole-number arithmetic, for the SQL twin
    at = mixed_bits(F.abs(F.coalesce("doc_id", F.lit(0))), F.lit(SEED), 7)
    d = d.withColumn("at", at).withColumn("bucket", F.col("at") % n)
    sums = d.groupBy("number", "bucket").agg(F.sum("size").alias("held"))
    sums = sums.withColumn("base", F.coalesce(F.sum("held").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("number", "bucket").orderBy("at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(sums.select("number", "bucket", "base"), ["number", "bucket"])
    return d.withColumn("start", F.col("base") + F.col("inside")).drop("inside", "base", "at", "bucket")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents cut at block edges: block, offset of the piece in its block, first word in the document, words.
    A document without words keeps one row with a null block."""
    last = F.expr(f"(start + size - 1) div {block}")
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), last)).otherwise(F.array(F.lit(None).cast("bigint")))
    p = placed.withColumn("block", F.explode(blocks))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return p.withColumns({"offset": low - F.col("block") * block, "first": low - F.col("start"), "n": F.coalesce(high - low, F.lit(0))})


def drawn(per: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """A row a drawn block: (number, shard, slot, block, words to take of it)."""
    s = per.filter("quota > 0").withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    # draws that a source needs: whole passes, then blocks up to the rest (one more if the short last block is among them)
    s = s.withColumn("rest", F.col("quota") % F.col("source_size")).withColumn("passes", F.expr("quota div source_size"))
    s = s.withColumns({"tail": F.col("source_size") - (F.col("blocks") - 1) * block, "key": F.col("number") * 1000 + F.col("passes"), "final": F.col("blocks") - 1})
    # where the short block falls in the last pass: before the cut, it makes room for more words
    s = permuted(s, "short_at", "final", "blocks", "key", back=True)
    room = F.col("rest") + F.when(F.col("short_at") * block < F.col("rest"), block - F.col("tail")).otherwise(0)
    s = s.withColumn("room", room).withColumn("extra", F.when(F.col("rest") > 0, F.ceil(F.col("room") / block)).otherwise(0).cast("bigint"))
    s = s.withColumn("need", F.col("passes") * F.col("blocks") + F.col("extra"))
    all_rows = Window.partitionBy()
    s = s.withColumn("low", F.coalesce(F.sum("need").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("need").over(all_rows))
    s = s.withColumn("shards", F.expr(f"(all + {slots - 1}) div {slots}"))
    s = cut(s.select("number", "quota", "source_size", "blocks", "passes", "tail", "rest", "short_at", "need", "low", "all", "shards"), "sources")
    # multinomial counts: a shard's slots each fall on the source whose stretch of [0, all) holds a uniform draw;
    # both sides are dealt by the draw's interval of `slots` numbers, so this is an equi-join
    known = s.select("all", "shards").first()  # two numbers
    total, shards = (known["all"], known["shards"]) if known else (0, 0)
    slot = s.sparkSession.range(shards * slots).select(F.expr(f"id div {slots}").alias("shard"), (F.col("id") % slots).alias("slot"))
    u = F.floor(mixed_bits(F.col("slot"), F.col("shard"), SEED) * F.lit(1.0) / PRIME * total).cast("bigint")
    slot = slot.withColumn("u", u).withColumn("at", F.expr(f"u div {slots}"))
    stretch = s.select("number", "low", "need", F.explode(F.sequence(F.expr(f"low div {slots}"), F.expr(f"(low + need - 1) div {slots}"))).alias("at"))
    count = slot.join(stretch, "at").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.col("need")))
    count = cut(count.groupBy("number", "shard").agg(F.count("*").alias("c")), "shard-counts")
    # draws of a source before a shard: in two levels, so no task holds all shards of a source
    step = max(1, math.isqrt(shards))
    count = count.withColumn("band", F.expr(f"shard div {step}"))
    before = Window.partitionBy("number").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = count.groupBy("number", "band").agg(F.sum("c").alias("held")).withColumn("low", F.coalesce(F.sum("held").over(before), F.lit(0)))
    inner = Window.partitionBy("number", "band").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("inside", F.coalesce(F.sum("c").over(inner), F.lit(0))).join(bands.select("number", "band", "low"), ["number", "band"])
    count = cut(count.select("number", "shard", "c", (F.col("low") + F.col("inside")).alias("base")), "counts")
    in_shards = count.join(s, "number").filter("base < need").select("number", "shard", "base", F.least(F.col("c"), F.col("need") - F.col("base")).alias("c"))
    given = in_shards.groupBy("number").agg(F.sum("c").alias("got"))
    # closing shards: what the draws left over, in runs of at most `slots`
    left = s.join(given, "number", "left").select("number", "shards", "need", F.coalesce("got", F.lit(0)).alias("got")).filter("got < need")
    left = left.select("number", "need", F.col("shards"), F.explode(F.sequence(F.col("got"), F.col("need") - 1, F.lit(slots).cast("bigint"))).alias("base"))
    left = left.select("number", (F.col("shards") + F.expr(f"base div {slots}")).alias("shard"), "base", F.least(F.lit(slots).cast("bigint"), F.col("need") - F.col("base")).alias("c"))
    # dealt out before the explosion: a count is a few bytes and up to `slots` rows. The number of parts is set, or
    # adaptive execution would merge them by their few bytes
    parts = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // DRAWS))
    rank = in_shards.unionByName(left).repartition(parts, "number", "shard").withColumn("rank", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("c") - 1)))
    rank = rank.join(s.select("number", "blocks", "passes", "rest", "short_at", "tail"), "number")
    rank = rank.withColumn("pass", F.expr("rank div blocks")).withColumn("r", F.col("rank") % F.col("blocks"))
    rank = permuted(rank.withColumn("key", F.col("number") * 1000 + F.col("pass")), "block", "r", "blocks", "key")
    # written: a filter above must not be pushed, turn by turn, into the chain
    rank = cut(rank, "draws")
    before_r = F.col("r") * block - F.when(F.col("short_at") < F.col("r"), block - F.col("tail")).otherwise(0)
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(block).cast("bigint"))
    take = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - before_r)))
    return rank.select("number", "shard", "rank", "block", take.cast("bigint").alias("take"))


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their places, pieces of documents by block, drawn blocks)."""
    sizes = cut(sized(docs), "sizes")
    per = cut(targets(sizes), "targets")
    placed = cut(laid_out(sizes, per, block), "places")
    discard(sizes)
    return placed, pieces(placed, block), drawn(per, block, slots)


def taken(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: a row's place in its source tells it from all others."""
    placed, cuts, draws = mix(docs, block, slots)
    empty = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    cuts = cuts.filter("size > 0")
    draws = draws.withColumnRenamed("take", "words").withColumnRenamed("number", "of").withColumnRenamed("block", "at")
    joined = cuts.join(draws, (cuts["number"] == draws["of"]) & (cuts["block"] == draws["at"]), "left")
    got = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("n"), F.coalesce("words", F.lit(0)) - F.col("offset")))
    out = joined.groupBy("doc_id", "tie", "number", "start", "size", "source_size", "target").agg(F.sum(got).cast("bigint").alias("taken"))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    return out.select(*names).unionByName(empty.select(*names))


def mixed_blocks(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """The mix itself: (shard, rank, source, block, n_words, doc_ids, text), a row a drawn block; words joined by one blank.

    Texts pass through two shuffles: to their places, and as pieces to their blocks.
    """
    placed, _, draws = mix(docs, block, slots)
    key = Window.partitionBy("id", "tie")
    placed = placed.filter("size > 0").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("nth", F.row_number().over(key.orderBy("start")))
    d = columns(docs, "doc_id", "source", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), tie().alias("tie"), "text")
    # rows that repeat are equal, so any pairing of them with their places serves
    d = d.withColumn("nth", F.row_number().over(key.orderBy(F.lit(0))))
    full = placed.join(d, ["id", "tie", "nth"])
    # through a generator, or the words would be made anew inside the function below, once a piece
    full = full.select("number", "source", "doc_id", "start", "size", F.explode(F.array(words(F.col("text")))).alias("w"))
    low, high = f"greatest(start, b * {block})", f"least(start + size, (b + 1) * {block})"
    piece = f"struct(b as block, {low} - b * {block} as offset, array_join(slice(w, cast({low} - start + 1 as int), cast({high} - {low} as int)), ' ') as t)"
    part = full.select("number", "source", "doc_id", F.expr(f"inline(transform(sequence(start div {block}, (start + size - 1) div {block}), b -> {piece}))"))
    filled = part.groupBy("number", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "t"))).alias("p"))
    out = draws.filter("take > 0").join(filled, ["number", "block"])
    used = F.filter("p", lambda x: x["offset"] < F.col("take"))
    out = out.select("shard", "rank", "source", "block", F.col("take").alias("n_words"), F.transform(used, lambda x: x["doc_id"]).alias("doc_ids"), F.array_join(F.col("p")["t"], " ").alias("all"))
    return out.select("shard", "rank", "source", "block", "n_words", "doc_ids", F.expr("substring_index(all, ' ', cast(n_words as int))").alias("text"))


def op9_mix(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


def _turned(given: str, name: str, x: str, n: str, key: str, back: bool) -> tuple[list[str], str]:
    """SQL of permuted(): common table expressions, a turn each, and the last one's name."""
    out, last = [], given
    for i, (a, b, c, d) in enumerate(reversed(turns()) if back else turns()):
        now = f"{name}{i}"
        old = x if i == 0 else "px"
        rest = "*" if i == 0 else "* EXCLUDE (px)"
        mirror = f"(((({key} % {PRIME} * {a} + {b}) % {PRIME} * 2097143 % {n} - px) % {n} + {n}) % {n})"
        pick = f"CASE WHEN (greatest(px, pm) % {PRIME} * {c} + {key} % {PRIME} * 7919 + {d}) % {PRIME} // 65536 % 2 = 1 THEN pm ELSE px END"
        out.append(f"{now} AS (SELECT * EXCLUDE (px, pm), {pick} AS px FROM (SELECT *, {mirror} AS pm FROM (SELECT {rest}, {old} AS px FROM {last})))")
        last = now
    return out, last


def _bits(x: str, a: str, b: int) -> str:
    return f"((((CAST({x} AS BIGINT) % {PRIME} * 48271 + CAST({a} AS BIGINT) % {PRIME} * 1103515245 + {b}) % {PRIME}) * 1664525 + 1013904223) % {PRIME})"


def _sql(block: int = BLOCK) -> str:
    """What a document gives: all ranks up to its source's need are drawn in some shard, so shards are left out."""
    cap, weights = CAP, "[" + ", ".join(map(str, WEIGHTS)) + "]"
    before, back = _turned("s1", "bk", "blocks - 1", "blocks", "key", True)
    after, there = _turned("ranks", "fw", "r", "blocks", "key", False)
    w = r"[^\x20\x09-\x0D]+"
    return f"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{w}')) AS size FROM documents),
p0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
p1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM p0),
p2 AS (SELECT *, {weights}[number % {len(WEIGHTS)} + 1] AS weight, source_size * {cap} AS most, sum(source_size) OVER () * CAST({SHARE} AS DOUBLE) AS total FROM p1),
p3 AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM p2),
p4 AS (SELECT *, (total - CAST(coalesce(sum(most) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM p3),
lv AS (SELECT ratio AS r0, number AS n0, level AS l0 FROM p4 WHERE level * weight <= most ORDER BY ratio, number LIMIT 1),
p5 AS (SELECT source, number, source_size, most, CASE WHEN l0 IS NOT NULL AND (ratio > r0 OR (ratio = r0 AND number >= n0)) THEN least(l0 * weight, CAST(most AS DOUBLE)) ELSE CAST(most AS DOUBLE) END AS target FROM p4 LEFT JOIN lv ON true),
per AS (SELECT *, CAST(least(floor(target + 0.5), most) AS BIGINT) AS quota FROM p5),
s0 AS (SELECT *, (source_size + {block - 1}) // {block} AS blocks, quota % source_size AS rest, quota // source_size AS passes FROM per WHERE quota > 0),
s1 AS (SELECT *, source_size - (blocks - 1) * {block} AS tail, number * 1000 + passes AS key FROM s0),
{", ".join(before)},
s2 AS (SELECT * EXCLUDE (px, key), px AS short_at, rest + CASE WHEN px * {block} < rest THEN {block} - tail ELSE 0 END AS room FROM {back}),
s3 AS (SELECT *, passes * blocks + CASE WHEN rest > 0 THEN (room + {block - 1}) // {block} ELSE 0 END AS need FROM s2),
ranks AS (SELECT *, rank // blocks AS pass, rank % blocks AS r, number * 1000 + rank // blocks AS key FROM (SELECT *, unnest(generate_series(0, need - 1)) AS rank FROM s3)),
{", ".join(after)},
d0 AS (SELECT number, px AS block, CASE WHEN px = blocks - 1 THEN tail ELSE {block} END AS length, pass, passes, rest, r * {block} - CASE WHEN short_at < r THEN {block} - tail ELSE 0 END AS before_r FROM {there}),
draws AS (SELECT number, block, CASE WHEN pass < passes THEN length ELSE greatest(0, least(length, rest - before_r)) END AS take FROM d0),
a0 AS (SELECT z.doc_id, z.size, per.number, per.source_size, per.target, {_bits("abs(coalesce(z.doc_id, 0))", str(SEED), 7)} AS spot, CAST(greatest(1, ceil(sqrt(per.source_size / 64.0))) AS BIGINT) AS n FROM z JOIN per ON z.source IS NOT DISTINCT FROM per.source),
a1 AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY number ORDER BY spot % n, spot, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM a0),
a2 AS (SELECT *, unnest(CASE WHEN size > 0 THEN generate_series(start // {block}, (start + size - 1) // {block}) ELSE [NULL] END) AS block FROM a1),
a3 AS (SELECT *, greatest(start, block * {block}) - block * {block} AS off, least(start + size, (block + 1) * {block}) - greatest(start, block * {block}) AS n_piece FROM a2)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(sum(CASE WHEN size > 0 THEN greatest(0, least(n_piece, coalesce(take, 0) - off)) ELSE 0 END) AS BIGINT) AS taken
FROM a3 LEFT JOIN draws ON a3.number = draws.number AND a3.block = draws.block GROUP BY doc_id, size, source_size, target"""


OP9_SQL = _sql()
