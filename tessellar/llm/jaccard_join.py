"""N-gram Jaccard join by universe partition and the pigeonhole principle, verified exactly.

Sets of hashed word shingles are put in size bands. In a band, the shingle universe is hashed into segments; two sets
above the threshold differ in at most H shingles, so with tolerances v (1: equal, 2: one shingle apart) that sum to
H + 1 some segment is within its tolerance. A segment's index key is a sum of its shingles' hashes; a key of the
one-deletion neighbourhood is that sum less one of them.

Small segments say little: any two sets share an empty one, and sets with a passage in common often one of a single
shingle. So tolerances sum to H + 1 + S, and of the segments that tolerate nothing each set leaves out the S smallest
(of equal sizes, those of least hash). Nothing is lost: of what two linked sets agree on, whatever either left out, the
set that went further up that order left out too, so it is S segments at most, and the others' tolerances still sum to
H + 1. A cost model allots the segments, those with a one-deletion neighbourhood, and S, for each band: keys that are
made, plus the partners met by chance among all sets and among those that share passages.

Keys that meet give candidates; a key's members are tied to its smallest one, so a key of g sets gives g - 1 pairs.
Candidates' connected components are verified exactly and in full, each in tasks of bounded size: components that are
larger are dealt into blocks, and each pair of blocks is one task, or by their keys, as two linked sets share one,
whichever takes fewer copies of the sets (beyond ``MANY`` blocks always by keys). The first suits many near copies of one
text, the second chains of chance meetings, which tie ever more sets together as documents grow in number and would be
copied once for each block. Keys of the same members count once, and small ones share tasks. In a task, a
prefix index over the rarest shingles finds pairs, and their true overlap decides. Sets that are equal are one class
throughout.

Shingles are 64-bit hashes, classes 128 bits and the size.

Results in the odd cases: null and empty texts have no shingles and are linked with nothing; shorter texts than the
shingle have one, of all their words; ties do not arise (a component's name is its smallest id); rows that repeat an
id are one document, and in one component; a null id is carried as a document that sorts before all others, its
component's name null; a text of any length is taken whole; an empty table gives an empty table; other columns are
never read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import NO_ID, columns, cut, discard, small_batches, texts, union_all, unused
from .hashing import mix, shingles, word_hashes

BAND = 1.3
#: Keys that a chance partner is worth: it draws two whole sets into verification.
WEIGHT = 20.0
#: Sets that the model takes to share a part of a set's shingles, and how large a part.
NEAR, PART = 10.0, 0.2
#: Shingles that one verifying task holds of either block.
BLOCK_SHINGLES = 2_000_000
#: Blocks of a component beyond which it is dealt by its keys, whatever the copies.
MANY = 64
#: Turns in which keys are brought together, each a part of their values: a turn's shuffle files go before the next.
TURNS = 4
SEEN = 500_000
#: Bits for each value of a filter that picks rows before a shuffle, and in all at most: 16 MB. A filter that is too full
#: lets more rows through; the join behind it decides.
BITS_EACH, MOST_BITS = 16, 1 << 27


def heavier(n: int, p: float, than: int) -> float:
    """The chance that of n things with chance p more than that come true; by the normal law where there are many."""
    if than < 0:
        return 1.0
    if n > 100:
        var = n * p * (1 - p)
        return 0.5 * math.erfc((than + 0.5 - n * p) / math.sqrt(2 * var)) if var else float(n * p > than)
    return max(0.0, 1 - sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(min(n, than) + 1)))


def chance(n: int, m: int, two: int, spare: int, sets: int) -> float:
    """Expected index keys that a set of n shingles has in common with sets that it isn't linked with."""
    none = (1 - 1 / m) ** n
    single = none + (n / m * (1 - 1 / m) ** (n - 1) if m > 1 else float(n == 1))
    plain = m - two
    out = sets * two * single**2
    if plain:
        out += sets * plain * (none * heavier(plain - 1, none, spare - 1)) ** 2
        # segments by size (Poisson), less the smallest: one of k shingles is shared with chance PART ** k
        left, p = spare / plain, math.exp(-n / m)
        for k in range(1, 30):
            gone = min(left, p)
            out += NEAR * plain * (p - gone) * PART ** (k - 1) * (k > 1)
            left, p = left - gone, p * n / m / k
    return out


class Plan:
    """Size bands, and each band's segments, neighbourhoods and spare segments, for similarity >= num / den among `sets`."""

    def __init__(self, num: int, den: int, sets: int = 1 << 20):
        self.num, self.den, self.sets = num, den, sets
        self.tops: list[int] = [1]
        while self.tops[-1] < 1 << 36:
            self.tops.append(max(self.tops[-1] + 1, int((self.tops[-1] + 1) * BAND)))
        self.allotted: dict[int, tuple[int, int, int]] = {}

    def least(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def allot(self, band: int) -> tuple[int, int, int]:
        """(segments, how many of them tolerate one difference, how many of the others are left out) of the least cost."""
        if band in self.allotted:
            return self.allotted[band]
        top, low = self.tops[band], self.tops[band - 1] + 1 if band else 1
        h = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        best = None
        for two in range(min(h // 2 + h % 2, 16) + 1):
            for spare in sorted({0, 1, 2, 3, 4, *(h * k // 50 for k in range(1, 26))}):
                m = h + 1 + spare - two
                if two > m or m < 1 or spare > m - two:
                    continue
                cost = m - spare + two * top / m
                if best is not None and cost >= best[0]:
                    continue
                cost += WEIGHT * chance(low, m, two, spare, self.sets)
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, m, two, spare)
        self.allotted[band] = best[1:]
        return best[1:]

    def bands(self, n: int) -> list[int]:
        """The band of a set's size, and lower ones that may hold a partner."""
        k = int(np.searchsorted(self.tops, n))
        out = [k]
        while k > 0 and self.tops[k - 1] >= self.least(n):
            k -= 1
            out.append(k)
        return out

    def keys(self, s: np.ndarray) -> np.ndarray:
        """All index keys of a set (sorted distinct 64-bit hashes)."""
        out = []
        weight = mix(s ^ np.uint64(0x5851F42D4C957F2D))
        for k in self.bands(len(s)):
            m, two, spare = self.allot(k)
            segment = ((mix(s + np.uint64(k + 1)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, segment, weight)
            salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 40))
            key = mix(total + salt)
            if spare:
                held = np.bincount(segment, minlength=m)[two:].astype(np.uint64)
                order = np.argsort((held << np.uint64(32)) | (key[two:] >> np.uint64(32)), kind="stable")
                out += [key[:two], key[two:][order[spare:]]]
            else:
                out.append(key)
            if two:
                near = segment < two
                at = segment[near]
                out.append(mix(total[at] - weight[near] + salt[at]))
        return np.unique(np.concatenate(out))


def linked(a: int, b: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


def sketches(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, n, c1, c2, keys) of every row; a task gives a class's keys once."""
    small_batches(docs.sparkSession)
    plan = Plan(num, den, docs.count())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set = set()
        for b in batches:
            if not b.num_rows:
                continue
            h, at = word_hashes(texts(b))
            n, c1, c2, lists = [], [], [], []
            for s in shingles(h, at, k):
                one, two = mix(s), mix(s ^ np.uint64(0x2545F4914F6CDD1D))
                name = (len(s), int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64)))
                n.append(name[0])
                c1.append(name[1])
                c2.append(name[2])
                lists.append(plan.keys(s) if len(s) and name not in seen else np.zeros(0, np.uint64))
                seen.add(name)
            if len(seen) > SEEN:
                seen.clear()
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).view(np.int64)))
            ids = b.column("doc_id").fill_null(NO_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), keys], names=["id", "n", "c1", "c2", "keys"])

    return cut(columns(docs, "doc_id", "text").mapInArrow(run, "id bigint, n bigint, c1 bigint, c2 bigint, keys array<bigint>"), "sketches")


def bit_filter(places: DataFrame, bits: int):
    """A broadcast bit array of the places (0 to bits - 1) in a frame's one column."""
    p = places.select((F.col(places.columns[0]) + 1).alias("p"))
    made = p.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits >> 3, np.uint8)
    for r in made.collect():  # MOST_BITS / 32768 rows at most
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part[: len(out)]
    return places.sparkSession.sparkContext.broadcast(out)


def in_filter(held: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (held[place >> 3] >> (place & 7)) & 1 == 1


def enough_bits(n: int) -> int:
    return min(MOST_BITS, 1 << max(15, (n * BITS_EACH).bit_length()))


def meetings(found: DataFrame) -> DataFrame:
    """(c1, key, low): classes whose keys meet, beside the key's smallest class; a table. Rows may repeat.

    A key's smallest class is found by an aggregation that combines before the shuffle, and most keys are of one class
    and go. A filter picks the rows of the others, and the join back is one that adaptive execution splits where a key
    is hot.
    """
    rows = found.select("c1", F.explode("keys").alias("key"))
    turns = []
    for i in range(TURNS):
        part = rows.filter(F.pmod(F.shiftright("key", 32), F.lit(TURNS)) == i).groupBy("key").agg(F.min("c1").alias("low"), F.max("c1").alias("high"))
        turns.append(cut(part.filter("low < high").select("key", "low"), "shared-keys"))
    shared = union_all(turns)
    bits = enough_bits(shared.count())
    held = bit_filter(shared.select(F.col("key").bitwiseAND(bits - 1)), bits)

    def pick(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists = b.column("keys")
            keys = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            some = in_filter(held.value, keys & (bits - 1))
            yield pa.record_batch([pa.array(np.repeat(b.column("c1").to_numpy(), size)[some]), pa.array(keys[some])], names=["c1", "key"])

    near = found.filter(F.size("keys") > 0).select("c1", "keys").mapInArrow(pick, "c1 bigint, key bigint")
    met = cut(near.join(shared, "key").select("c1", "key", "low"), "meetings")
    discard(*turns)
    return met


def candidate_groups(met: DataFrame) -> DataFrame:
    """(node, component) over c1: classes whose keys meet, directly or through others."""
    return components(met.filter("c1 <> low").select(F.col("c1").alias("a"), F.col("low").alias("b")))


def dealt(members: DataFrame, met: DataFrame, block_shingles: int = BLOCK_SHINGLES, many: int = MANY) -> DataFrame:
    """(kind, home, blocks, id, c2): the tasks that each set of members (id, n, c1, c2, component) goes to; those of a
    home are verified together, in all pairs of its blocks."""
    weight = members.groupBy("component").agg(F.sum("n").alias("total")).withColumn("blocks", F.ceil(F.col("total") / block_shingles))
    sized = members.join(weight, "component")
    whole = sized.select(F.lit("component").alias("kind"), F.col("component").alias("home"), "blocks", "id", "c2")
    if not weight.filter("blocks > 1").limit(1).count():
        return whole
    wide = sized.filter("blocks > 1")
    near = cut(met.select("c1", "key").distinct().join(wide, "c1"), "near")
    alike = near.groupBy("key", "component", "total", "blocks").agg(F.count("*").alias("members"), F.bit_xor("c1").alias("x"), F.bit_xor(F.xxhash64("c1", "c2")).alias("y"), F.sum("n").alias("shingles"))
    alike = alike.groupBy("component", "total", "blocks", "members", "x", "y", "shingles").agg(F.min("key").alias("key"))
    alike = cut(alike.filter("members > 1").withColumn("parts", F.ceil(F.col("shingles") / block_shingles)), "alike")
    cost = alike.groupBy("component", "total", "blocks").agg(F.sum(F.col("shingles") * F.col("parts")).alias("copies"))
    by_key = cost.filter((F.col("blocks") > many) | (F.col("copies") < F.col("total") * F.col("blocks"))).select("component")
    keyed = near.select("component", "key", "id", "c2").join(alike.select("key", "shingles", "parts"), "key").join(by_key, "component")
    small = alike.filter("parts = 1").join(by_key, "component").agg(F.sum("shingles")).first()[0] or 0
    bins = -(-2 * small // block_shingles) or 1
    shared = keyed.filter("parts = 1").select(F.lit("keys").alias("kind"), F.pmod(F.xxhash64("key"), F.lit(bins)).alias("home"), F.lit(1).cast("bigint").alias("blocks"), "id", "c2").distinct()
    alone = keyed.filter("parts > 1").select(F.lit("key").alias("kind"), F.col("key").alias("home"), F.col("parts").alias("blocks"), "id", "c2")
    rest = whole.join(by_key, whole["home"] == by_key["component"], "left_anti")
    return union_all([rest, shared, alone])


def verified_edges(ids: list[int], side: list[int] | None, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets, as many as connect what is linked. With side given, only pairs across the sides count."""
    sizes = np.array([len(s) for s in sets])
    if not len(sizes):
        return []
    token, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(inverse, minlength=len(token))
    rank = np.empty(len(token), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(token))
    shared = df[np.argsort(df, kind="stable")] > 1
    parts = np.split(rank[inverse], np.cumsum(sizes)[:-1])
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    postings: dict[int, list[int]] = {}
    marked = np.zeros(len(token), bool)
    out = []
    for x in np.lexsort((ids, sizes)).tolist():
        mine, n = np.sort(parts[x]), int(sizes[x])
        least = -(-num * n // den)
        prefix = mine[: n - least + 1]
        prefix = prefix[shared[prefix]].tolist()
        near: set[int] = set()
        for t in prefix:
            near.update(postings.get(t, ()))
        if near:
            marked[mine] = True
            for y in sorted(near, reverse=True):
                if sizes[y] < least or (side is not None and side[x] == side[y]) or find(x) == find(y):
                    continue
                if linked(n, int(sizes[y]), int(marked[parts[y]].sum()), num, den):
                    root[find(x)] = find(y)
                    out.append((ids[x], ids[y]))
            marked[mine] = False
        for t in prefix:
            postings.setdefault(t, []).append(x)
    return out


def links(docs: DataFrame, found: DataFrame, k: int, num: int, den: int, block_shingles: int = BLOCK_SHINGLES, many: int = MANY) -> DataFrame:
    """(a, b): links between the smallest ids of classes, enough to connect all that is linked."""
    met = meetings(found)
    groups = candidate_groups(met)
    # a class in a group ships its set once, from its smallest document
    reps = found.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("id"))
    members = cut(reps.join(groups, reps["c1"] == groups["node"]).select("id", "n", "c1", "c2", "component"), "members")
    blocks = dealt(members, met, block_shingles, many)
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id", "c2"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    # texts are not shuffled: a filter of fixed size picks the rows to hash again, and the join on ids decides
    size = enough_bits(members.count())
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    shared = bit_filter(members.select(place.alias("p")), size)
    d = columns(docs, "doc_id", "text").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).select("id", "text", place.cast("int").alias("place"))

    def shingled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = b.column("place").to_numpy()
            b = b.filter(pa.array(in_filter(shared.value, at)))
            if not b.num_rows:
                continue
            h, at = word_hashes(texts(b))
            sets = shingles(h, at, k)
            c2 = [int(mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(c2, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "c2", "s"])

    sets = d.mapInArrow(shingled, "id bigint, c2 bigint, s binary").dropDuplicates(["id", "c2"])
    full = blocks.join(sets, ["id", "c2"]).withColumn("other", other)
    full = full.select("kind", "home", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "s")

    def verify(t):
        import pyarrow as pa

        order = np.lexsort((t.column("id").to_numpy(), t.column("block").to_numpy()))
        t = t.take(pa.array(order))
        arrays = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("s")]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        got = verified_edges(t.column("id").to_pylist(), t.column("block").to_pylist() if i != j else None, arrays, num, den)
        a, b = zip(*got, strict=True) if got else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("kind", "home", "i", "j").applyInArrow(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, block_shingles: int = BLOCK_SHINGLES, many: int = MANY) -> DataFrame:
    """(id, doc_id, n_shingles, component_id), a row a document row."""
    found = sketches(docs, k, num, den)
    edges = links(docs, found, k, num, den, block_shingles, many)
    # copies: each row of a class is tied to the class's smallest id
    classes = found.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copies = found.filter("n > 0").join(classes.filter("last > rep"), ["c1", "c2", "n"]).filter("id > rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    named = components(edges.select("a", "b").unionByName(copies))
    out = found.select("id", "n").join(named, found["id"] == named["node"], "left")
    to_id = lambda c: F.when(c != NO_ID, c)
    return out.select("id", to_id(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), to_id(F.coalesce("component", "id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with only the smallest id of each component."""
    name, named = unused(docs, "gone"), near_duplicates(docs, k, num, den)
    rest = named.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(rest, docs["doc_id"].cast("bigint").eqNullSafe(rest[name]), "left_anti")


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
linked AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, reach) AS (SELECT x, y FROM linked UNION SELECT r.node, linked.y FROM r JOIN linked ON r.reach = linked.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(reach) AS low FROM r GROUP BY node) m ON m.node = d.doc_id
"""
