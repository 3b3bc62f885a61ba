"""SimHash near-duplicates by the generalised pigeonhole.

A-Z are lower-cased in the whole text, words are `[^\\x20\\x09-\\x0D]+`, shingles are SHINGLE words joined by a
space, repeats included; a text of fewer words has one shingle, all of them. A fingerprint bit is 1 if it is set
in over half of the shingles' XXH64 (seed 42). Fingerprints at most DISTANCE bits apart are linked; a class is
what links connect.

Search works on distinct fingerprints. The 64 bits are divided into m partitions of bits that go together in a
bounded sample of fingerprints. If partition i gets t_i + 1 of DISTANCE + 1 units, then two fingerprints within
DISTANCE are within t_i in some partition; a partition with no unit (t = -1) is not searched. A dynamic program
gives out the units at the least estimated cost: candidates, from the sample and the number of fingerprints, and
rows to be dealt out. Each fingerprint is put under its bits in each partition searched and asks for those and
their variants within t_i; what meets is verified in the join itself, so that only true links leave it.

Classes come from the links by minimum labels with pointer jumping; every round is written to the shared folder.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any other. A null doc_id keeps
its row; it is never the smallest doc_id, and a class of null doc_ids alone has a null id. Repeated rows are
members like any other. An empty table gives an empty result.

The pipeline's stage keep_one has its own contract: five words, a Jaccard similarity of 0.8 or more. Texts so similar have
SimHashes about 10 bits apart, often 18; partitions with thresholds wide enough for that would make several per cent of all
pairs candidates. So its SimHash (of the set of five-word shingles) finds the centre of each group and excludes pairs over
APART bits, which two texts of similarity 0.8 exceed with a chance of 1 in 100,000; the groups are the texts that share a
band of minimum hashes (two of similarity 0.8 share none with a chance of 2 in a million), and similarity is computed from
the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, rows_to_batch, slices, stored

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of the sample from which the partitions are planned.
SAMPLE = 2048
#: A dealt row costs as much as so many candidates.
ROW_COST = 10
#: A fingerprint with over 1/HOT of the documents goes to them by broadcast; there are at most HOT of these.
HOT = 1000
LAST = (1 << 63) - 1
#: The pipeline's stage: words of a shingle, least similarity (Jaccard) of two texts, bands and hashes of each.
STAGE_SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 25, 4
#: Bits beyond which two SimHashes of sets of SMALL shingles or more exclude a similarity of SIMILAR.
APART, SMALL = 22, 64
#: Texts of a tile that are compared with those of another at once, about.
TILE = 256
PIECE, FOLD = 1 << 16, np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = words[at : min(at + PIECE, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if n > 1 or len(words) == shingle else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row (a hash of both), fp (the fingerprint as a signed 64-bit number)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches):
            yield rows_to_batch([(i, r, fingerprint(t, shingle)) for i, r, t in zip(cols["doc_id"], cols["row"], cols["text"], strict=True)], schema)

    return docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row")).mapInArrow(run, "doc_id long, row long, fp long")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


@dataclass(frozen=True)
class Part:
    """Bits of a partition that is searched, and the distance up to which it is."""

    bits: tuple[int, ...]
    within: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grouped(sample: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """64 bits in m groups, as even as can be; each grows by the bit that goes best with what it has."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).sum(axis=0))
    spread[spread == 0] = 1
    alike = np.abs(bits.T @ bits) / np.outer(spread, spread)
    left, groups = list(range(64)), []
    for k in range(m):
        size = (64 - sum(map(len, groups))) // (m - k)
        own = [max(left, key=lambda b: (alike[b, left].sum(), -b))]
        while len(own) < size:
            own.append(max((b for b in left if b not in own), key=lambda b: (alike[b, own].sum(), -b)))
        groups.append(tuple(sorted(own)))
        left = [b for b in left if b not in own]
    return groups


def ball(bits: int, within: int) -> int:
    return sum(comb(bits, k) for k in range(within + 1))


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[Part]:
    """Partitions and thresholds of least estimated cost for n distinct fingerprints like those of the sample."""
    best: tuple[float, list[Part]] = (float("inf"), [])
    for m in range(1, distance + 2):
        groups, cost = grouped(sample, m), []
        for bits in groups:
            part = sample & np.uint64(sum(1 << b for b in bits))
            apart = np.bincount(np.concatenate([np.bitwise_count(part[i] ^ part[i + 1 :]) for i in range(len(part))]), minlength=65) if len(part) > 1 else np.zeros(65)
            near = np.cumsum(apart) / max(1, apart.sum())
            cost.append([0.0] + [n * n / 2 * max(near[t], ball(len(bits), t) / 2.0 ** len(bits)) + ROW_COST * n * (1 + (1 + len(bits) / 2 if t == 1 else ball(len(bits), t))) for t in range(distance + 1)])
        #: table[u]: least cost of u units in the partitions so far, and the units of each.
        table: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(float("inf"), ())] * (distance + 1)
        for own in cost:
            table = [min((table[u - k][0] + own[k], (*table[u - k][1], k)) for k in range(u + 1)) for u in range(distance + 2)]
        total, units = table[-1]
        if total < best[0]:
            best = total, [Part(bits, k - 1) for bits, k in zip(groups, units, strict=True) if k]
    return best[1]


def _asked(part: Part) -> Column:
    """Keys under which a fingerprint looks in a partition. At distance 1 one of two has a 0 where the other has a 1: that one asks."""
    own = F.col("fp").bitwiseAND(F.lit(part.mask))
    if part.within == 1:
        unset = F.filter(F.array(*[F.lit(signed(1 << b)) for b in part.bits]), lambda x: own.bitwiseAND(x) == 0)
        return F.concat(F.array(own), F.transform(unset, lambda x: own.bitwiseOR(x)))
    flips = [sum(1 << b for b in c) for k in range(part.within + 1) for c in combinations(part.bits, k)]
    return F.transform(F.array(*[F.lit(signed(x)) for x in flips]), lambda x: own.bitwiseXOR(x)) if len(flips) > 1 else F.array(own)


def links(distinct: DataFrame, parts: list[Part], distance: int = DISTANCE) -> DataFrame:
    """distinct (fp) -> a, b: each pair within the distance, both ways round at least once in sum."""
    def under(number: int, keys: Column) -> Column:
        return F.transform(keys, lambda x: F.struct(F.lit(number).alias("part"), x.alias("key")))

    listed = lambda keys: F.explode(F.concat(*[under(i, k) for i, k in enumerate(keys)]))
    held = distinct.select(F.col("fp").alias("b"), listed([F.array(F.col("fp").bitwiseAND(F.lit(p.mask))) for p in parts]).alias("at")).select("b", F.col("at.part").alias("part"), F.col("at.key").alias("key"))
    asked = distinct.select(F.col("fp").alias("a"), listed([_asked(p) for p in parts]).alias("at")).select("a", F.col("at.part").alias("part2"), F.col("at.key").alias("key2"))
    near = (F.col("part") == F.col("part2")) & (F.col("key") == F.col("key2")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return asked.join(held, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes (fp, first: smallest doc_id), pairs (a, b) -> fp, root struct<first,fp> for the nodes that have a link."""
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    linked = nodes.join(both.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi")
    labels = stored(linked.select("fp", F.struct("first", "fp").alias("root")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("told"))
        lower = labels.join(told, "fp", "left").select("fp", F.col("root").alias("was"), F.least("root", F.coalesce("told", "root")).alias("root"))
        lower = stored(lower, "lower")
        jump = lower.select(F.col("fp").alias("over"), F.col("root").alias("beyond"))
        labels = stored(lower.join(jump, F.col("root.fp") == F.col("over"), "left").select("fp", "was", F.least("root", F.coalesce("beyond", "root")).alias("root")), "labels")
        if labels.where(F.col("was") != F.col("root")).isEmpty():
            return labels.select("fp", "root")
        labels = labels.select("fp", "root")


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (doc_id, row, fp) -> fp, n, own (smallest struct<first,row>), root struct<first,fp>: a row for each distinct fingerprint."""
    first = F.coalesce("doc_id", F.lit(LAST))
    nodes = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(first.alias("first"), "row")).alias("own")), "nodes")
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    nodes_first = nodes.select("fp", F.col("own.first").alias("first"))
    if n < 2:
        return nodes.withColumn("root", F.struct(F.col("own.first").alias("first"), "fp"))
    found = components(nodes_first, links(nodes.select("fp"), plan(sample, n, distance), distance))
    return nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", F.struct(F.col("own.first").alias("first"), "fp")))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id: the smallest doc_id of the class."""
    prints = stored(fingerprints(docs, shingle), "prints")
    known = stored(classes(prints, distance).select("fp", "n", F.nullif(F.col("root.first"), F.lit(LAST)).alias("component_id")), "classes")
    # at most HOT fingerprints have more than 1/HOT of the rows each: these are broadcast, no other key is large
    many = prints.count() // HOT
    hot = F.broadcast(known.where(F.col("n") > many).drop("n"))
    cold = prints.join(hot.select("fp"), "fp", "left_anti").join(known.where(F.col("n") <= many).drop("n"), "fp")
    return prints.join(hot, "fp").unionByName(cold).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles of STAGE_SHINGLE words, in order; one of all words if there are fewer. A
    shingle's hash is folded from its words' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(STAGE_SHINGLE, len(words))
    many = len(words) - size + 1
    grams = np.full(many, size, np.uint64)
    for k in range(size):
        grams = (grams ^ own[k : k + many]) * FOLD
        grams ^= grams >> np.uint64(29)
    return np.unique(grams)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    times, plus = (rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    return (times | np.uint64(1))[:, None], plus[:, None]


TIMES, PLUS = _factors()


def bands(own: np.ndarray) -> list[int]:
    """BANDS keys, each of ROWS least hashes of the shingles. Sets of similarity s agree in one with 1 - (1 - s^ROWS)^BANDS."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, ((own[None, at : at + 4096] ^ PLUS) * TIMES >> np.uint64(16)).min(axis=1))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def bits_of(own: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), PIECE):
        ones += np.unpackbits(own[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _signed_up(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row, fp (a hash of the set of shingles), bits (its SimHash), n (its size), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64()), ("bits", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches):
            sets = map(shingles, cols["text"])
            yield rows_to_batch([(i, r, xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63), bits_of(own), len(own), bands(own)) for i, r, own in zip(cols["doc_id"], cols["row"], sets, strict=True)], schema)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id long, row long, fp long, bits long, n int, bands array<long>")


def _may_be(n: Column, m: Column, bits: Column, other: Column) -> Column:
    """Whether two sets can be similar: by their sizes, which is exact, and by their SimHash unless they are small."""
    sizes = F.least(n, m) >= SIMILAR * F.greatest(n, m)
    return sizes & ((F.least(n, m) < SMALL) | (F.bit_count(bits.bitwiseXOR(other)) <= APART))


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """pairs (a, b), texts (fp, text) -> those pairs whose shingles are similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for cols in slices(batches):
            rows = []
            for a, b, x, y in zip(cols["a"], cols["b"], cols["x"], cols["y"], strict=True):
                if last[0] != b:
                    last = b, shingles(y)
                if similar(shingles(x), last[1]):
                    rows.append((a, b))
            yield rows_to_batch(rows, schema)

    side = lambda k, t: texts.select(F.col("fp").alias(k), F.col("text").alias(t))
    return stored(pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), name)


def _centres(met: DataFrame) -> DataFrame:
    """met (bucket, fp, bits, n) -> bucket, head: of each bucket the member nearest to the majority of its members' bits.
    Copies differ from their original and from each other; the original is in the middle, so nearly all meet it."""
    one = lambda k: F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1)))
    sums = met.groupBy("bucket").agg(F.count("*").alias("members"), *[one(k).alias(f"b{k}") for k in range(64)])
    middle = F.lit(0).cast("long")
    for k in range(64):
        middle = middle.bitwiseOR(F.when(2 * F.col(f"b{k}") > F.col("members"), F.lit(signed(1 << k))).otherwise(F.lit(0)))
    centres = sums.where(F.col("members") > 1).select("bucket", middle.alias("middle"))
    far = F.bit_count(F.col("bits").bitwiseXOR(F.col("middle")))
    return met.join(centres, "bucket").groupBy("bucket").agg(F.min(F.struct(far.alias("far"), "fp", "bits", "n")).alias("head"))


def _sets(texts: DataFrame) -> DataFrame:
    """texts (fp, text) -> fp, grams: the hashes of a text's shingles."""
    schema = pa.schema([("fp", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches):
            yield rows_to_batch([(fp, shingles(text).view(np.int64)) for fp, text in zip(cols["fp"], cols["text"], strict=True)], schema)

    return stored(texts.mapInArrow(run, "fp long, grams array<long>"), "grams")


def _open(sets: DataFrame) -> DataFrame:
    """sets (fp, grams) -> those of which SIMILAR of the shingles occur in some other. A shingle that no other text has is
    in no intersection, so the rest are similar to none. Shingles are counted, never paired."""
    grams = sets.select("fp", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("texts")).where(F.col("texts") > 1).select("gram")
    common = grams.join(shared, "gram").groupBy("fp").agg(F.count("*").alias("common"))
    return sets.join(common, "fp").where(F.col("common") >= SIMILAR * F.size("grams")).select("fp", "grams")


def similar_pairs(own: list[dict], others: list[dict]) -> Iterator[tuple[int, int]]:
    """Members (fp, root, out, grams) of two tiles -> pairs of similar ones of different classes, one of them outside its centre's."""
    sizes = np.array([len(o["grams"]) for o in others])
    grams, owner = np.concatenate([np.array(o["grams"], np.int64) for o in others]), np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    roots, outs = np.array([o["root"] for o in others]), np.array([o["out"] for o in others])
    for a in own:
        mine = np.array(a["grams"], np.int64)
        left = np.searchsorted(grams, mine)
        many = np.searchsorted(grams, mine, "right") - left
        both = np.bincount(owner[np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=len(others))
        for k in np.flatnonzero((both >= SIMILAR * (len(mine) + sizes - both)) & (roots != a["root"]) & (outs | a["out"])):
            yield a["fp"], others[k]["fp"]


def _compared(members: DataFrame) -> DataFrame:
    """members (centre, fp, root, out, grams) -> a, b: similar pairs, by tiles of about TILE members of a centre."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    counts = members.groupBy("centre").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.max("out").alias("any")).where("any").drop("any")
    dealt = members.join(counts, "centre").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
    tiles = stored(dealt.groupBy("centre", "tile").agg(F.collect_list(F.struct("fp", "root", "out", "grams")).alias("own"), F.max("out").alias("any")), "tiles")
    one, two = (tiles.select("centre", F.col("tile").alias(f"{k}_tile"), F.col("own").alias(k), F.col("any").alias(f"{k}_any")) for k in "xy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                yield rows_to_batch(sorted({(min(p), max(p)) for p in similar_pairs(row["x"], row["y"])}), schema)

    pairs = one.join(two, "centre").where((F.col("x_tile") <= F.col("y_tile")) & (F.col("x_any") | F.col("y_any")))
    return stored(pairs.select("x", "y").mapInArrow(run, "a long, b long"), "more")


def similar_classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> fp, own (smallest struct<first,doc_id,row>), root: a row for each distinct set of shingles.

    In each band's bucket all are compared with its centre; then those outside the centre's class with all that have the
    same centre and are not in their class, tile by tile, so that every two texts that share a bucket are joined, compared,
    or excluded by sizes, SimHash or shingles that no other has.
    """
    prints = stored(_signed_up(docs), "prints")
    first = F.coalesce("doc_id", F.lit(LAST))
    nodes = stored(prints.groupBy("fp").agg(F.min(F.struct(first.alias("first"), "doc_id", "row")).alias("own"), *[F.first(c).alias(c) for c in ("bits", "n", "bands")]), "nodes")
    every = nodes.select("fp", "bits", "n", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > 1).select("bucket")
    met = stored(every.join(shared, "bucket"), "shared")
    met = stored(met.join(_centres(met), "bucket"), "met")
    named = nodes.join(met.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("own.doc_id").alias("doc_id"), F.col("own.row").alias("row"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    texts = stored(keyed.join(named, same_row(keyed, named)).select("fp", "text").dropDuplicates(["fp"]), "texts")
    simple = nodes.select("fp", F.col("own.first").alias("first"))
    told = met.where((F.col("fp") != F.col("head.fp")) & _may_be(F.col("n"), F.col("head.n"), F.col("bits"), F.col("head.bits")))
    pairs = _verified(told.select(F.col("fp").alias("a"), F.col("head.fp").alias("b")), texts, "pairs")
    roots = components(simple, pairs)
    root_of = lambda name, key: roots.select(F.col("fp").alias(key), F.col("root.fp").alias(name))
    placed = met.withColumn("centre", F.col("head.fp")).join(root_of("root", "fp"), "fp", "left").join(root_of("head_root", "centre"), "centre", "left")
    placed = stored(placed.select("bucket", "fp", "centre", F.coalesce("root", "fp").alias("root"), F.coalesce("head_root", "centre").alias("head_root")), "placed")
    outside = F.col("root") != F.col("head_root")
    rest = placed.join(placed.where(outside).select("bucket").distinct(), "bucket", "left_semi").where(F.col("fp") != F.col("centre"))
    rest = stored(rest.groupBy("centre", "fp").agg(F.first("root").alias("root"), F.max(outside).alias("out")), "rest")
    more = _compared(rest.join(_open(_sets(texts.join(rest.select("fp").distinct(), "fp", "left_semi"))), "fp"))
    if not more.isEmpty():
        roots = components(simple, pairs.unionByName(more))
    return nodes.join(roots, "fp", "left").select("fp", "own", F.coalesce("root", F.struct(F.col("own.first").alias("first"), "fp")).alias("root"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one doc_id and one text."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts whose shingles of five words are similar to SIMILAR or more are linked; of each class the
    document with the smallest doc_id stays.

    Null, empty and blank texts are one class. A null doc_id counts as the largest; of equal doc_ids in a class the text of
    the smallest hash stays, of repeated rows one. Columns of any other name are kept. An empty table gives an empty table.
    """
    kept = similar_classes(docs).groupBy("root").agg(F.min("own").alias("own")).select(F.col("own.doc_id").alias("doc_id"), F.col("own.row").alias("row"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"))
    found = rows.join(kept, same_row(rows, kept), "left_semi").dropDuplicates(["doc_id", "row"])
    return found.select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
