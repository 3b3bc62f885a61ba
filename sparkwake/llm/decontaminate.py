"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and everything beyond ASCII. The windows of a
benchmark item are its WINDOW consecutive words; an item of fewer words, but not none, is one window. Training texts are
scanned with numpy, many at once: words and then windows get rolling 64-bit hashes, a bitmap of the set's hashes leaves
the few windows that may be in it, and those are verified word by word. Every word inside an occurrence of a window is
hit. `remove_spans` cuts the hit words out of the texts, `remove_documents` drops texts by their share of hit words.

Scale: the set is broadcast, so its size is counted first. It holds at most BLOCK pairs of window and item; a larger
benchmark is cut into blocks of that size by hash, each broadcast and scanned for in a pass of its own, and the passes'
hits are joined by the texts' digests. With one block the query is one map over the documents without a shuffle. Texts
are read in parts of SEGMENT words, so memory does not follow the longest text.

Defined cases: null and empty texts, and texts without a word, have zero words and are clean; an item without a word has
no window. Items that share an id count as one item; an item whose id is null hits words and is not counted or listed.
Repeated documents are each returned. Items are listed by their ids as strings. An empty benchmark hits nothing, empty
documents give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwake.llm.common import documents, rows_to_batch, stored

WINDOW = 10
#: Pairs of a window and an item in one broadcast, about 150 bytes each.
BLOCK = 200_000
#: Words whose windows are hashed at once, and bytes of texts that are read together.
SEGMENT, TOGETHER = 1 << 17, 1 << 20
BITS = 22
P, Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

_of_words = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: bytes.translate: what is not of a word becomes a space.
TO_SPACES = bytes(b if _of_words[b] else 32 for b in range(256))


def normalised(text: bytes) -> bytes:
    """The words of lower-case bytes, one space between them."""
    return b" ".join(filter(None, text.translate(TO_SPACES).split(b" ")))


def words_in(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-case bytes start and end."""
    edge = np.diff(_of_words[lower].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            made = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)))) for x in (self.base, self.inverse)]
            if n > 4 * TOGETHER:
                return made[0], made[1]
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_P, _Q = Powers(P), Powers(Q)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(Q)
    return h ^ (h >> np.uint64(29))


def word_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = int(starts[0])
    part = lower[first : int(ends[-1])]
    up, down = _P(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
    return _stirred((sums[ends - first] - sums[starts - first]) * down[starts - first])


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` words."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    up, down = _Q(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return _stirred((sums[length:] - sums[:-length]) * down[: len(words) - length + 1])


class Windows:
    """A block of the set: windows by their words, with the items that have them, and a bitmap of hashes for each length."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        self.ids = sorted({i for _, i in pairs if i is not None})
        number = {i: n for n, i in enumerate(self.ids)}
        self.items: dict[bytes, list[int]] = {}
        for text, item in pairs:
            held = self.items.setdefault(text, [])
            if item is not None:
                held.append(number[item])
        self.bits: dict[int, np.ndarray] = {}
        for text in self.items:
            length = text.count(b" ") + 1
            lower = np.frombuffer(text, np.uint8)
            bits = self.bits.setdefault(length, np.zeros(1 << BITS, bool))
            bits[window_hashes(word_hashes(lower, *words_in(lower)), length) >> np.uint64(64 - BITS)] = True

    def occurrences(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, until: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(first word, number of words, window) of each occurrence. until: the ends, in words, of the texts that lie in lower."""
        longest = max(self.bits, default=1)
        for at in range(0, len(starts), SEGMENT):
            to = min(at + SEGMENT + longest - 1, len(starts))
            words = word_hashes(lower, starts[at:to], ends[at:to])
            for length, bits in self.bits.items():
                maybe = np.flatnonzero(bits[window_hashes(words, length) >> np.uint64(64 - BITS)]) + at
                maybe = maybe[(maybe < at + SEGMENT) & (maybe + length <= until[np.searchsorted(until, maybe, "right")])]
                for i in maybe.tolist():
                    text = normalised(lower[starts[i] : ends[i + length - 1]].tobytes())
                    if text in self.items:
                        yield i, length, text


class Scanned:
    """What a block has in texts: words and hit words of each, items by number, and the bytes of hit words as ranges."""

    def __init__(self, block: Windows, texts: list[bytes]):
        joined = b"\n".join(texts).lower()  # bytes.lower: A-Z alone
        lower = np.frombuffer(joined, np.uint8)
        self.starts, self.ends = words_in(lower)
        self.begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, self.begins)
        cover = np.zeros(len(self.starts) + 1, np.int32)
        self.items: dict[int, set[int]] = {}
        for i, length, window in block.occurrences(lower, self.starts, self.ends, self.first[1:]):
            cover[i] += 1
            cover[i + length] -= 1
            if block.items[window]:
                self.items.setdefault(int(np.searchsorted(self.first, i, "right")) - 1, set()).update(block.items[window])
        self.hit = np.cumsum(cover[:-1]) > 0
        self.hits = np.diff(np.concatenate(([0], np.cumsum(self.hit)))[self.first])

    def words(self, k: int) -> int:
        return int(self.first[k + 1] - self.first[k])

    def ranges(self, k: int) -> np.ndarray:
        """Starts and ends of runs of hit words in text k, in bytes."""
        a, b = self.first[k], self.first[k + 1]
        edge = np.diff(self.hit[a:b].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        from_, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        return np.stack((self.starts[a:b][from_], self.ends[a:b][to]), axis=1) - self.begins[k]


def together(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about TOGETHER bytes, with the first one's place; null is empty."""
    at, held, size = 0, [], 0
    for n, t in enumerate(texts):
        held.append(t or b"")
        size += len(held[-1])
        if size >= TOGETHER or n == len(texts) - 1:
            yield at, held
            at, held, size = n + 1, [], 0


def windows(benchmark: DataFrame) -> DataFrame:
    """benchmark (item_id, text) -> distinct pairs (words: the window's, item: the id as a string)."""
    schema = pa.schema([("words", pa.binary()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised((text or "").encode().lower()).split(b" ")
                if words != [b""]:
                    rows |= {(b" ".join(words[i : i + WINDOW]), item) for i in range(max(1, len(words) - WINDOW + 1))}
            yield rows_to_batch(list(rows), schema)

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "words binary, item string").distinct()


def blocks(benchmark: DataFrame) -> list:
    """The set in broadcasts of at most about BLOCK pairs."""
    pairs = stored(windows(benchmark), "windows")
    n = 1 + pairs.count() // BLOCK
    mine = lambda k: pairs if n == 1 else pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == k)
    return [lambda k=k: pairs.sparkSession.sparkContext.broadcast(Windows([(bytes(r["words"]), r["item"]) for r in mine(k).collect()])) for k in range(n)]


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _marked(docs: DataFrame, block) -> DataFrame:
    """docs (doc_id, text) -> the report of one block that is the whole set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), []
            for at, some in together(texts):
                seen = Scanned(block.value, some)
                for k in range(len(some)):
                    items = [block.value.ids[i] for i in sorted(seen.items.get(k, ()))]
                    rows.append((ids[at + k], seen.words(k), int(seen.hits[k]), len(items), _digest(items), bool(seen.hits[k])))
            yield rows_to_batch(rows, schema)

    return docs.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _found(texts: DataFrame, block) -> DataFrame:
    """texts (digest, text) -> digest, ranges, items of the texts in which the block has something."""
    schema = pa.schema([("digest", pa.string()), ("ranges", pa.binary()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, rows = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), {}
            for at, some in together(texts):
                seen = Scanned(block.value, some)
                for k in np.flatnonzero(seen.hits).tolist():
                    rows[keys[at + k]] = (keys[at + k], seen.ranges(k).astype("<i8").tobytes(), [block.value.ids[i] for i in sorted(seen.items.get(k, ()))])
            yield rows_to_batch(list(rows.values()), schema)

    return texts.mapInArrow(run, "digest string, ranges binary, items array<string>")


def _united(parts: list[bytes]) -> np.ndarray:
    """Ranges of several blocks, overlapping ones joined."""
    each = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts])
    each = each[np.argsort(each[:, 0], kind="stable")]
    reach = np.maximum.accumulate(each[:, 1])
    new = np.flatnonzero(np.concatenate(([True], each[1:, 0] > reach[:-1])))
    return np.stack((each[new, 0], reach[np.concatenate((new[1:], [len(each)])) - 1]), axis=1)


def hits(docs: DataFrame, benchmark: DataFrame, sets: list | None = None) -> DataFrame:
    """docs (text, ...) -> digest (sha2 of the text), ranges (bytes of hit words), items: one row for each text that is hit."""
    texts = docs.select(F.sha2("text", 256).alias("digest"), "text")
    passes = [stored(_found(texts, block()).dropDuplicates(["digest"]), "hits") for block in sets or blocks(benchmark)]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    lists = every.groupBy("digest").agg(F.collect_list("ranges").alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    schema = pa.schema([("digest", pa.string()), ("ranges", pa.binary()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, items = (c.to_pylist() for c in batch.columns)
            yield rows_to_batch([(k, _united(p).tobytes(), i) for k, p, i in zip(keys, parts, items, strict=True)], schema)

    return lists.mapInArrow(run, "digest string, ranges binary, items array<string>")


def _words_hit(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ranges, items) -> the report."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges, items in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                starts, _ = words_in(np.frombuffer((text or b"").lower(), np.uint8))
                n = int(np.diff(np.searchsorted(starts, np.frombuffer(ranges or b"", "<i8")).reshape(-1, 2), axis=1).sum())
                rows.append((doc_id, len(starts), n, len(items or ()), _digest(items or []), n > 0))
            yield rows_to_batch(rows, schema)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, benchmark -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, a row for each document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = blocks(benchmark)
    if len(sets) == 1:
        return _marked(docs, sets[0]())
    found = hits(docs, benchmark, sets)
    return _words_hit(docs.withColumn("digest", F.sha2("text", 256)).join(found, "digest", "left").select("doc_id", "text", "ranges", "items"))


def _with_ranges(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with their ranges, and the names of the two columns added, which none of its own has."""
    taken = {c.lower() for c in docs.columns}
    digest, ranges = (next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in ("digest", "ranges"))
    found = hits(docs, benchmark).select(F.col("digest").alias(digest), F.col("ranges").alias(ranges))
    return docs.withColumn(digest, F.sha2("text", 256)).join(found, digest, "left"), digest, ranges


@F.udf(T.StringType(), useArrow=True)
def _cut(text: str | None, ranges: bytes | None) -> str | None:
    if not ranges or text is None:
        return text
    raw, at, kept = text.encode(), 0, []
    for a, b in np.frombuffer(ranges, "<i8").reshape(-1, 2).tolist():
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


@F.udf(T.DoubleType(), useArrow=True)
def _share(text: str | None, ranges: bytes | None) -> float:
    if not ranges or not text:
        return 0.0
    starts, _ = words_in(np.frombuffer(text.encode().lower(), np.uint8))
    return float(np.diff(np.searchsorted(starts, np.frombuffer(ranges, "<i8")).reshape(-1, 2), axis=1).sum() / len(starts))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the hit words, and what stands between words of one run, cut out of text; the other columns as they are."""
    rows, _, ranges = _with_ranges(docs, benchmark)
    return rows.withColumn("text", _cut("text", ranges)).select(*docs.columns)


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """docs of whose words no more than `share` are hit."""
    rows, _, ranges = _with_ranges(docs, benchmark)
    return rows.where(_share("text", ranges) <= share).select(*docs.columns)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS i FROM b WHERE len(w) > 0)
), d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
places AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
seen AS (
  SELECT r, i, l.n, array_to_string(w[i + 1 : i + l.n], ' ') AS words FROM places CROSS JOIN (SELECT DISTINCT n FROM win) l WHERE i + l.n <= len(w)
), occ AS (SELECT r, i, s.n, words, item_id FROM seen s JOIN win USING (n, words)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, i + unnest(range(n)) AS j FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
