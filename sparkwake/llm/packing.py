"""Best-fit packing of documents into sequences.

A document is its token ids and one separator. One longer than CAPACITY is cut into pieces of CAPACITY tokens and
a rest. Best-fit decreasing: pieces from the longest to the shortest, each into the open bin with the least room
that still holds it, found by a segment tree over the remaining capacities.

There are at most CAPACITY lengths, so the packing is computed on their counts: the tree's leaf for a room holds
the runs of bins that have it, and all pieces of a length that go to the same run are placed at once. This gives
the bins that placing the pieces one by one gives, with memory bounded by CAPACITY squared whatever the input.
Pieces then get their rank within their length, counted in CHUNK-sized parts so that no length is one task's, and
find their place by rank.

Tokens: a text's ids are those of its parts between white space, which the tokenizer's own split never crosses;
workers keep the ids of parts and words they have seen. A text with the control characters that Python takes for white
space and the tokenizer does not, or with what may be one of the tokenizer's added tokens (`<|endoftext|>`), is encoded
whole by the tokenizer as it is loaded.

Defined cases: null and empty texts are the separator alone, one piece of length 1. Equal pieces of a length go by
doc_id (null first), piece, checksum. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, rows_to_batch, slices, stored

CAPACITY, SEPARATOR = 4096, 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Parts of texts, and words, whose ids a worker keeps; it forgets all when it has more.
KEPT, WORDS_KEPT = 600_000, 1_000_000
#: Pieces of a length that are ranked together, about; and the most parts in which they are.
CHUNK, CHUNKS = 2000, 4096
#: The split that the tokenizer's file states, after lower case and without white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
#: White space to Python but not to the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Ids of texts. Parts between white space and their words are encoded once as long as they are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts in which an added token of the tokenizer may stand are encoded whole.
        self.mark = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.merges = Tokenizer(self.tokenizer.model)  # for words in byte names, with spaces between them
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)  # ids that end a word
        self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            names = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTE_NAMES) for w in some]
            ids = np.array(self.merges.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.words.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _learn(self, parts: set[str]) -> None:
        """Parts without white space."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        single, split = {}, {}
        for part in parts:
            if part.isascii():
                if part.isalpha():
                    single[part] = part.lower()
                else:
                    split[part] = ASCII_WORDS(part.lower())
            elif max(part) < "\u0250":  # Latin: composed already, and lower case is the same everywhere
                low = part.lower()
                if low.isalpha():
                    single[part] = low
                else:
                    split[part] = WORDS(low)
            else:
                self.parts[part] = self._whole(part)
        self._learn_words(list(set(single.values()).union(*split.values()).difference(self.words)))
        get = self.words.__getitem__
        self.parts.update(zip(single, map(get, single.values()), strict=True))
        for part, words in split.items():
            self.parts[part] = b"".join(map(get, words))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = {k for k, t in enumerate(texts) if t and (self.mark in t or any(c in t for c in ODD_SPACE))}
        own = [[] if t is None or k in whole else t.split() for k, t in enumerate(texts)]
        codes = [list(map(self.parts.get, parts)) for parts in own]
        new = [k for k, found in enumerate(codes) if None in found]
        if new:
            if len(self.parts) > KEPT:
                self.parts.clear()
                new = [k for k, parts in enumerate(own) if parts]
                codes = [[None] * len(parts) for parts in own]
            self._learn({p for k in new for p, ids in zip(own[k], codes[k], strict=True) if ids is None})
            for k in new:
                codes[k] = map(self.parts.__getitem__, own[k])
        for k, (text, found) in enumerate(zip(texts, codes, strict=True)):
            yield self._whole(text) if k in whole else b"".join(found)


def byte_names() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the others as U+0100 onward in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_NAMES = byte_names()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32: a row for each piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = SEPARATOR.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for cols in slices(batches):
            rows = []
            for doc_id, ids in zip(cols["doc_id"], own.encode(cols["text"]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield rows_to_batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Rooms:
    """Segment tree over remaining capacities; a leaf holds runs (first bin, bins) that have that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, room: int) -> None:
        at = room + self.size
        self.any[at] = bool(self.runs[room])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def add(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.runs[room].append((first, bins))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` that some bin has."""
        at = least + self.size
        while not self.any[at]:
            while at & 1:  # a right child: what follows is not below its parent
                at //= 2
                if at <= 1:
                    return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of this level
                return None
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def place(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing on counts of lengths. Per length, in the order of its pieces: (rank of the first piece,
    first bin, pieces in each bin, offset of a bin's first piece)."""
    rooms, opened, runs = Rooms(capacity), 0, {}
    for length in sorted(counts, reverse=True):
        left, rank, own = counts[length], 0, []
        while left:
            room = rooms.tightest(length)
            if room is None:
                each = capacity // length
                first, bins, room = opened, -(-left // each), capacity
                opened += bins
            else:
                first, bins = rooms.take(room)
                each = room // length
            used = min(bins, -(-left // each))
            own.append((rank, first, each, capacity - room))
            put = min(left, used * each)
            last = put - (used - 1) * each  # pieces in the last bin used
            full = used if last == each else used - 1
            rooms.add(room - each * length, first, full)
            if full < used:
                rooms.add(room - last * length, first + full, 1)
            rooms.add(room, first + used, bins - used)
            left -= put
            rank += put
        runs[length] = own
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) -> the same with sequence_id and offset. parts is read twice."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = place(counts, capacity)
    chunks = max(1, min(CHUNKS, sum(counts.values()) // CHUNK))
    dealt = parts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(within) - 1).join(sums, ["length", "chunk"]).withColumn("rank", F.col("own") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {length: [r[0] for r in own] for length, own in runs.items()}
        for cols in slices(batches):
            rows = []
            for *kept, rank in zip(*(cols[n] for n in (*names, "rank")), strict=True):
                length = kept[3]
                begin, first, each, offset = runs[length][bisect_right(starts[length], rank) - 1]
                bin_, at = divmod(rank - begin, each)
                rows.append((*kept, first + bin_, offset + at * length))
            yield rows_to_batch(rows, schema)

    return ranked.select(*names, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(documents(spark, sf_dir)), "pieces"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every piece of the documents left and its place.

    Null and empty texts are the separator alone; repeated rows are packed each, and equal pieces in a fixed order.
    Other columns, whatever their names, are not read. An empty table gives no pieces.
    """
    return pack(stored(pieces(docs), "pieces"))
