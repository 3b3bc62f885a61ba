"""Byte-level BPE encoding and decoding.

Every match of the split pattern (a word) is encoded by itself. The merges run in Spark: a higher-order function
folds a word's byte array, held as a string in which each letter stands for a piece, by merging the adjacent pair of
least rank, the leftmost of equals, until no pair has a rank. The rank map is one literal, an array of small maps by the
CRC-32 of the pair, so that a look-up reads one small map.

Texts are split once, in slices of about SLICE_BYTES: a slice is stored as its distinct words, how often each occurs,
and its texts as numbers of them, so that no text is shuffled or read twice. Distinct words are folded, not places: the
FREQUENT most common short ones over all slices are folded once and go to the tasks as one compact table (at most
FREQUENT x (WORD_BYTES x 5 + 20) bytes, whatever the input); words that occur once need no table, and a slice's other words are folded with the slice. A word over FOLD_BYTES long, for which folding arrays is
quadratic, is merged with a heap; the result is the same.

Decoding concatenates the binary pieces of the ids.

Defined cases: null and empty texts have no ids; the digests are those of the empty string. Texts of any length
are encoded whole. Repeated rows give repeated results. The vocabulary has no special tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, frequent, rows_to_batch, stored

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The code points of Unicode's White_Space, as the pattern means them.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FREQUENT, WORD_BYTES, FOLD_BYTES = 300_000, 64, 1024
#: Words that one task folds, about.
FOLDED = 25_000
#: Small maps of the literal; bytes of text that a task reads at once.
MAPS, SLICE_BYTES = 1 << 16, 3 << 20
#: Words that are Python strings at once.
HASHED = 20_000
#: Marks that are a word by themselves after letters, and the end of Latin letters, all of which are letters to the pattern.
MARKS, LATIN_END = frozenset(".,;:!?"), "\u0250"
#: A chunk between single spaces that leaves the place of the first word after it open: empty, or white space at an end.
WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = f"^$|^[{WHITE}]|[{WHITE}]$"
EDGE, NONE = "\x01", "\U0010ffff"


@cache
def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@cache
def splitter() -> Callable[[str], list[str]]:
    pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")
    return regex.compile(pattern).findall


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def letter(number: int) -> str:
    """The character that stands for a piece: past Latin-1, and past the code points that are no characters."""
    return chr(number + 0x100 if number < 0xD700 else number + 0x900)


def rank_map(ranks: dict[bytes, int]) -> tuple[Column, str]:
    """The literal rank map: by the CRC-32 of two pieces' letters, a small map from such pairs to the letter of what they
    merge into, whose number is its rank; and the letters of the 256 bytes."""
    maps: list[dict[str, str]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks.items():
        for at in range(1, len(piece)):
            a, b = ranks.get(piece[:at]), ranks.get(piece[at:])
            if a is not None and b is not None:
                pair = letter(a) + letter(b)
                maps[zlib.crc32(pair.encode()) % MAPS][pair] = letter(rank)
    foldable = F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,string>>")
    return foldable, "".join(letter(ranks[bytes([b])]) for b in range(256))


def folded(words: Column, maps: tuple[Column, str]) -> Column:
    """Ids of each of an array of words; the map occurs once in the plan."""
    held, first = maps

    def rank(m: Column, pair: Column) -> Column:
        return F.coalesce(F.try_element_at(F.get(m, F.crc32(pair.cast("binary")).bitwiseAND(F.lit(MAPS - 1)).cast("int")), pair), F.lit(NONE))

    return _let(held, lambda m: F.transform(words, lambda w: fold(w, lambda pair: rank(m, pair), first)))


def fold(word: Column, rank: Callable[[Column], Column], first: str) -> Column:
    """Ids of a word of at least one byte, array<int>. Its pieces are letters of a string, with EDGE at either end; a second
    string has the rank of each two neighbours, NONE where they do not merge. The leftmost least rank merges, step by step."""

    def merges(text: Column) -> Column:
        n = F.length(text)
        pairs = F.array_join(F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(text, i, F.lit(2)))), "")
        state = lambda p, r: F.struct(p.alias("pieces"), r.alias("pairs"), F.array_min(F.split(r, F.lit(""))).alias("least"))

        def merge(s: Column, _: Column) -> Column:
            p, r, new = s["pieces"], s["pairs"], s["least"]

            def at(k: Column) -> Column:
                before, after = rank(F.concat(F.substring(p, k - 1, F.lit(1)), new)), rank(F.concat(new, F.substring(p, k + 2, F.lit(1))))
                left = F.concat(F.substring(r, F.lit(1), k - 2), before, after, F.substring(r, k + 2, n))
                return _let(left, lambda x: state(F.overlay(p, new, k, F.lit(2)), x))

            return F.when(new == NONE, s).otherwise(_let(F.instr(r, new), at))

        number = lambda c: F.when(c >= 0xE000, c - 0x900).otherwise(c - 0x100)
        ids = lambda s: F.transform(F.split(F.substring(s["pieces"], F.lit(2), F.length(s["pieces"]) - 2), F.lit("")), lambda c: number(F.ascii(c)))
        return F.aggregate(F.sequence(F.lit(3), F.greatest(n - 1, F.lit(3))), _let(pairs, lambda r: state(text, r)), merge, ids)

    letters = F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), "".join(map(chr, range(256))), first)
    return _let(F.concat(F.lit(EDGE), letters, F.lit(EDGE)), merges)


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a heap of pairs, for long words."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that begins here; of the piece before it
    alive, heap = bytearray(b"\1") * n, []

    def offer(a: int) -> None:
        if a >= 0 and end[a] < n and (rank := ranks.get(word[a : end[end[a]]])) is not None:
            heapq.heappush(heap, (rank, a, end[a], end[end[a]]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if alive[a] and end[a] == b and alive[b] and end[b] == c:
            alive[b], end[a] = 0, c
            if c < n:
                before[c] = a
            offer(a)
            offer(before[a])
    return [ranks[word[a : end[a]]] for a in range(n) if alive[a]]


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about SLICE_BYTES of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, end - at)
            pa.default_memory_pool().release_unused()
            at = end


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each text's chunks between single spaces: where a text's begin (one more than texts), numbers, and the distinct ones."""
    lists = pc.split_pattern(texts.fill_null(""), " ")
    coded = lists.flatten().dictionary_encode()
    return np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))), coded.indices.to_numpy(), coded.dictionary


def words_of(chunks: list[str], before: str) -> tuple[pa.Array, np.ndarray]:
    """Words of the chunks, each with `before` in front, one after another, and how many each has."""
    split, words, many = splitter(), [], []
    for c in chunks:
        last = c[-1:]
        body = c[:-1] if last in MARKS else c
        if body.isalpha() and (body.isascii() or max(body) < LATIN_END):  # letters and at most one mark: what the pattern gives
            words.append(before + body)
            if body is c:
                many.append(1)
            else:
                words.append(last)
                many.append(2)
        else:
            own = split(before + c)
            words += own
            many.append(len(own))
    return pa.array(words, pa.string()), np.array(many, np.int64)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[k], starts[k] + 1, ... of each run, one run after another."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum()) if len(lengths) else np.empty(0, np.int64)


def split_slice(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The texts' words as numbers, one text after another, and where each text's end; the distinct words and how often each occurs."""
    begins, numbers, chunks = chunks_of(texts)
    strange = pc.match_substring_regex(chunks, ODD).to_numpy(zero_copy_only=False).astype(bool)
    distinct = chunks.to_pylist()
    whole = np.logical_or.reduceat(strange[numbers], begins[:-1])
    # units: the distinct chunks with a space before; then, for each text, its first chunk or, if it has odd ones, all of it
    inner, many = words_of([c if not s else "" for c, s in zip(distinct, strange.tolist(), strict=True)], " ")
    heads, own = words_of([texts[i].as_py() or "" if w else distinct[n] for i, (w, n) in enumerate(zip(whole.tolist(), numbers[begins[:-1]].tolist(), strict=True))], "")
    coded = pa.concat_arrays([inner, heads]).dictionary_encode()
    words = coded.indices.to_numpy()
    kept = ~np.repeat(whole, np.diff(begins))
    kept[begins[:-1]] = True
    units = numbers.astype(np.int64)
    units[begins[:-1]] = len(distinct) + np.arange(len(texts))
    units, n_units = units[kept], np.add.reduceat(kept.astype(np.int64), begins[:-1])
    unit_words = np.concatenate((many, own))
    unit_starts = np.concatenate(([0], np.cumsum(unit_words)))[:-1]
    flat = words[runs(unit_starts[units], unit_words[units])]
    ends = np.concatenate(([0], np.cumsum(unit_words[units])))[np.cumsum(n_units)]
    times = np.bincount(flat, minlength=len(coded.dictionary))
    met = times > 0
    return (np.cumsum(met) - 1)[flat].astype("<i4"), ends, coded.dictionary.filter(pa.array(met)), times[met]


def listed(values: pa.Array) -> pa.ListArray:
    """A column of one row, which holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def split(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_ids, ends, codes (compressed), words, times: one row a slice, as split_slice gives it."""
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            codes, ends, words, times = split_slice(batch.column("text"))
            yield pa.RecordBatch.from_arrays([listed(batch.column("doc_id")), listed(pa.array(ends)), pa.array([pa.compress(codes.tobytes(), codec="zstd", asbytes=True)], pa.binary()), listed(words), listed(pa.array(times))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_ids array<long>, ends array<long>, codes binary, words array<string>, times array<long>")


class Table:
    """Ids of words, in a few arrays, by the order of the words' hashes."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        hashes = self.hashed(words)
        order = np.argsort(hashes, kind="stable")
        words, ids = words.take(pa.array(order)), ids.take(pa.array(order))
        self.words, self.hashes, self.ids = words, hashes[order], ids.flatten().to_numpy().astype(np.int32)
        self.ends = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))).astype(np.int32)

    @staticmethod
    def hashed(words: pa.Array) -> np.ndarray:
        parts = (words.slice(at, HASHED).to_pylist() for at in range(0, len(words), HASHED))
        return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(parts)), np.uint64, len(words))

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 for one that it does not have (or whose hash another word has, which is then folded)."""
        if not len(self.words):
            return np.full(len(words), -1)
        hashes = self.hashed(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        near = np.flatnonzero(self.hashes[at] == hashes)
        same = pc.equal(words.take(pa.array(near)), self.words.take(pa.array(at[near]))).to_numpy(zero_copy_only=False).astype(bool)
        found = np.full(len(words), -1)
        found[near[same]] = at[near[same]]
        return found


def looked_up(flat: np.ndarray, ends: np.ndarray, words: pa.Array, table: Table, path: str = RANKS) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of a slice and where each text's end: ids of known words in place, -1 - k for the k-th of the words to be
    folded; and those words."""
    found = table.places(words)
    long = np.flatnonzero((pc.binary_length(words).to_numpy() > FOLD_BYTES) & (found < 0))
    merged = [np.array(heap_merges(words[int(k)].as_py().encode(), load_ranks(path)), np.int32) for k in long]
    starts, lengths = table.ends[found].astype(np.int64), np.where(found < 0, 1, table.ends[found + 1] - table.ends[found]).astype(np.int64)
    lengths[long] = [len(m) for m in merged]
    starts[long] = len(table.ids) + np.concatenate(([0], np.cumsum(lengths[long])))[:-1]
    found[long] = 0
    rest = np.flatnonzero(found < 0)
    starts[rest] = len(table.ids) + sum(map(len, merged)) + np.arange(len(rest))
    pool = np.concatenate([table.ids, *merged, -1 - np.arange(len(rest), dtype=np.int32)])
    codes = pool[runs(starts[flat], lengths[flat])]
    return codes, np.concatenate(([0], np.cumsum(lengths[flat])))[ends], words.take(pa.array(rest))


def filled(codes: np.ndarray, ends: np.ndarray, ids: np.ndarray, id_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and where each text's end, with the ids of the folded words put in."""
    lengths = np.ones(len(codes), np.int64)
    holes = np.flatnonzero(codes < 0)
    asked = -1 - codes[holes]
    lengths[holes] = id_ends[asked + 1] - id_ends[asked]
    out, after = np.repeat(codes, lengths), np.concatenate(([0], np.cumsum(lengths)))
    out[out < 0] = ids[runs(id_ends[asked], lengths[holes])]
    return out, after[ends]


def read(docs: DataFrame, path: str = RANKS, most: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text) -> doc_ids, ends, codes, rest: one row a slice, codes as looked_up gives them, and the ids of the
    words that its table does not have. Texts are split once: their words are stored as numbers, and counted from there."""
    spark, maps = docs.sparkSession, rank_map(load_ranks(path))
    slices = stored(split(docs), "slices")
    counts = slices.select(F.inline(F.arrays_zip(F.col("words").alias("word"), "times"))).where(F.octet_length("word") <= WORD_BYTES)
    counted = stored(counts.groupBy("word").agg(F.sum("times").alias("n")).where("n > 1"), "words")
    known = frequent(counted, most, FOLDED).select("word", F.get(folded(F.array("word"), maps), F.lit(0)).alias("ids")).toArrow().combine_chunks()
    column = lambda name, kind: known[name].combine_chunks() if known.num_rows else pa.array([], kind)
    table = spark.sparkContext.broadcast(Table(column("word", pa.string()), column("ids", pa.list_(pa.int32()))))
    del known
    pa.default_memory_pool().release_unused()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("codes", pa.binary()), ("rest", pa.list_(pa.string()))])
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, ends, words = (batch.column(c).slice(k, 1).flatten() for c in ("doc_ids", "ends", "words"))
                raw = pa.decompress(batch.column("codes")[k].as_buffer(), 4 * ends[-1].as_py(), codec="zstd")
                codes, ends, rest = looked_up(np.frombuffer(raw, "<i4"), ends.to_numpy(), words, table.value, path)
                yield pa.RecordBatch.from_arrays([listed(doc_ids), listed(pa.array(ends)), pa.array([codes.astype("<i4").tobytes()], pa.binary()), listed(rest)], schema=schema)
                pa.default_memory_pool().release_unused()

    looked = slices.select("doc_ids", "ends", "codes", "words").mapInArrow(look_up, "doc_ids array<long>, ends array<long>, codes binary, rest array<string>")
    return looked.withColumn("rest", folded(F.col("rest"), maps))


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows of read() -> doc_ids and ids (little-endian unsigned 32-bit integers), a slice at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            doc_ids, ends, rest = (batch.column(c).slice(k, 1).flatten() for c in ("doc_ids", "ends", "rest"))
            id_ends = np.concatenate(([0], np.cumsum(pc.list_value_length(rest).to_numpy(zero_copy_only=False)))).astype(np.int64)
            out, ends = filled(np.frombuffer(batch.column("codes")[k].as_buffer(), "<i4"), ends.to_numpy(), rest.flatten().to_numpy(), id_ends)
            raw, cuts = out.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
            yield doc_ids.to_pylist(), [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, path: str = RANKS, most: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids: binary, little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
        for doc_ids, ids in finished(batches):
            yield rows_to_batch(list(zip(doc_ids, ids, strict=True)), schema)

    return read(docs, path, most).mapInArrow(run, "doc_id long, ids binary")


class Pieces:
    """Binary pieces by id."""

    def __init__(self, path: str):
        self.pieces = {rank: piece for piece, rank in load_ranks(path).items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, array("i", ids)))


def digests(docs: DataFrame, path: str = RANKS, most: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, from the ids and what they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for doc_ids, every in finished(batches):
            yield rows_to_batch([(doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(pieces.decode(ids)).hexdigest()) for doc_id, ids in zip(doc_ids, every, strict=True)], schema)

    return read(docs, path, most).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
