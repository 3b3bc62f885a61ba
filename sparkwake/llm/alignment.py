"""Alignment of two tokenizers by a dangling-suffix transducer.

Both token streams spell the same bytes. The transducer's state is the side that leads and the bytes by which it leads,
which the other side has not matched yet; the side behind takes its next token, whose bytes shorten that suffix or turn
the lead round. Transitions are kept by (state, token), so each is computed once in a worker. Where nothing dangles, both
have just ended: that closes a group, and the two tokens that ended it are linked. No token is empty, so a group has one link.

Both tokenizers start anew at a single space between two characters that are no white space: A's pattern splits there,
and no piece of B holds a space mark behind another character. Texts are cut there into units, and nothing dangles
between units; so new units run through the tokenizers and the transducer, and a text is the sequence of its units'
results. A worker keeps what units gave as long as it has room.

Counts of linked id pairs are over all documents: the links of each document are stored once, counted with a combine
before the shuffle, and each pair gets its count and whether that is the highest of its B id. The COMMON most frequent
pairs at most are broadcast and looked up in place; a document's other pairs, which are rare ones, are joined, so no
pair's count is lost and nothing that grows with the corpus is broadcast.

Defined cases: null and empty texts, and texts whose tokens of either side do not spell space + text (a literal U+2581,
which B gives back as a space), have no tokens: zeros and an empty groups_sha256. Strings of special tokens are plain
text. Repeated documents count each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, frequent, rows_to_batch, slices, stored

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Pairs of ids that are broadcast at most, 17 bytes each.
COMMON = 500_000
#: Units that a worker keeps, and their length in characters; it forgets all when it has more.
KEPT, LONG = 200_000, 64
#: Transitions that a worker keeps; it forgets all when it has more.
TRANSITIONS = 200_000
#: Characters of units that are encoded together, and of texts that are cut at once.
TOGETHER, AT_ONCE = 1 << 16, 1 << 20
#: A space between two characters that are no white space. Python's white space holds all of A's.
CUT = re.compile(r"(?<=\S) (?=\S)")
LEAD_A, LEAD_B = 0, 1


def byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokens:
    """A tokenizer's ids of texts, and the bytes of each id."""

    def __init__(self, spelled: dict[int, bytes], encode):
        self.spelled, self.encode = spelled, encode


def tokens_a(path: str) -> Tokens:
    """A byte-level vocabulary: entries are decoded byte by byte, added tokens as they are written. Where merges stand in the
    order of their ids, ranks say the same, and the library that works on ranks is three times as fast: same ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    names = byte_names()
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, split = held["model"], held.get("pre_tokenizer") or {}
    spelled = {i: bytes(names[c] for c in piece) if all(c in names for c in piece) else piece.encode() for piece, i in model["vocab"].items()}
    added = {i: x.content.encode() for i, x in t.get_added_tokens_decoder().items()}
    pairs = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
    ranked = {spelled[i]: i for i in spelled if i not in added}
    plain = split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": split.get("trim_offsets"), "use_regex": True} and held.get("normalizer") is None
    if plain and len(ranked) == 256 + len(model["merges"]) and all(model["vocab"].get(p) == 256 + n for n, p in enumerate(pairs)):
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranked, special_tokens={}).encode_ordinary
    else:
        encode = lambda text: t.encode_batch_fast([text], add_special_tokens=False)[0].ids
    return Tokens(added | spelled, encode)


def tokens_b(path: str) -> Tokens:
    """Pieces in UTF-8, U+2581 as a space, <0xHH> as that byte."""
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=path)
    one = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    return Tokens({i: one(t.id_to_piece(i)) for i in range(t.get_piece_size())}, lambda text: t.encode(text, num_threads=1))


class Transducer:
    """Groups of two streams of ids that spell the same bytes."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.sides = (a, b)
        self._forget()

    def _forget(self) -> None:
        """State 0: nothing dangles, and A is next."""
        self.states: list[tuple[int, bytes]] = [(LEAD_B, b"")]
        self.number = {self.states[0]: 0}
        self.to: list[dict[int, int]] = [{}]  # by state: the state after each token
        self.b_leads = [True]
        self.kept = 0

    def _numbered(self, state: tuple[int, bytes]) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.to.append({})
            self.b_leads.append(state[0] == LEAD_B)
        return self.number[state]

    def _learn(self, state: int, token: int) -> int:
        """The state after the side behind takes its token, from now on kept; -1 if that does not fit."""
        lead, suffix = self.states[state]
        behind = LEAD_B if lead == LEAD_A else LEAD_A
        spelled = self.sides[behind][token]
        if suffix.startswith(spelled):
            now = (lead, suffix[len(spelled) :])
        elif spelled.startswith(suffix):
            now = (behind, spelled[len(suffix) :])
        else:
            return -1
        to = self._numbered(now) if now[1] else 0
        self.to[state][token] = to
        self.kept += 1
        return to

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where groups end, as numbers of tokens of a and b; None if the two do not spell the same."""
        if self.kept >= TRANSITIONS:
            self._forget()
        state, i, j, found = 0, 0, 0, []
        to, b_leads = self.to, self.b_leads
        try:
            while True:
                if b_leads[state]:
                    if not state and i == len(a) and j == len(b):
                        return found
                    token, i = a[i], i + 1
                else:
                    token, j = b[j], j + 1
                now = to[state].get(token)
                if now is None and (now := self._learn(state, token)) < 0:
                    return None
                state = now
                if not state:
                    found.append((i, j))
        except IndexError:  # the side behind has no token left
            return None


class Aligner:
    """Results of units, written without the space that they begin with: groups as text, links, number of A's tokens. None:
    the unit has no tokens."""

    def __init__(self, a: str, b: str):
        self.a, self.b = tokens_a(a), tokens_b(b)
        self.transducer = Transducer(self.a.spelled, self.b.spelled)
        self.kept: dict[str, tuple[str, bytes, int] | None] = {}
        self.names = [str(i) for i in range(1 + max(max(self.a.spelled), max(self.b.spelled)))]

    def _results(self, units: list[str]) -> Iterator[tuple[str, bytes, int] | None]:
        """Units encoded as one text and cut apart where they end. If they do not come apart, None alone."""
        text = " " + " ".join(units)
        raw = text.encode()
        a, b = self.a.encode(text), self.b.encode(text[1:])
        of_a, of_b = [self.a.spelled[i] for i in a], [self.b.spelled[i] for i in b]
        ends = self.transducer.groups(a, b) if b"".join(of_a) == raw and b"".join(of_b) == raw else None
        if ends is None:
            yield None
            return
        to_a = np.array([i for i, _ in ends])
        group_ends = np.cumsum([len(x) for x in of_a])[to_a - 1]
        unit_ends = np.cumsum([len(u.encode()) + 1 for u in units])
        at = np.searchsorted(group_ends, unit_ends)
        if not (group_ends[np.minimum(at, len(ends) - 1)] == unit_ends).all():
            yield None
            return
        names_a, names_b, groups, i, j = [self.names[x] for x in a], [self.names[x] for x in b], [], 0, 0
        for x, y in ends:
            groups.append(f"{names_a[i]}|{names_b[j]}" if x - i == 1 == y - j else f"{','.join(names_a[i:x])}|{','.join(names_b[j:y])}")
            i, j = x, y
        to_b = np.array([j for _, j in ends])
        links = (np.array(a, np.uint64)[to_a - 1] << np.uint64(32) | np.array(b, np.uint64)[to_b - 1]).astype("<u8").tobytes()
        first = 0
        for last, n in zip((at + 1).tolist(), np.diff(to_a[at], prepend=0).tolist(), strict=True):
            yield ";".join(groups[first:last]), links[8 * first : 8 * last], n
            first = last

    def _learn(self, units: list[str], into: dict) -> None:
        """Results of new units, many encoded at once; where they do not come apart, each alone."""
        held, size = [], 0
        for n, u in enumerate(units):
            held.append(u)
            size += len(u)
            if size < TOGETHER and n < len(units) - 1:
                continue
            each = list(self._results(held))
            if each == [None] and len(held) > 1:
                each = [next(self._results([u])) for u in held]
            into.update(zip(held, each, strict=True))
            held, size = [], 0

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """n_a, n_b, n_groups, groups_sha256, links of each text."""
        cut = [CUT.split(t) if t else [] for t in texts]
        if len(self.kept) > KEPT:
            self.kept = {}
        new = {u for units in cut for u in units}.difference(self.kept)
        short = [u for u in new if len(u) <= LONG and u[:1].strip() and u[-1:].strip()]  # may stand side by side
        self._learn(short, self.kept)
        odd: dict[str, tuple | None] = {u: next(self._results([u])) for u in new.difference(short)}
        for units in cut:
            found = [self.kept[u] if u in self.kept else odd[u] for u in units] if odd else [self.kept[u] for u in units]
            if not found or None in found:
                yield 0, 0, 0, "", b""
                continue
            groups, links, a = zip(*found, strict=True)
            spelled, joined = ";".join(groups), b"".join(links)
            n, n_a = len(joined) // 8, sum(a)
            yield n_a, spelled.count(",") + 2 * n - n_a, n, hashlib.sha256(spelled.encode()).hexdigest(), joined


@cache
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def aligned(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """docs (doc_id, text) -> row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256, links (pairs a << 32 | b in order), stored."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for piece in slices(batches):
            ids, texts, first, size = piece["doc_id"], piece["text"], 0, 0
            for n, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= AT_ONCE or n == len(texts):
                    yield rows_to_batch([(number + k, i, *r) for k, (i, r) in enumerate(zip(ids[first:n], _aligner(a, b).texts(texts[first:n]), strict=True), first)], schema)
                    first, size = n, 0
            number += len(ids)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")
    return stored(made, "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """rows (links) -> word (the pair a << 32 | b), b, n (its links over all rows), best (n is the highest of its b), stored."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    counts = rows.select("links").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("b", F.col("word").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return stored(counts.join(most, "b").select("word", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def mapping(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """The alignment of the two vocabularies over docs: a_id, b_id, n, best."""
    return pair_counts(aligned(docs, a, b)).select(F.shiftright("word", 32).alias("a_id"), F.col("b").alias("b_id"), "n", "best")


def weighed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (row, links, ...), counts as of pair_counts -> rows with n_best and count_sum instead of links."""
    common = frequent(counts, COMMON).select("word", "n", "best").toArrow()
    order = np.argsort(words := common.column("word").to_numpy())
    sent = rows.sparkSession.sparkContext.broadcast((words[order], common.column("n").to_numpy()[order], common.column("best").to_numpy(zero_copy_only=False)[order]))
    kept = [c for c in rows.columns if c != "links"]
    rare = "array<struct<word:bigint,k:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ns, bests = sent.value
        struct = pa.list_(pa.struct([("word", pa.int64()), ("k", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                each = [x or b"" for x in batch.column("links").to_pylist()]
                of = np.repeat(np.arange(len(each)), [len(x) // 8 for x in each])
                pairs, place = np.unique(np.frombuffer(b"".join(each), "<i8"), return_inverse=True)
                spot = np.searchsorted(words, pairs)
                held = np.zeros(len(pairs), bool) if not len(words) else words[np.minimum(spot, len(words) - 1)] == pairs
                n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
                n[held], best[held] = ns[spot[held]], bests[spot[held]]
                sums = np.zeros(len(each), np.int64)
                np.add.at(sums, of, n[place])
                lost = ~held[place]
                keys, k = np.unique(np.stack((of[lost], place[lost])), axis=1, return_counts=True)
                left: list[list[dict]] = [[] for _ in each]
                for row, pair, times in zip(keys[0].tolist(), pairs[keys[1]].tolist(), k.tolist(), strict=True):
                    left[row].append({"word": pair, "k": times})
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.bincount(of, best[place], len(each)).astype(np.int64)), pa.array(sums), pa.array(left, struct)], names=[*kept, "n_best", "count_sum", "rare"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "links")
    looked = stored(rows.mapInArrow(run, f"{kinds}, n_best long, count_sum long, rare {rare}"), "weighed")
    met = looked.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").join(counts, "word")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("best_more"), F.sum(F.col("k") * F.col("n")).alias("sum_more"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return looked.join(more, "row", "left").select(*kept, plus("n_best", "best_more"), plus("count_sum", "sum_more"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(documents(spark, sf_dir))
    return weighed(rows, pair_counts(rows)).select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
