"""A hidden Markov language model, trained by Baum-Welch over partitions.

A-Z are lower-cased in the whole text; tokens are the words `[^\\x20\\x09-\\x0D]+` and one end, a token like any
other. The VOCABULARY most common training words are symbols of their own. Any other word is emitted as one of
CLASSES classes by its last two bytes, and within the class by (c + 0.5) / (n + 0.5 (v + 1)), c, n and v being the
counts of the word, the class's tokens and its distinct words in training. So every word has a probability.

Each Baum-Welch round reads all training texts: tasks run forward and backward over many texts at once and send the
expected counts of what they have met, Spark sums them by symbol, and the driver (VOCABULARY + CLASSES rows of
STATES numbers, whatever the input) sets the new parameters. A text's score is the exact likelihood by the scaled
forward recursion, of texts of any length.

Counts of all words stay in a table, a word of over WORD_BYTES bytes by its digest, so that a long word that is very
common is one of the common ones like any other; only the COMMON most common go to the tasks. A text's other words are
joined with the table and their terms are summed by text, which is exact: both scores are sums over tokens.

Defined cases: null and empty texts are the end alone. A null doc_id is trained on and not held out. Without any
training text all counts are 0 and every word is unknown. Repeated rows are scored each. Each training text is one
sequence, however long.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, frequent, rows_to_batch, slices, stored

STATES, ROUNDS = 6, 4
VOCABULARY, CLASSES, COMMON, WORD_BYTES = 50_000, 64, 300_000, 64
#: Tokens that a task trains on or scores at once; distinct words that it counts before it sends them on.
TRAINED, SCORED, KEPT = 400_000, 1_500_000, 300_000
#: A text of more tokens is long; texts of up to so many train together, and so do all of twice LONG and more.
LONG, SHORT = 2048, 255
END = 0
STICKY, PRIOR = 0.9, 5.0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def key(word: bytes) -> bytes:
    """What a word is counted by: itself, or if it is longer than WORD_BYTES a byte that begins no word, a digest and its last two bytes."""
    return word if len(word) <= WORD_BYTES else b"\xff" + hashlib.blake2b(word, digest_size=20).digest() + word[-2:]


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


class Symbols(dict):
    """Symbols of words; of a word without one, its class. END is symbol 0."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__({w: k + 1 for k, w in enumerate(vocabulary)})
        self.first_class = len(vocabulary) + 1

    def __missing__(self, word: bytes) -> int:
        if len(word) > WORD_BYTES and (symbol := self.get(key(word))):
            return symbol
        return self.first_class + word_class(word)

    def read(self, words: list[bytes]) -> np.ndarray:
        return np.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)), np.int32(END))


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # symbol x state


class Texts:
    """Sequences of symbols, the longest first, laid out step by step: step t holds the t-th symbols of the first `many[t]`
    sequences and begins at `begins[t]`."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        own = [sequences[i] for i in self.order]
        self.lengths = np.array([len(s) for s in own])
        self.many = np.searchsorted(-self.lengths, -np.arange(self.lengths[0]), side="left")
        self.begins = np.concatenate(([0], np.cumsum(self.many)[:-1]))
        starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        #: For each place the sequence that it belongs to.
        self.which = np.arange(self.lengths.sum()) - np.repeat(self.begins, self.many)
        self.symbols = np.concatenate(own)[starts[self.which] + np.repeat(np.arange(len(self.many)), self.many)]
        self.spans = list(zip(self.begins.tolist(), (self.begins + self.many).tolist(), strict=True))


def forward(model: Model, texts: Texts, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
    """Log10 likelihood of each sequence (in the order of Texts); if kept, emissions and scaled forward values (state x place); the scales."""
    emits, back = np.ascontiguousarray(model.emits.T), np.ascontiguousarray(model.moves.T)
    scales = np.empty(len(texts.symbols))
    seen = emits.take(texts.symbols, axis=1) if keep else None
    alphas = np.empty_like(seen) if keep else None
    alpha = np.broadcast_to(model.start[:, None], (len(model.start), len(texts.lengths)))
    for t, (a, z) in enumerate(texts.spans):
        here = seen[:, a:z] if keep else emits.take(texts.symbols[a:z], axis=1)
        alpha = (back @ alpha[:, : z - a] if t else alpha) * here
        scale = alpha.sum(axis=0, out=scales[a:z])
        if keep:
            alpha = np.divide(alpha, scale, out=alphas[:, a:z])
        else:
            alpha /= scale
    return np.bincount(texts.which, np.log10(scales), len(texts.lengths)), seen, alphas, scales


def expected(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of start states, moves, and emissions (symbol x state)."""
    _, seen, alphas, scales = forward(model, texts, keep=True)
    seen /= scales
    ahead = np.ones_like(alphas)  # beta; it stays 1 where a sequence ends
    moves, spans = np.zeros_like(model.moves), texts.spans
    for (a, _), (b, z) in zip(spans[-2::-1], spans[:0:-1], strict=True):
        later = seen[:, b:z]
        later *= ahead[:, b:z]
        np.matmul(model.moves, later, out=ahead[:, a : a + z - b])
        moves += alphas[:, a : a + z - b] @ later.T
    gamma = np.multiply(alphas, ahead, out=alphas)
    emits = np.stack([np.bincount(texts.symbols, g, len(model.emits)) for g in gamma], axis=1)
    return gamma[:, : texts.many[0]].sum(axis=1), model.moves * moves, emits


def count_words(docs: DataFrame) -> DataFrame:
    """docs (text) -> word binary (its key), n."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        sent = lambda: pa.RecordBatch.from_arrays([pa.array(map(key, seen), pa.binary()), pa.array(seen.values(), pa.int64())], schema=schema)
        for cols in slices(batches):
            for text in cols["text"]:
                seen.update(words_of(text))
            if len(seen) > KEPT:
                yield sent()
                seen.clear()
        yield sent()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gathered(sequences: Iterator[np.ndarray]) -> Iterator[Texts]:
    """Sequences of like length together: a batch takes as many steps as its longest has tokens. None is cut."""
    held: dict[int, list[np.ndarray]] = {}
    size: dict[int, int] = {}
    for s in sequences:
        k = min(max(len(s), SHORT), 2 * LONG).bit_length()
        held.setdefault(k, []).append(s)
        size[k] = size.get(k, 0) + len(s)
        if size[k] >= TRAINED:
            yield Texts(held.pop(k))
            size[k] = 0
    yield from map(Texts, held.values())


def first_model(symbol_counts: np.ndarray, states: int) -> Model:
    """States that keep to themselves; emissions as counted, each state with its own fixed disturbance."""
    noise = np.random.default_rng(7).uniform(0.3, 1.7, (len(symbol_counts), states))
    emits = (symbol_counts + 0.5)[:, None] * noise
    moves = np.full((states, states), (1 - STICKY) / max(1, states - 1))
    np.fill_diagonal(moves, STICKY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(axis=0))


def train(docs: DataFrame, vocabulary: list[bytes], symbol_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """docs (text); symbol_counts: training tokens of each symbol. Texts are read once; rounds read their symbols."""
    spark = docs.sparkSession
    model, names = first_model(symbol_counts, states), spark.sparkContext.broadcast(vocabulary)
    unigram = (symbol_counts + 0.5) / (symbol_counts + 0.5).sum()
    schema = pa.schema([("symbol", pa.int32()), ("state", pa.list_(pa.float64()))])
    begin, move = -1, -2

    def symbols_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(names.value)
        for cols in slices(batches):
            yield rows_to_batch([(symbols.read(words_of(text)).tobytes(),) for text in cols["text"]], pa.schema([("symbols", pa.binary())]))

    read = stored(docs.select("text").mapInArrow(symbols_of, "symbols binary"), "symbols")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            emits, moves, starts = np.zeros_like(own.emits), np.zeros_like(own.moves), np.zeros(states)

            def sequences() -> Iterator[np.ndarray]:
                for cols in slices(batches):
                    yield from (np.frombuffer(raw, np.int32) for raw in cols["symbols"])

            for texts in gathered(sequences()):
                a, b, c = expected(own, texts)
                starts += a
                moves += b
                emits += c
            met = np.flatnonzero(emits.any(axis=1))
            rows = [(begin, starts.tolist()), *((move - i, m.tolist()) for i, m in enumerate(moves))] if len(met) else []
            yield rows_to_batch(rows, schema)
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, states * len(met) + 1, states, dtype=np.int32)), pa.array(emits[met].ravel()))], schema=schema)

        counts = read.mapInArrow(run, "symbol int, state array<double>")
        sums = counts.groupBy("symbol").agg(*[F.sum(F.get("state", F.lit(s))).alias(f"s{s}") for s in range(states)]).toArrow()
        if not sums.num_rows:
            break
        which, values = sums["symbol"].to_numpy(), np.stack([sums[f"s{s}"].to_numpy() for s in range(states)], axis=1)
        emits = np.zeros((len(symbol_counts), states))
        emits[which[which >= 0]] = values[which >= 0]
        emits += PRIOR * unigram[:, None]
        moves = np.full((states, states), 1e-3)
        for i, row in zip(which, values, strict=True):
            if i <= move:
                moves[move - i] += row
        start = 1e-3 + values[which == begin][0]
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
        shared.unpersist()
    return model


def score(docs: DataFrame, training: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text), training (text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = stored(count_words(training), "word_counts")
    n_texts = training.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = totals[0] + n_texts, totals[1] + (n_texts > 0)
    common = {bytes(w): c for w, c in zip(*(col.to_pylist() for col in frequent(counts, COMMON).select("word", "n").toArrow().columns), strict=True)}
    vocabulary = sorted(common, key=lambda w: (-common[w], w))[:VOCABULARY]
    first = len(vocabulary) + 1
    suffix = F.substring(F.col("word"), F.greatest(F.octet_length("word") - 1, F.lit(1)), F.lit(2))
    own = {r[0]: (r[1], r[2]) for r in counts.groupBy((F.crc32(suffix) % CLASSES).cast("int").alias("class")).agg(F.sum("n"), F.count("*")).collect()}
    in_class = np.array([own.get(k, (0, 0)) for k in range(CLASSES)], float)
    for w in vocabulary:
        in_class[word_class(w)] -= common[w], 1
    symbol_counts = np.array([n_texts, *(common[w] for w in vocabulary), *in_class[:, 0]], float)
    model = train(training, vocabulary, symbol_counts, states, rounds)
    shared = spark.sparkContext.broadcast((model, vocabulary, common))
    base_total, class_total = n + 0.5 * (v + 1), in_class[:, 0] + 0.5 * (in_class[:, 1] + 1)
    schema = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary, common = shared.value
        symbols, row = Symbols(vocabulary), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        known_base = np.log10((np.concatenate(([n_texts], [common[w] for w in vocabulary])) + 0.5) / base_total) if vocabulary else np.log10([(n_texts + 0.5) / base_total])
        seen = np.concatenate(([n_texts > 0], np.ones(len(vocabulary), bool)))
        short, long = [], []  # a batch takes as many steps as its longest text has tokens: long ones wait for each other

        def done(held: list[tuple]) -> pa.RecordBatch:
            nonlocal row
            texts = Texts([h[1] for h in held])
            logs = np.empty(len(held))
            logs[texts.order] = forward(model, texts)[0]
            rows = []
            for (doc_id, read, n_known, base, within, rest), value in zip(held, logs.tolist(), strict=True):
                rows.append((row, doc_id, len(read), n_known, base, value + within, list(rest), list(rest.values())))
                row += 1
            held.clear()
            return rows_to_batch(rows, schema)

        sizes = [0, 0]
        for cols in slices(batches):
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                words = words_of(text)
                read = symbols.read(words)
                plain = read[read < first]
                base, n_known, within, rest = float(known_base[plain].sum()), int(seen[plain].sum()), 0.0, {}
                for word, times in Counter([words[i] for i in np.flatnonzero(read >= first)]).items():
                    at = key(word)
                    c = common.get(at)
                    if c is None:
                        rest[at] = times
                    else:
                        base += times * log10((c + 0.5) / base_total)
                        within += times * log10((c + 0.5) / class_total[word_class(at)])
                        n_known += times
                is_long = len(read) > LONG
                held = long if is_long else short
                held.append((doc_id, read, n_known, base, within, rest))
                sizes[is_long] += len(read)
                if sizes[is_long] >= SCORED:
                    yield done(held)
                    sizes[is_long] = 0
        yield from map(done, filter(None, (short, long)))

    part = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, doc_id long, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<long>"), "scored")
    rest = part.select("id", F.inline(F.arrays_zip(F.col("words").alias("word"), "times"))).join(counts, "word", "left")
    c, times = F.coalesce("n", F.lit(0)), F.col("times")
    totals_by_class = F.array(*[F.lit(float(x)) for x in class_total])
    more = rest.groupBy("id").agg(
        F.sum(F.when(F.col("n").isNotNull(), times).otherwise(0)).alias("more_known"),
        F.sum(times * F.log10((c + 0.5) / base_total)).alias("more_base"),
        F.sum(times * F.log10((c + 0.5) / F.get(totals_by_class, (F.crc32(suffix) % CLASSES).cast("int")))).alias("more_score"),
    )
    plus = lambda name: F.coalesce(F.col(name), F.lit(0))
    return part.drop("words", "times").join(more, "id", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + plus("more_known")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + plus("more_base")).alias("base_score"), (F.col("score") + plus("more_score")).alias("score"),
    )


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, docs.where(~held_out())).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
