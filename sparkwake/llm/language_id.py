"""Language ID by rank-order profiles.

A text is lower-cased; letters stay, any other run becomes one word boundary. Its 1- to 3-grams of letters
(boundaries included, none across words) are counted over the whole text and the most frequent PROFILE_SIZE
are ranked, ties in code point order. A language profile is the same ranking over the training texts. The
predicted language has the least out-of-place distance: the sum of rank differences, PROFILE_SIZE for an
n-gram that the profile lacks; ties go to the name that sorts first.

Training reads every labelled text, and every text is predicted.

Defined cases: null text, or one without a letter: `und`, score 0. No labelled text at all: `und`. A null
lang is not trained on. A null doc_id is not held out. Repeated rows give repeated results. Texts of any
length are read whole, PIECE code points at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, rows_to_batch, slices, stored

PROFILE_SIZE = 300
PIECE = 1 << 18
UNKNOWN = "und"
#: The pipeline's stage: the percentile of the labelled texts' scores by which the least score is set, and its share.
LOW, SHARE = 0.01, 0.7
#: Parts of the range of scores by which a percentile is looked for.
BINS = 10_000
EDGE = 1


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, 21 bits a code point, and their counts."""
    parts, at, text = [], 0, text.lower()
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end].isalpha():  # words stay whole
            end += 1
        code = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.concatenate(([EDGE], np.where(letters()[code], code, EDGE), [EDGE]))
        code = code[np.concatenate(([True], (code[1:] != EDGE) | (code[:-1] != EDGE)))]
        if len(code) > 2:
            two = code[:-1] << 21 | code[1:]
            three = (two[:-1] << 21 | code[2:])[code[1:-1] != EDGE]
            parts.append(np.unique(np.concatenate((code[code != EDGE], two, three)), return_counts=True))
        at = end
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def ranking(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return grams[np.lexsort((grams, -counts))[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for cols in slices(batches):
        for text, lang in zip(cols["text"], cols["lang"], strict=True):
            got = ngrams(text)
            held.setdefault(lang, []).append(got)
            size[lang] = size.get(lang, 0) + len(got[0])
            if size[lang] > 1 << 20:
                held[lang] = [merged(held[lang])]
                size[lang] = 0
    for lang, parts in held.items():
        grams, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], schema=schema)


def fit(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Profiles by language from all rows (text, lang) of docs; at most `size` n-grams for each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    ranks = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return dict(sorted(profiles.items()))


class Profiles:
    """Profiles laid out for many look-ups: their n-grams in order, and each language's rank of each."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = list(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(profiles), len(self.grams) + 1), -1, np.int64)
        for row, grams in zip(self.ranks, profiles.values(), strict=True):
            row[np.searchsorted(self.grams, np.array(grams, np.int64))] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranking(*ngrams(text), self.size) if text and self.langs else ()
        if not len(grams):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, grams)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != grams] = len(self.grams)
        found = self.ranks[:, at]
        far = np.where(found < 0, self.size, np.abs(found - np.arange(len(grams)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(grams)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score. The profiles go to the tasks: size n-grams a language."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for cols in slices(batches):
            yield rows_to_batch([(i, *model.predict(t)) for i, t in zip(cols["doc_id"], cols["text"], strict=True)], schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def percentile(counts: DataFrame, share: float) -> float | None:
    """counts (score, n) -> the least score that `share` of the rows do not exceed, exactly; None without rows. Scores are
    fractions of PROFILE_SIZE denominators, PROFILE_SIZE squared at most: the driver sees BINS rows, then under 2000 of one bin."""
    place = F.floor(F.col("score") * BINS)
    bins = counts.groupBy(place.alias("place")).agg(F.sum("n").alias("n")).orderBy("place").collect()
    rest = max(1, ceil(round(share * sum(b["n"] for b in bins), 6)))
    for b in bins:
        if rest <= b["n"]:
            for r in counts.where(place == b["place"]).orderBy("score").collect():
                rest -= r["n"]
                if rest <= 0:
                    return r["score"]
        rest -= b["n"]
    return None


def least_score(docs: DataFrame, profiles: dict[str, list[int]]) -> float:
    """docs: labelled texts that were not trained on -> SHARE of the LOW percentile of all their scores; 0 without any. Below it a text is like no profile."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    scores = predict(rows, profiles).where(F.col("lang_pred") != UNKNOWN)
    return SHARE * (percentile(stored(scores.groupBy("score").agg(F.count("*").alias("n")), "scores"), LOW) or 0.0)


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter, or whose score is under the least, go; the others stay as they are, and all do if there is no profile."""
    training = docs.where(~held_out())
    profiles = fit(training)
    if not profiles:
        return docs
    least = least_score(docs.where(held_out()), profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, PROFILE_SIZE)
        for batch in batches:
            found = (model.predict(t.as_py()) for t in batch.column("text"))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
