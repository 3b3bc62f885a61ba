"""The most similar service of names that equality leaves, without a look at every pair's letters.

Names and services of a repository are dealt into tiles, and tiles meet. A tile's names are rows of a matrix that counts bytes
(a column for the first occurrence of a byte, one for the second, ...), so one product gives for all pairs of two tiles how many
bytes can match at most. That bounds the similarity; pairs that can reach the threshold, with the beginning that they really
share, are scored. The bound is never under the score, so no pair is lost."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwake.functions.scalars import BOOSTED, jaro_winkler

#: Names of a tile, rows of a product at once, columns of a matrix.
TILE, BLOCK, COLUMNS = 8192, 512, 256
#: What rounding may take from a bound.
SLACK = 1e-4


def _tokens(names: list[bytes]) -> list[list[int]]:
    """Of each name its bytes, each with the number of its occurrence."""
    found = []
    for name in names:
        seen: Counter = Counter()
        own = []
        for x in name:
            own.append(x << 32 | seen[x])
            seen[x] += 1
        found.append(own)
    return found


def _matrix(tokens: list[list[int]], column: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(tokens), len(column)), np.float32)
    for n, own in enumerate(tokens):
        for t in own:
            if (c := column.get(t)) is not None:
                out[n, c] = 1
    return out


def _begins(names: list[bytes], codes: dict[bytes, int]) -> np.ndarray:
    """A number for the first one to four bytes of each name; shorter ones have none that another shares."""
    return np.array([[codes.setdefault(n[:k], len(codes)) if len(n) >= k else -1 for k in range(1, 5)] for n in names], np.int64).reshape(len(names), 4)


def _least(threshold: float, same: np.ndarray | int) -> np.ndarray | float:
    """The least Jaro similarity that a shared beginning can lift to the threshold."""
    return np.minimum(threshold, np.maximum(BOOSTED, (threshold - 0.1 * same) / (1 - 0.1 * same)))


def similar_pairs(names: list[str], others: list[str], threshold: float) -> Iterator[tuple[int, int, float]]:
    """Places of each name and other of at least the threshold, with the score."""
    a, b = ([x.encode("utf-8", "surrogatepass") for x in side] for side in (names, others))
    mine, theirs = _tokens(a), _tokens(b)
    counts = Counter(t for own in theirs for t in own)
    both = sorted({t for own in mine for t in own} & counts.keys(), key=lambda t: (-counts[t], t))
    column = {t: k for k, t in enumerate(both[:COLUMNS])}
    left_out = set(both[COLUMNS:])
    rest = np.array([sum(t in left_out for t in own) for own in mine], np.float32) if left_out else np.zeros(len(a), np.float32)
    x, y = _matrix(mine, column), _matrix(theirs, column).T.copy()
    codes: dict[bytes, int] = {}
    starts, other_starts = _begins(a, codes), _begins(b, codes)
    one, two = (np.array([1 / max(1, len(n)) for n in side], np.float32) for side in (a, b))
    sure = 3 * float(_least(threshold, 4)) - 1 - SLACK
    for at in range(0, len(a), BLOCK):
        most = x[at : at + BLOCK] @ y + rest[at : at + BLOCK, None]
        i, j = np.nonzero(most * (one[at : at + BLOCK, None] + two[None, :]) >= sure)
        bound = most[i, j] * (one[at + i] + two[j])
        same = ((starts[at + i] == other_starts[j]) & (starts[at + i] >= 0)).sum(axis=1)
        near = bound >= 3 * _least(threshold, same) - 1 - SLACK
        for n, k in zip(at + i[near], j[near], strict=True):
            if (score := jaro_winkler(names[n], others[k])) >= threshold:
                yield int(n), int(k), score


def _tiles(rows: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """rows -> repo_id, {key} (the tile's number), {key}_rows: the tile's rows as an array, {key}s: how many tiles a repository has."""
    counts = rows.groupBy("repo_id").agg(F.ceil(F.count("*") / TILE).alias(f"{key}s"))
    dealt = rows.join(counts, "repo_id").withColumn(key, F.pmod(F.xxhash64(kept[0]), f"{key}s"))
    return dealt.groupBy("repo_id", key).agg(F.collect_list(F.struct(*kept)).alias(f"{key}_rows"), F.first(f"{key}s").alias(f"{key}s"))


def most_similar(names: DataFrame, services: DataFrame, threshold: float) -> DataFrame:
    """names (repo_id, norm), services (repo_id, service, pos, other) -> repo_id, norm, service, score: of the services whose `other`
    is similar to norm by the threshold at least the most similar, of equals the last."""
    one = _tiles(names.select("repo_id", "norm").distinct(), "tile", ["norm"])
    last = services.groupBy("repo_id", "other").agg(F.max(F.struct("pos", "service")).alias("last"))
    two = _tiles(last.select("repo_id", "other", "last.pos", "last.service"), "part", ["other", "pos", "service"])
    parts = two.select("repo_id", "parts").distinct()
    asked = one.join(parts, "repo_id").select("repo_id", "tile_rows", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = asked.join(two.drop("parts"), ["repo_id", "part"]).repartition(4 * names.sparkSession.sparkContext.defaultParallelism, "repo_id", "tile", "part")
    schema = pa.schema([("repo_id", pa.string()), ("norm", pa.string()), ("service", pa.string()), ("pos", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                mine, theirs = [r["norm"] for r in row["tile_rows"]], row["part_rows"]
                best: dict[int, tuple] = {}
                for n, k, score in similar_pairs(mine, [r["other"] for r in theirs], threshold):
                    pos = theirs[k]["pos"]
                    found = (score, pos is not None, pos, theirs[k]["service"])
                    best[n] = max(best.get(n, found), found)
                rows = [(row["repo_id"], mine[n], service, pos, score) for n, (score, _, pos, service) in best.items()]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    scored = met.select("repo_id", "tile_rows", "part_rows").mapInArrow(run, "repo_id string, norm string, service string, pos long, score double")
    best = scored.groupBy("repo_id", "norm").agg(F.max(F.struct("score", "pos", "service")).alias("best"))
    return best.select("repo_id", "norm", "best.service", "best.score")
