"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8, each with its own scale and quantisation error, and packed once into tiles of TILE rows.
Query tiles meet candidate tiles (the stated query set against all rows, in blocks): candidate tiles are dealt into
buckets of BUCKET tiles, and each query tile goes once to every bucket. In a pair of tiles one matrix product of the
int8 parts gives all distances between the quantised vectors exactly; by the triangle inequality a true distance
differs from that by at most the two errors. A pair survives if its lower bound does not exceed the query's k-th upper
bound, first among the tiles that a task has seen, then over all tasks. Only survivors meet the original vectors: their
distances are computed in double precision and ranked by (distance, vec_id), so the result is exact: recall is 1 by
construction. Bounds and distances are merged by heaps: a task keeps a heap of k for each query row that it meets, and the
heaps of all tasks are merged where their query row is dealt to.

Each query row has a number of its own, so rows of one vec_id are queries each.

Scale: with Q query tiles and C candidate tiles, C int8 tiles are shuffled once and Q of them C / BUCKET times; double
vectors are read once, for the join with the survivors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors of different lengths are not compared. A query's own row (its vec_id) is not a
candidate; of repeated rows each counts, as a candidate and as a query. A null vec_id takes no part. Fewer candidates than k: all of them. Components
over HUGE are not quantised: they survive and are computed with a common factor taken out. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import rows_to_batch, stored

TILE, BUCKET = 2048, 16
K = 10
#: Squares of larger components may overflow, those of smaller ones vanish.
HUGE, TINY = 1e150, 1e-150
#: Query rows whose heaps a task holds; it gives all away when it has more.
HEAPS = 20_000
TILE_TYPE = "dim int, tile long, n int, ids binary, numbers binary, parts binary, scale binary, error binary"


def good(items: list | None) -> np.ndarray | None:
    """A vector that takes part, in double precision."""
    if not items or None in items:
        return None
    v = np.array(items, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding, number) -> tiles: ids, numbers, int8 parts, scales and errors; numbered by task and place in it."""
    schema = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary()), ("parts", pa.binary()), ("scale", pa.binary()), ("error", pa.binary())])
    held: dict[int, list] = {}
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def full(dim: int) -> pa.RecordBatch:
        nonlocal number
        rows = held.pop(dim)
        number += 1
        ids, numbers, vectors = np.array([i for i, _, _ in rows], "<i8"), np.array([n for _, n, _ in rows], "<i8"), np.stack([v for _, _, v in rows])
        most = np.abs(vectors).max(axis=1)
        plain = (most < HUGE) & (most > TINY)
        scale = np.where(plain, most / 127, 1.0)
        parts = np.where(plain[:, None], np.rint(vectors / scale[:, None]), 0).astype(np.int8)
        error = np.full(len(ids), np.inf)
        error[plain] = np.sqrt(((vectors[plain] - parts[plain] * scale[plain, None]) ** 2).sum(axis=1))
        return rows_to_batch([(dim, number, len(ids), ids.tobytes(), numbers.tobytes(), parts.tobytes(), scale.tobytes(), error.tobytes())], schema)

    for batch in batches:
        for vec_id, vector, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            v = good(vector.as_py())
            if vec_id is None or v is None:
                continue
            held.setdefault(len(v), []).append((vec_id, own, v))
            if len(held[len(v)]) == TILE:
                yield full(len(v))
    for dim in list(held):
        yield full(dim)


def tiles(rows: DataFrame, name: str) -> DataFrame:
    """rows (vec_id, embedding, number) -> their tiles, stored, so that numbers hold for every reader."""
    return stored(rows.select("vec_id", "embedding", "number").mapInArrow(_tiles, TILE_TYPE), name)


class Tile:
    def __init__(self, dim: int, n: int, ids: bytes, numbers: bytes, parts: bytes, scale: bytes, error: bytes):
        self.ids, self.numbers = np.frombuffer(ids, "<i8"), np.frombuffer(numbers, "<i8")
        self.parts = np.frombuffer(parts, np.int8).reshape(n, dim)
        self.scale, self.error = np.frombuffer(scale, "<f8"), np.frombuffer(error, "<f8")
        # float32 holds sums of int8 products exactly up to 2^24; longer vectors are multiplied in float64
        self.whole = self.parts.astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)
        self.square = (self.whole.astype(np.float64) ** 2).sum(axis=1) * self.scale**2


def bounds(queries: Tile, candidates: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances; infinite between a query and its own vec_id."""
    product = (queries.whole @ candidates.whole.T).astype(np.float64)
    square = queries.square[:, None] + candidates.square[None, :] - 2 * queries.scale[:, None] * candidates.scale[None, :] * product
    about = np.sqrt(np.maximum(square, 0))
    slack = queries.error[:, None] + candidates.error[None, :] + 1e-7 * np.sqrt(queries.square[:, None] + candidates.square[None, :])
    own = queries.ids[:, None] == candidates.ids[None, :]
    return np.where(own, np.inf, about - slack), np.where(own, np.inf, about + slack)


def survivors(pairs: DataFrame, k: int) -> DataFrame:
    """pairs (dim, q, a, b: structs of a query tile and a candidate tile) -> query (its row's number), vec_id, lower, upper."""
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best, kept = None, None, None, []

        def out() -> pa.RecordBatch:
            row, ids, lower, upper = (np.concatenate(x) for x in zip(*kept, strict=True))
            alive = lower <= best[:, -1][row]
            return pa.RecordBatch.from_arrays([pa.array(x[alive]) for x in (asked.numbers[row], ids, lower, upper)], schema=schema)

        for pair in (r for batch in batches for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
            if now != (pair["dim"], pair["q"]):
                if kept:
                    yield out()
                now, asked, kept = (pair["dim"], pair["q"]), Tile(pair["dim"], **pair["a"]), []
                best = np.full((len(asked.ids), k), np.inf)  # the k least upper bounds so far, the largest last
            held = Tile(pair["dim"], **pair["b"])
            lower, upper = bounds(asked, held)
            best = np.partition(np.concatenate((best, upper), axis=1), k - 1, axis=1)[:, :k]
            row, col = np.nonzero((lower <= best[:, -1:]) & (lower < np.inf))
            kept.append((row, held.ids[col], lower[row, col], upper[row, col]))
        if kept:
            yield out()

    return pairs.mapInArrow(run, "query long, vec_id long, lower double, upper double")


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Euclidean; where squares would overflow or vanish, of the vectors divided by their largest component."""
    most = max(np.abs(a).max(), np.abs(b).max())
    if TINY < most < HUGE:
        return float(np.sqrt(((a - b) ** 2).sum()))
    return float(np.sqrt(((a / most - b / most) ** 2).sum()) * most)


def measured(pairs: DataFrame) -> DataFrame:
    """pairs (query, vec_id, a, b: the original vectors) -> query, vec_id, score."""
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, vec_id, a, b in zip(*(batch.column(n) for n in ("query", "vec_id", "a", "b")), strict=True):
                x, y = good(a.as_py()), good(b.as_py())
                if x is not None and y is not None and len(x) == len(y):
                    rows.append((query.as_py(), vec_id.as_py(), distance(x, y)))
            yield rows_to_batch(rows, schema)

    return pairs.select("query", "vec_id", "a", "b").mapInArrow(run, "query long, vec_id long, score double")


class Heaps:
    """For each query row the k nearest so far, the farthest of them on top."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def put(self, query: int, score: float, vec_id: int) -> None:
        heap, one = self.of.setdefault(query, []), (-score, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, one)
        elif one > heap[0]:
            heapq.heapreplace(heap, one)

    def give(self) -> list[tuple[int, int, int, float]]:
        """(query, rank, vec_id, score) of all, nearest first; nothing is held after."""
        held, self.of = self.of, {}
        return [(query, rank, -vec_id, -score) for query, heap in held.items() for rank, (score, vec_id) in enumerate(sorted(heap, reverse=True), 1)]


def merged(rows: DataFrame, k: int) -> DataFrame:
    """rows (query, vec_id, score) -> query, rank (from 1), vec_id, score: the k nearest of each query row."""
    schema = pa.schema([("query", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch], together: bool) -> Iterator[pa.RecordBatch]:
        heaps, last = Heaps(k), None
        for batch in batches:
            for query, vec_id, score in zip(*(batch.column(n).to_pylist() for n in ("query", "vec_id", "score")), strict=True):
                if (query != last if together else query not in heaps.of) and len(heaps.of) >= HEAPS:
                    yield rows_to_batch(heaps.give(), schema)
                heaps.put(query, score, vec_id)
                last = query
        yield rows_to_batch(heaps.give(), schema)

    kinds = "query long, rank int, vec_id long, score double"
    each = rows.select("query", "vec_id", "score").mapInArrow(lambda batches: run(batches, False), kinds)
    return each.repartition("query").sortWithinPartitions("query").mapInArrow(lambda batches: run(batches, True), kinds)


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """queries, candidates (vec_id, embedding) -> query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    plain = lambda rows: rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull())
    queries, candidates = stored(plain(queries).withColumn("number", F.monotonically_increasing_id()), "queries"), plain(candidates)
    asked = tiles(queries.repartition(1 + queries.count() // TILE), "query_tiles")
    held = tiles(candidates.withColumn("number", F.lit(0).cast("long")), "tiles")
    buckets = 1 + held.count() // BUCKET
    tile = lambda name: F.struct("n", "ids", "numbers", "parts", "scale", "error").alias(name)
    left = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.col("tile").alias("q"), tile("a"))
    right = held.select("dim", F.pmod(F.xxhash64("tile"), F.lit(buckets)).cast("int").alias("bucket"), tile("b"))
    found = stored(survivors(left.join(right, ["dim", "bucket"]).select("dim", "q", "a", "b"), k), "survivors")
    limit = merged(found.withColumnRenamed("upper", "score"), k).where(F.col("rank") == k).select("query", F.col("score").alias("limit"))
    alive = found.join(limit, "query", "left").where(F.col("limit").isNull() | (F.col("lower") <= F.col("limit"))).select("query", "vec_id").distinct()
    asking = queries.select(F.col("number").alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"))
    exact = measured(alive.join(candidates.withColumnRenamed("embedding", "b"), "vec_id").join(asking.drop("query_id"), "query"))
    return merged(exact, k).join(asking.drop("a"), "query").select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows.where(F.col("vec_id") % 100 == 0), rows)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS number, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score, vec_id)::INT AS rank FROM d
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
