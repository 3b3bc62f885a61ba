"""Centroid clustering by sort-means.

Vectors are turned into integers, floor(SCALE * x), and everything after that is exact. In each round the driver sorts,
for each centroid, the other centroids by their distance from it (K squared numbers). A vector is first measured against
the centroid it was assigned to, then against the others in that order, until one is strictly farther from the old
centroid than twice the vector's distance from it: by the triangle inequality no later one can be as near. Vectors of
one old assignment are scanned together, the farthest first, so that those still searching are always the first ones.
Strictness keeps ties, which go to the smaller number.

Scale: a round is one map over the vectors, which writes vectors with their assignments; each task adds the sums of its
vectors by centroid in the same pass, in columns that are read back alone. Sums are added up in Spark, at most K rows
reach the driver. Nothing is shuffled but those sums; no group is one task's.

Defined cases: vectors that are null, hold null or non-finite components or have another number of components take no
part. A null vec_id takes part, its digits being the empty string. Repeated rows count each; seeds of one hash go by
their components. Fewer vectors than k: as many centroids as vectors; none: an empty result. Empty clusters keep their
centroid. Components beyond 2^27 are computed with Python's integers; a distance or sum of distances that no long can hold
is null, and a mean whose sum has over 38 digits leaves its centroid. Integers, not floats, are compared everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import rows_to_batch, stored

DIM, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Below this, squared distances of vectors of up to 128 components fit a long.
SAFE = 1 << 27
LONG = 1 << 63
#: Vectors that are measured at once.
PART = 8192


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles: longs where all are below SAFE, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * SCALE)
    if (np.abs(scaled) < SAFE).all():
        return scaled.astype(np.int64)
    whole = lambda x: int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE))  # noqa: E731  doubles that large are whole
    return np.array([[whole(x) for x in v] for v in vectors.tolist()], object)


def measured(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances."""
    apart = vectors - centroid
    return (apart * apart).sum(axis=1)


class Centroids:
    """Centroids, squared distances between them and, for each, the others from the nearest to the farthest."""

    def __init__(self, rows: list[list[int]]):
        plain = all(abs(x) < SAFE for r in rows for x in r)
        self.rows = np.array(rows, np.int64 if plain else object).reshape(len(rows), -1)
        self.apart = np.array([measured(self.rows, c) for c in self.rows])
        self.order = [sorted((j for j in range(len(rows)) if j != i), key=lambda j, i=i: (self.apart[i][j], j)) for i in range(len(rows))]

    def assign(self, vectors: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector, the nearest centroid and the squared distance from it. old: where each was before."""
        if vectors.dtype != self.rows.dtype:
            vectors = vectors.astype(object)
        cluster, distance = old.copy(), np.zeros(len(vectors), vectors.dtype)
        for c in np.unique(old).tolist():
            mine = np.flatnonzero(old == c)
            first = measured(vectors[mine], self.rows[c])
            down = np.argsort(-first, kind="stable")
            mine, first = mine[down], first[down]
            rows, best, least = vectors[mine], np.full(len(mine), c), first.copy()
            reach = -4 * first  # ascending; an apart of over 4 * first is over twice the distance
            for j in self.order[c]:
                n = int(np.searchsorted(reach, -self.apart[c][j], "right"))
                if not n:
                    break
                d = measured(rows[:n], self.rows[j])
                better = (d < least[:n]) | ((d == least[:n]) & (j < best[:n]))
                best[:n][better], least[:n][better] = j, d[better]
            cluster[mine], distance[mine] = best, least
        return cluster, distance


ASSIGNED = "vec_id long, embedding array<double>, cluster int, distance decimal(38,0), center int, sums array<decimal(38,0)>"
_NUMBER = pa.decimal128(38, 0)
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("cluster", pa.int32()), ("distance", _NUMBER), ("center", pa.int32()), ("sums", pa.list_(_NUMBER))])


def _held(x: int) -> Decimal | None:
    return Decimal(x) if abs(x) < 10**38 else None


def assigned(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """rows (vec_id, embedding, cluster) -> the same with new clusters and distances (center is null); and for each task and
    center: sums, the number of vectors, the sum of their distances, and those of their components (vec_id and cluster are null)."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                ids, vectors, old = batch.slice(at, PART).columns
                whole = integers(np.array(vectors.flatten()).reshape(len(vectors), -1))
                cluster, distance = held.assign(whole, np.array(old))
                for c in np.unique(cluster).tolist():
                    mine = cluster == c
                    more = [int(mine.sum()), int(distance[mine].sum()), *whole[mine].sum(axis=0).tolist()]
                    sums[c] = [a + b for a, b in zip(sums[c], more, strict=True)] if c in sums else more
                none = lambda kind, n=len(ids): pa.nulls(n, kind)
                fits = pa.array([_held(d) for d in distance.tolist()], _NUMBER)
                yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(cluster, pa.int32()), fits, *(none(f.type) for f in list(_SCHEMA)[4:])], schema=_SCHEMA)
        yield rows_to_batch([(None, None, None, None, c, [_held(x) for x in each]) for c, each in sorted(sums.items())], _SCHEMA)

    return stored(rows.select("vec_id", "embedding", "cluster").mapInArrow(run, ASSIGNED), "assigned")


def collected(table: DataFrame) -> dict[int, list[int | None]]:
    """The sums of all tasks for each cluster that has vectors; None where one does not fit."""
    each = table.where(F.col("center").isNotNull()).select("center", F.posexplode("sums").alias("at", "part"))
    total = F.when(F.count("part") == F.count("*"), F.sum("part")).alias("total")
    found: dict[int, list[int | None]] = {}
    for r in each.groupBy("center", "at").agg(total).orderBy("center", "at").collect():  # k centroids, their components and two
        found.setdefault(r["center"], []).append(None if r["total"] is None else int(r["total"]))
    return found


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vectors (vec_id, embedding) -> those that take part, in double precision."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where((F.size("embedding") == dim) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """Integers of the k vectors with the smallest hashes of `seed:vec_id`."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name, 256), "embedding").limit(k).select("embedding").collect()
    return [[int(x) for x in integers(np.array([r["embedding"]], np.float64))[0]] for r in rows]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, list[list[int]], dict[int, list]]:
    """vectors (vec_id, embedding) -> (vec_id, embedding, cluster, distance), the centroids, and the sums of the clusters, as `collected` has them."""
    kept = usable(vectors, dim)
    centroids = seeds(kept, k, seed)
    if not centroids:
        return kept.select("vec_id", "embedding", F.lit(0).alias("cluster"), F.lit(0).cast("decimal(38,0)").alias("distance")), [], {}
    rows = kept.withColumn("cluster", F.lit(0))
    for _ in range(rounds):
        rows = assigned(rows, Centroids(centroids))
        for c, (n, _, *sums) in collected(rows).items():
            if None not in sums:
                centroids[c] = [s // n for s in sums]
        rows = rows.where(F.col("center").isNull())
    rows = assigned(rows, Centroids(centroids))
    return rows.where(F.col("center").isNull()).select("vec_id", "embedding", "cluster", "distance"), centroids, collected(rows)


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids, groups = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    spreads = {c: spread for c, (_, spread, *_) in groups.items()}
    fits = lambda x: x if x is not None and x < LONG else None
    total = None if None in spreads.values() else sum(spreads.values())
    known = [(c, fits(spread), fits(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, spread in spreads.items()]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def _oracle() -> str:
    near = """{a} AS MATERIALIZED (
  SELECT r, id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT r, id, v, c.k, list_sum(list_transform(list_zip(v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vectors CROSS JOIN {c} c) GROUP BY r, id, v)"""
    mean = """{n} AS MATERIALIZED (
  SELECT o.k, coalesce(m.c, o.c) AS c FROM {c} o LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(len(v))) AS i FROM {a}) GROUP BY k, i) GROUP BY k) m USING (k))"""
    parts = [
        f"""vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{SEED}:' || coalesce(id::VARCHAR, '')) AS h, v FROM vectors) ORDER BY h, v LIMIT {K})""",
    ]
    for i in range(ROUNDS):
        parts += [near.format(a=f"a{i}", c=f"c{i}"), mean.format(n=f"c{i + 1}", c=f"c{i}", a=f"a{i}")]
    parts.append(near.format(a="last", c=f"c{ROUNDS}"))
    return f"""WITH {", ".join(parts)}
SELECT id AS vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} USING (k)"""


ORACLE_SQL = _oracle()
