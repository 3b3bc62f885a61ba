"""Candidates to edges. A candidate is (repo_id, source, target, type_ord, conf_rank, file, line, detail, ordinal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.functions.labels import EDGE_TYPES

EVIDENCE = 25
KEY = ("repo_id", "source", "target", "type_ord")
HTTP, EVENT, GRPC, DATABASE, IMPORT = range(len(EDGE_TYPES))


def fold_http_into_grpc(candidates: DataFrame) -> DataFrame:
    """Where a pair has gRPC evidence, its http evidence counts for that edge, but not for its confidence.

    One window over the pair: no self-join, and the pair's key is a prefix of the merge's."""
    pair = Window.partitionBy("repo_id", "source", "target")
    has_grpc = F.max(F.when(F.col("type_ord") == GRPC, 1).otherwise(0)).over(pair) == 1
    moved = has_grpc & (F.col("type_ord") == HTTP)
    return candidates.select(
        *[c for c in candidates.columns if c not in ("type_ord",)],
        F.when(moved, F.lit(GRPC)).otherwise(F.col("type_ord")).alias("type_ord"),
        F.when(~moved, F.col("conf_rank")).alias("own_rank"),
    )


def merge_edges(candidates: DataFrame, cap: int = EVIDENCE) -> DataFrame:
    """One edge for each (repo, source, target, type): the best confidence, the number of distinct pieces of evidence and
    the `cap` strongest of them. A piece seen twice keeps the rank it was first seen with. Self-edges go."""
    rows = fold_http_into_grpc(candidates.where(F.col("source") != F.col("target")))
    first = rows.groupBy(*KEY, "file", "line", "detail").agg(F.min_by("conf_rank", "ordinal").alias("rank"), F.max("own_rank").alias("own_rank"))
    strongest = Window.partitionBy(*KEY).orderBy(F.desc("rank"), F.asc("file"), F.asc_nulls_first("line"), F.asc_nulls_first("detail"))
    ranked = first.withColumn("pos", F.row_number().over(strongest))
    piece = F.struct("pos", F.struct("file", "line", "detail").alias("evidence"))
    return ranked.groupBy(*KEY).agg(
        F.max("own_rank").alias("conf_rank"), F.count("*").alias("n_evidence"),
        F.array_sort(F.collect_list(F.when(F.col("pos") <= cap, piece)))["evidence"].alias("evidence"),
    )


def edge_ranks(candidates: DataFrame) -> DataFrame:
    """The edges of merge_edges with their confidence, without evidence: repo_id, source, target, type_ord, conf_rank. A pair's
    candidates become one row, so that neither files nor lines are shuffled."""
    of = lambda t: F.max(F.when(F.col("type_ord") == t, F.coalesce("conf_rank", F.lit(-1)))).alias(f"t{t}")
    pairs = candidates.where(F.col("source") != F.col("target")).groupBy("repo_id", "source", "target").agg(*[of(t) for t in range(len(EDGE_TYPES))])
    http = F.when(F.col(f"t{GRPC}").isNull(), F.col(f"t{HTTP}"))
    each = F.array(*[F.struct(F.lit(t).alias("type_ord"), (http if t == HTTP else F.col(f"t{t}")).alias("rank")) for t in range(len(EDGE_TYPES))])
    edges = pairs.select("repo_id", "source", "target", F.inline(F.filter(each, lambda e: e["rank"].isNotNull())))
    return edges.select("repo_id", "source", "target", "type_ord", F.nullif("rank", F.lit(-1)).alias("conf_rank"))


def prefixes(path: Column, separator: str = "/") -> Column:
    """Every beginning of a path that ends at a separator, the path itself included."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def owners(files: DataFrame, services: DataFrame, single: bool) -> DataFrame:
    """files (repo_id, file), services (repo_id, name, root, role) -> repo_id, file, service.

    single: the longest root of a code service, then the first name; else every service of the longest root, whatever
    its role. Beginnings of the path are joined by equality, so no file is compared with every root."""
    roots = services.where(F.col("root").isNotNull() & ((F.col("role") == "code") | F.lit(not single))).select("repo_id", "root", F.col("name").alias("service"))
    begun = files.select("repo_id", "file", F.explode(F.concat(F.array(F.lit(".")), prefixes(F.col("file")))).alias("root"))
    found = begun.join(roots, ["repo_id", "root"]).withColumn("len", F.when(F.col("root") == ".", 1 if single else 0).otherwise(F.octet_length("root")))
    longest = Window.partitionBy("repo_id", "file").orderBy(F.desc("len"), *(["service"] if single else []))
    place = F.row_number() if single else F.rank()
    return found.withColumn("place", place.over(longest)).where(F.col("place") == 1).select("repo_id", "file", "service")
