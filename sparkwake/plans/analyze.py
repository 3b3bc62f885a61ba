"""From source trees to a graph of services, and from changed files to what they reach; many repositories at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.functions.scalars import clean_path
from sparkwake.operators import discover, extract, findings, matchers, resolve, runtime_join, walk
from sparkwake.operators.edges import merge_edges, owners
from sparkwake.operators.environment import environment
from sparkwake.session import stored
from sparkwake.sources import files as source_files
from sparkwake.sources import runtime_calls


@dataclass
class Analysis:
    services: DataFrame
    edges: DataFrame  # repo_id, source, target, type_ord, conf_rank, n_evidence, evidence, calls, db_key
    stats: DataFrame

    def steps(self) -> DataFrame:
        return walk.steps(self.edges, self.services)

    def seeds(self, changes: DataFrame) -> DataFrame:
        """changes (change_id, repo_id, file) -> services changed."""
        rows = changes.withColumn("file", clean_path(F.col("file"))).distinct()
        return rows.join(owners(rows.select("repo_id", "file").distinct(), self.services, single=False), ["repo_id", "file"]).select("change_id", "repo_id", "service").distinct()

    def blast(self, changes: DataFrame, depth: int = walk.DEPTH) -> DataFrame:
        return walk.reach_paths(self.steps(), self.seeds(changes), depth)

    def inbound(self, service: str) -> DataFrame:
        return self.edges.where(F.col("target") == service)

    def outbound(self, service: str) -> DataFrame:
        return self.edges.where(F.col("source") == service)

    def edges_of(self, service: str | None = None) -> DataFrame:
        """Edges of a service, outbound first; of an unknown one, an error; of none, all edges."""
        if service is None:
            return self.edges
        if self.services.where(F.col("name") == service).isEmpty():
            raise ValueError(f"no such service: {service}")
        return findings.edges_of(self.edges, service).orderBy("side", "source", "target", "type_ord").drop("side")


def analyze(spark: SparkSession, roots: dict[str, str], include_tests: bool = False) -> Analysis:
    """roots: the folder of each repository."""
    listed = source_files.listing(spark, roots, include_tests)
    read = listed.where((extract.is_read(F.col("path")) | F.col("path").rlike(discover.CONFIG)) & (F.col("size") <= source_files.LARGEST))
    texts = stored(source_files.with_text(read.repartition(max(1, listed.count() // 200), "repo_id", "path")), "texts")
    services = stored(discover.discover(listed, texts), "services")
    owned = owners(listed.select("repo_id", F.col("path").alias("file")), services, single=True).withColumnRenamed("file", "path")
    facts = stored(extract.extract(texts.join(owned, ["repo_id", "path"])), "facts")
    own, shared = environment(texts)
    ctx = matchers.Context(services, own, shared, stored(resolve.service_keys(services), "keys"))
    found = stored(matchers.candidates(facts, ctx), "candidates")
    keys = found.where(F.col("db_key").isNotNull()).groupBy("repo_id", "source", "target", "type_ord").agg(F.min_by("db_key", "ordinal").alias("db_key"))
    edges = merge_edges(found.drop("db_key")).join(keys, ["repo_id", "source", "target", "type_ord"], "left").withColumn("calls", F.lit(None).cast("long"))
    return Analysis(services, stored(edges, "edges"), extract.mapping_stats(listed, owned))


def with_runtime(analysis: Analysis, spark: SparkSession, repo_id: str, path: str, mapped: dict[str, str] | None = None, ignored: tuple[str, ...] = ()) -> tuple[Analysis, DataFrame, DataFrame]:
    """The analysis with a file's calls joined in, the mapping of names, and the counts."""
    how, seen = runtime_calls.read(spark, path)
    rows = seen.withColumn("repo_id", F.lit(repo_id))
    names = rows.select("repo_id", F.explode(F.array_compact(F.array("client", "server"))).alias("runtime"))
    mapping = runtime_join.match_names(names, analysis.services, mapped, ignored)
    calls = runtime_join.resolved(runtime_calls.record(rows, ("repo_id",)), mapping)
    source, method = ("datadog", "datadog service_dependencies") if how == "datadog" else ("otel", "otel servicegraph" if how == "prometheus" else "otlp spans")
    merged = stored(runtime_join.merge(analysis.edges, calls, source, method, path), "edges")
    edges = merged.drop("confirms")
    return Analysis(analysis.services, edges, analysis.stats), mapping, runtime_join.counts(merged, calls, mapping)
