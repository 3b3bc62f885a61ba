"""Aggregates over a graph of services."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.functions.labels import confidence_label, type_label
from sparkwake.functions.scalars import clean_path, percent, pull_request, round1
from sparkwake.operators.edges import DATABASE, IMPORT


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges by confidence and by type in one pass: repo_id, facet, label, n."""
    both = edges.select("repo_id", F.inline(F.array(F.struct(F.lit("confidence").alias("facet"), confidence_label(F.col("conf_rank")).alias("label")), F.struct(F.lit("type").alias("facet"), type_label(F.col("type_ord")).alias("label")))))
    return both.groupBy("repo_id", "facet", "label").agg(F.count("*").alias("n"))


def dependants(edges: DataFrame) -> DataFrame:
    """Inbound edges and distinct sources of each target."""
    return edges.groupBy("repo_id", F.col("target").alias("service")).agg(F.count("*").alias("inbound"), F.countDistinct("source").alias("sources"))


def most_connected(edges: DataFrame, k: int = 1) -> DataFrame:
    top = Window.partitionBy("repo_id").orderBy(F.desc("sources"), "service")
    return dependants(edges).withColumn("pos", F.row_number().over(top)).where(F.col("pos") <= k).select("repo_id", "pos", "service", "sources")


def top_inbound(edges: DataFrame, k: int = 5) -> DataFrame:
    top = Window.partitionBy("repo_id").orderBy(F.desc("inbound"), "service")
    return dependants(edges).withColumn("pos", F.row_number().over(top)).where(F.col("pos") <= k).select("repo_id", "pos", "service", "inbound")


def never_called(services: DataFrame, edges: DataFrame) -> DataFrame:
    called = edges.select("repo_id", F.col("target").alias("name")).distinct()
    return services.where(F.col("role") == "code").join(called, ["repo_id", "name"], "left_anti").select("repo_id", F.col("name").alias("service"))


def shared_databases(services: DataFrame, edges: DataFrame) -> DataFrame:
    """Database edges between code services: one row a pair, then the services of each key. A key is the edge's db_key;
    of a pair's keys one without / is preferred, then the first in edge order."""
    code = services.where(F.col("role") == "code").select("repo_id", "name")
    own = edges.where((F.col("type_ord") == DATABASE) & F.col("db_key").isNotNull())
    for side in ("source", "target"):
        own = own.join(code.withColumnRenamed("name", side), ["repo_id", side], "left_semi")
    pair = own.groupBy("repo_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min_by("db_key", F.struct(F.contains("db_key", F.lit("/")).alias("slash"), "source", "target")).alias("db_key"))
    sides = pair.select("repo_id", "db_key", F.explode(F.array("a", "b")).alias("service"))
    return sides.groupBy("repo_id", "db_key").agg(F.array_join(F.sort_array(F.collect_set("service")), ",").alias("services"))


def never_observed(services: DataFrame, edges: DataFrame) -> DataFrame:
    """Static edges that production did not show: not imports, not databases shared by code services."""
    role = services.select("repo_id", F.col("name").alias("target"), F.col("role").alias("target_role"))
    static = edges.where((F.col("conf_rank") == 2) & (F.col("type_ord") != IMPORT)).join(role, ["repo_id", "target"])
    return static.where(~((F.col("type_ord") == DATABASE) & (F.col("target_role") == "code"))).select("repo_id", "source", "target", type_label(F.col("type_ord")).alias("type"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Each service's neighbours with the weakest confidence between them, either way round."""
    plain = edges.where(F.col("source") != F.col("target"))
    both = plain.select("repo_id", F.inline(F.array(F.struct(F.col("source").alias("service"), F.col("target").alias("neighbour"), "conf_rank"), F.struct(F.col("target").alias("service"), F.col("source").alias("neighbour"), "conf_rank"))))
    return both.groupBy("repo_id", "service", "neighbour").agg(confidence_label(F.min("conf_rank")).alias("weakest"))


def nodes(services: DataFrame, edges: DataFrame) -> DataFrame:
    """A node's strongest inbound confidence and the radius it is drawn with."""
    inbound = edges.groupBy("repo_id", F.col("target").alias("name")).agg(F.max("conf_rank").alias("best"), F.count("*").alias("inbound"))
    radius = 7 + 3 * F.sqrt(F.coalesce("inbound", F.lit(0)))
    return services.join(inbound, ["repo_id", "name"], "left").select("repo_id", F.col("name").alias("service"), confidence_label(F.col("best")).alias("strongest"), radius.alias("radius"))


def history_summary(entries: DataFrame) -> DataFrame:
    """entries (reference, pos, changed, reached) -> one row of averages; of the largest entries the oldest counts."""
    return entries.agg(
        F.count("*").alias("found"), round1(F.avg("reached")).alias("average"), round1(F.percentile("reached", F.lit(0.5))).alias("median"),
        F.max_by("reference", F.struct("reached", "pos")).alias("largest"), F.max("reached").alias("largest_reached"),
        F.count_if(F.col("reached") > 10).alias("over10"), percent(F.count_if(F.col("reached") > 10), F.count("*")).alias("over10_percent"), F.count_if(F.col("changed") == 0).alias("touching_none"),
    )


def discovery_choice(attempts: DataFrame) -> DataFrame:
    """attempts (repo_id, strategy, ord, code, services) -> the first strategy with over one code service, else the one
    with most code, then most services; and how many were tried."""
    first = F.min(F.when(F.col("code") > 1, F.col("ord")))
    best = F.max_by("ord", F.struct("code", "services", -F.col("ord")))
    chosen = attempts.groupBy("repo_id").agg(F.coalesce(first, best).alias("ord"), F.coalesce(first, F.max("ord")).alias("last"))
    return chosen.join(attempts.select("repo_id", "ord", "strategy"), ["repo_id", "ord"]).select("repo_id", "strategy", (F.col("last") + 1).alias("tried"))


def in_order(services: DataFrame) -> DataFrame:
    """Services with their place in a report: code first, then by name without case, then by name."""
    order = Window.partitionBy("repo_id").orderBy(F.when(F.col("role") == "code", 0).otherwise(1), F.lower("name"), "name")
    return services.withColumn("place", F.row_number().over(order))


def widest_first(reached: DataFrame) -> DataFrame:
    """reached (repo_id, service, reached) -> the service of each repository that reaches most, of equal ones the first name."""
    best = reached.groupBy("repo_id").agg(F.min(F.struct((-F.col("reached")).alias("r"), F.lower("service").alias("low"), "service")).alias("best"))
    return best.select("repo_id", "best.service", (-F.col("best.r")).alias("reached"))


def edges_of(edges: DataFrame, service: str) -> DataFrame:
    """Edges of a service, with side: 0 those that leave it, 1 those that come to it."""
    out, into = (edges.where(F.col(c) == service).withColumn("side", F.lit(n)) for n, c in enumerate(("source", "target")))
    return out.unionByName(into)


def with_text(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows of which one of the columns holds its text, whatever the case; null holds none."""
    has = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower())) for c, text in wanted.items()]
    any_ = has[0]
    for one in has[1:]:
        any_ = any_ | one
    return rows.where(any_)


def recent_requests(commits: DataFrame, most: int = 20) -> DataFrame:
    """commits (pos, reference, subject) -> the last commits that name a pull request."""
    named = commits.withColumn("pull_request", pull_request(F.col("subject"))).where(F.col("pull_request").isNotNull())
    return named.orderBy(F.desc("pos")).limit(most).select("pos", "reference", "pull_request")


def changed_files(changes: DataFrame) -> DataFrame:
    """changes (change_id, repo_id, file, pos) -> each file once, under its clean path, where it comes first."""
    return changes.groupBy("change_id", "repo_id", clean_path(F.col("file")).alias("file")).agg(F.min("pos").alias("pos"))


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Rows of any of the frames, once each."""
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return every.distinct()
