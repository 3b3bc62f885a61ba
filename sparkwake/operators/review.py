"""Links of a walk that somebody should look at, and what was said of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINKS, EVIDENCE = 20, 3


def links(reached: DataFrame, most: int = LINKS) -> DataFrame:
    """reached (change_id, repo_id, service, depth, conf_rank, path) -> the first distinct inferred and uncertain hops of each
    change, in report order: depth, then strongest, then name, then place in the path."""
    hops = reached.select("change_id", "repo_id", "depth", "conf_rank", "service", F.posexplode("path").alias("place", "hop")).where(F.col("hop.confidence").isin("inferred", "uncertain"))
    order = F.struct("depth", (-F.col("conf_rank")).alias("rank"), F.lower("service").alias("low"), "service", "place")
    first = hops.groupBy("change_id", "repo_id", F.col("hop.from").alias("source"), F.col("hop.to").alias("target"), F.col("hop.relation").alias("relation")).agg(F.min(order).alias("first"), F.min("hop.confidence").alias("confidence"))
    place = Window.partitionBy("change_id").orderBy("first", "repo_id", "source", "target", "relation")
    return first.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).drop("first")


def evidence(asked: DataFrame, edges: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """asked links with the first pieces of evidence of the edges behind them, in their own
    repository: an event's own way, all others against it."""
    own = edges.select("repo_id", "source", "target", "type_ord", "conf_rank", F.slice("evidence", 1, most).alias("evidence"))
    event = F.col("relation").isin("consumes")
    ways = asked.select("*", F.when(event, F.col("source")).otherwise(F.col("target")).alias("e_source"), F.when(event, F.col("target")).otherwise(F.col("source")).alias("e_target"))
    best = own.groupBy("repo_id", F.col("source").alias("e_source"), F.col("target").alias("e_target")).agg(F.max_by("evidence", F.struct("conf_rank", -F.col("type_ord"))).alias("evidence"))  # of equally sure edges the first type
    return ways.join(best, ["repo_id", "e_source", "e_target"], "left").drop("e_source", "e_target")


def verdicts(asked: DataFrame, said: DataFrame) -> DataFrame:
    """asked (change_id, source, target, relation), said (change_id, source, target, verdict, reason, ordinal): the first
    verdict of each link; a link without one is unclear."""
    first = said.groupBy("change_id", "source", "target").agg(F.min_by(F.struct("verdict", "reason"), "ordinal").alias("v"))
    return asked.join(first, ["change_id", "source", "target"], "left").select("change_id", "source", "target", F.coalesce("v.verdict", F.lit("unclear")).alias("verdict"), F.coalesce("v.reason", F.lit("not judged")).alias("reason"))
