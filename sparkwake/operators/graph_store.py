"""A graph as two tables, services and edges: services are put in or replaced by name, edges only between services that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERVICE, EDGE = ["repo_id", "name"], ["repo_id", "source", "target", "type_ord"]


def put(held: DataFrame, more: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """held, and more over it: of the rows of a key the last of more by `order` stays, else what was held. Columns that only one
    of the two has are null in the other's rows."""
    both = held.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(c) for c in order])
    return both.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n", "_new")


def put_services(services: DataFrame, more: DataFrame, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    return put(services, more, SERVICE, list(order))


def unknown_ends(edges: DataFrame, services: DataFrame) -> DataFrame:
    """Edges of which an end is no service of their repository, with `end`: source, target or both."""
    known = services.select(*SERVICE).distinct()
    side = lambda rows, c: rows.join(known.select("repo_id", F.col("name").alias(c), F.lit(True).alias(f"has_{c}")), ["repo_id", c], "left")
    lost = side(side(edges, "source"), "target")
    source, target = F.col("has_source").isNull(), F.col("has_target").isNull()
    return lost.withColumn("end", F.when(source & target, "both").when(source, "source").when(target, "target")).where(F.col("end").isNotNull()).drop("has_source", "has_target")


def put_edges(edges: DataFrame, more: DataFrame, services: DataFrame, order: tuple[str, ...] = ("conf_rank",)) -> tuple[DataFrame, DataFrame]:
    """The edges after those of more are put in, and those of more that are refused because an end is unknown."""
    refused = unknown_ends(more, services)
    known = services.select(*SERVICE).distinct()
    allowed = more
    for end in ("source", "target"):
        allowed = allowed.join(known.withColumnRenamed("name", end), ["repo_id", end], "left_semi")
    return put(edges, allowed, EDGE, list(order)), refused
