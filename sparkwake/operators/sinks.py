"""Results as JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwake.functions.labels import confidence_label, type_label

NOT_REACHED = "Not reached means that no known edge leads there; it does not mean that the change is safe there."


def edges_json(edges: DataFrame) -> DataFrame:
    """One JSON object a row: source, target, type, confidence, evidence, and calls if there are any."""
    shown = [F.col("source"), F.col("target"), type_label(F.col("type_ord")).alias("type"), confidence_label(F.col("conf_rank")).alias("confidence"), F.col("evidence")]
    observed = F.when(F.col("calls").isNotNull(), F.struct("calls")).alias("observed")
    return edges.select("repo_id", F.to_json(F.struct(*shown, observed)).alias("json"))


def services_json(services: DataFrame) -> DataFrame:
    """As edges_json; root and language are written as null where there are none."""
    plain = F.to_json(F.struct("name", "root", "language", "role"), {"ignoreNullFields": "false"})
    return services.select("repo_id", plain.alias("json"))


def report(reached: DataFrame) -> DataFrame:
    """A line a service reached, by change and depth."""
    words = F.array_join(F.transform("path", lambda h: F.concat(h["from"], F.lit(" <- "), h["to"])), ", ")
    return reached.select("change_id", "depth", F.format_string("%d  %s  [%s]  %s", "depth", "service", confidence_label(F.col("conf_rank")), words).alias("line"))
