"""An extension beyond batch inputs: calls between services from a stream of spans, in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calls(spans: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """spans (ts, span_id, parent_id, service, kind) -> window, client, server, kind, calls. A span meets its parent if both
    come within `late` of each other; the join's state and the windows are dropped by the watermark."""
    timed = spans.withWatermark("ts", late)
    parents = timed.select(F.col("span_id").alias("p_id"), F.col("service").alias("client"), F.col("ts").alias("p_ts")).withWatermark("p_ts", late)
    near = F.expr(f"p_id = parent_id AND p_ts BETWEEN ts - INTERVAL {late} AND ts + INTERVAL {late}")
    joined = timed.where(F.col("parent_id").isNotNull()).join(parents, near).where(F.col("client") != F.col("service"))
    return joined.groupBy(F.window("ts", window), "client", F.col("service").alias("server"), "kind").agg(F.count("*").alias("calls"))
