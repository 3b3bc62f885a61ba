"""Production calls joined with the graph: names to services, calls to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwake.functions.labels import type_order
from sparkwake.functions.scalars import call_class, call_edge_type, calls_detail, normalise
from sparkwake.operators.similar_names import most_similar

THRESHOLD, SHORTEST = 0.9, 4


def match_names(names: DataFrame, services: DataFrame, mapped: dict[str, str] | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """names (repo_id, runtime), services (repo_id, name, pos) -> repo_id, runtime, service, how, score.

    In turn: ignored, mapped, the same name, the same normalised name (the first service), the most similar name of at
    least THRESHOLD (the last of equals). Only names left after the equality joins meet services by similarity, tile
    by tile, and only those of the same repository. A name that is mapped to a service which its repository has not is an error, raised when
    the rows are read."""
    mapped = mapped or {}
    known = services.select("repo_id", F.col("name").alias("service"), "pos", normalise(F.col("name")).alias("norm"))
    rows = names.distinct().withColumn("norm", normalise(F.col("runtime")))
    target = F.coalesce(*[F.when(F.col("runtime") == k, F.lit(v)) for k, v in mapped.items()], F.lit(None).cast("string"))
    exact = known.select("repo_id", F.col("service").alias("runtime"), F.col("service").alias("exact")).distinct()
    if mapped:
        rows = rows.withColumn("wanted", target).join(exact.select("repo_id", F.col("runtime").alias("wanted"), F.lit(True).alias("has")), ["repo_id", "wanted"], "left")
        lost = F.col("wanted").isNotNull() & F.col("has").isNull() & ~(F.col("runtime").isin(*ignored) if ignored else F.lit(False))
        target = F.when(lost, F.raise_error(F.concat(F.lit("mapped to no service of the repository: "), "runtime", F.lit(" -> "), "wanted"))).otherwise(F.col("wanted"))
    norm = known.where(F.col("norm") != "").groupBy("repo_id", "norm").agg(F.min_by("service", "pos").alias("same_norm"))
    tiers = rows.withColumn("target", target).withColumn("ignored", F.col("runtime").isin(*ignored) if ignored else F.lit(False)).join(exact, ["repo_id", "runtime"], "left").join(norm, ["repo_id", "norm"], "left")
    left = tiers.where(~F.col("ignored") & F.coalesce("target", "exact", "same_norm").isNull() & (F.octet_length("norm") >= SHORTEST)).select("repo_id", "runtime", "norm")
    long_names = known.where(F.octet_length("norm") >= SHORTEST).select("repo_id", "service", F.col("pos").cast("long").alias("pos"), F.col("norm").alias("other"))
    similar = left.join(most_similar(left, long_names, THRESHOLD), ["repo_id", "norm"]).select("repo_id", "runtime", F.struct("service", "score").alias("similar"))
    found = tiers.join(similar, ["repo_id", "runtime"], "left")
    how = F.when(F.col("ignored"), "ignored").when(F.col("target").isNotNull(), "config").when(F.col("exact").isNotNull(), "exact").when(F.col("same_norm").isNotNull(), "normalised").when(F.col("similar").isNotNull(), "fuzzy").otherwise("unmatched")
    service = F.when(~F.col("ignored"), F.coalesce("target", "exact", "same_norm", "similar.service"))
    return found.select("repo_id", "runtime", service.alias("service"), how.alias("how"), F.when(how == "fuzzy", F.col("similar.score")).alias("score"))


def resolved(calls: DataFrame, mapping: DataFrame) -> DataFrame:
    """calls (repo_id, client, server, calls, kind, first_seen) with source and target, null where a name has no service."""
    side = lambda name, to: mapping.select("repo_id", F.col("runtime").alias(name), F.col("service").alias(to))
    return calls.join(side("client", "source"), ["repo_id", "client"], "left").join(side("server", "target"), ["repo_id", "server"], "left")


#: A piece of evidence.
EVIDENCE = "array<struct<file:string,line:int,detail:string>>"


def merge(edges: DataFrame, calls: DataFrame, source: str = "otel", method: str = "otel servicegraph", read_from: str = "runtime") -> DataFrame:
    """edges (repo_id, source, target, type_ord, conf_rank; of an earlier run also calls, observed, evidence), calls as of
    resolved() -> edges after the run, their other columns as they are. A call confirms every edge of its pair that it is
    compatible with, else it makes one, typed by the pair's first call; a later run confirms that one. Calls add up, and the
    run's evidence (file read_from, no line) stands first, or stays where an earlier run of that name has put it, with the new
    total. confirms: how many calls confirmed an edge that was there. One full outer join on (repo, pair, class)."""
    kept = [c for c in edges.columns if c not in ("repo_id", "source", "target", "type_ord", "conf_rank", "calls", "observed", "evidence", "detail", "runtime_only", "confirms")]
    before = {"calls": "bigint", "observed": "string", "evidence": EVIDENCE}
    known = edges.select("repo_id", "source", "target", "type_ord", "conf_rank", *kept, *[(F.col(c) if c in edges.columns else F.lit(None)).cast(t).alias(f"old_{c}") for c, t in before.items()])
    own = calls.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")))
    sums = own.groupBy("repo_id", "source", "target", call_class(F.col("kind")).alias("class")).agg(F.sum("calls").alias("more"), F.min_by("kind", "first_seen").alias("kind"), F.count("*").alias("n"))
    classes = F.when(F.col("type_ord").isin(0, 2), F.lit("call")).when(F.col("type_ord") == 1, F.lit("event")).when(F.col("type_ord") == 3, F.lit("database"))
    both = known.withColumn("class", F.coalesce(classes, F.lit("import"))).join(sums, ["repo_id", "source", "target", "class"], "full_outer")
    seen, total = F.col("n").isNotNull(), F.coalesce(F.col("old_calls") + F.col("more"), F.col("old_calls"), F.col("more"))
    detail = F.when(seen, calls_detail(total, F.lit(method)))
    held = F.coalesce("old_evidence", F.array().cast(EVIDENCE))
    own_piece = lambda e: (e["file"] == read_from) & e["line"].isNull()
    piece = F.struct(F.lit(read_from).alias("file"), F.lit(None).cast("int").alias("line"), detail.alias("detail"))
    put = F.when(F.exists(held, own_piece), F.transform(held, lambda e: F.when(own_piece(e), piece).otherwise(e))).otherwise(F.concat(F.array(piece), held))
    there = F.col("type_ord").isNotNull()
    return both.select(
        "repo_id", "source", "target", F.coalesce("type_ord", type_order(call_edge_type(F.col("kind")))).alias("type_ord"), F.when(seen, 3).otherwise(F.col("conf_rank")).alias("conf_rank"), *kept,
        F.when(seen, total).otherwise(F.col("old_calls")).alias("calls"), F.when(seen, F.lit(source)).otherwise(F.col("old_observed")).alias("observed"), detail.alias("detail"),
        F.when(seen, put).otherwise(F.col("old_evidence")).alias("evidence"), (seen & ~there).alias("runtime_only"), F.when(seen & there, F.col("n")).otherwise(0).alias("confirms"),
    )


def counts(merged: DataFrame, calls: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row a repository: names, matched names, observed edges, edges that only production knows, calls skipped, calls that
    confirmed an edge. A call that confirms several edges of its class counts once."""
    names = mapping.groupBy("repo_id").agg(F.count("*").alias("runtime"), F.count("service").alias("matched"), F.count_if(F.col("how") == "unmatched").alias("unmatched"))
    own = merged.groupBy("repo_id").agg(F.count("observed").alias("observed"), F.count_if("runtime_only").alias("runtime_only"))
    skipped = calls.groupBy("repo_id").agg(F.count_if(F.col("source").isNull() | F.col("target").isNull()).alias("skipped"))
    once = merged.groupBy("repo_id", "source", "target", F.when(F.col("type_ord").isin(0, 2), 0).otherwise(F.col("type_ord")).alias("class")).agg(F.max("confirms").alias("n"))
    confirmed = once.groupBy("repo_id").agg(F.sum("n").alias("confirmed"))
    return names.join(own, "repo_id", "left").join(skipped, "repo_id", "left").join(confirmed, "repo_id", "left")


def warnings(mapping: DataFrame) -> DataFrame:
    return mapping.where(F.col("how") == "fuzzy").select("repo_id", F.format_string("fuzzy match: %s -> %s (%.2f)", "runtime", "service", "score").alias("warning"))
