"""python -m sparkwake ROOT [--files F...] [--diff RANGE] [--pr N] [--history N] [--depth N] [--calls FILE] [--json]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkwake.operators import findings, sinks
from sparkwake.plans.analyze import analyze, with_runtime
from sparkwake.sources import config, git


def main() -> None:
    ask = argparse.ArgumentParser(description=__doc__)
    ask.add_argument("root")
    change = ask.add_mutually_exclusive_group()
    change.add_argument("--files", nargs="+")
    change.add_argument("--diff")
    change.add_argument("--pr", type=int)
    change.add_argument("--history", type=int)
    ask.add_argument("--depth", type=int, default=3)
    ask.add_argument("--calls")
    ask.add_argument("--json", action="store_true")
    ask.add_argument("--include-tests", action="store_true")
    said = ask.parse_args()
    spark = SparkSession.builder.appName("sparkwake").getOrCreate()
    repo = git.repository_name(said.root)
    graph = analyze(spark, {repo: said.root}, said.include_tests)
    if said.calls:
        own = config.load(said.root)
        graph, _, counts = with_runtime(graph, spark, repo, said.calls, own.mapped, own.ignored)
        counts.show(truncate=False)
    if said.history:
        changes = git.changes(spark, repo, said.root, said.history)
        reached = graph.blast(changes.where(F.col("file").isNotNull()).select("change_id", "repo_id", "file"), said.depth)
        seeds = graph.seeds(changes.where(F.col("file").isNotNull()).select("change_id", "repo_id", "file"))
        tally = lambda df, name: df.groupBy("change_id").agg(F.count("*").alias(name))
        entries = changes.select(F.col("change_id").alias("reference"), "pos", "change_id").distinct().join(tally(seeds, "changed"), "change_id", "left").join(tally(reached, "reached"), "change_id", "left").na.fill(0, ["changed", "reached"])
        findings.history_summary(entries).show(truncate=False)
        return
    files = said.files or (git.diff_files(said.root, said.diff) if said.diff else git.pull_request_files(said.root, said.pr) if said.pr else git.working_files(said.root))
    if files:
        changes = spark.createDataFrame([("change", repo, f) for f in files], "change_id string, repo_id string, file string")
        for row in sinks.report(graph.blast(changes, said.depth)).orderBy("depth", "line").toLocalIterator():
            print(row["line"])
        print(sinks.NOT_REACHED)
        return
    shown = sinks.edges_json(graph.edges) if said.json else graph.edges.select("source", "target", "type_ord", "conf_rank")
    for row in shown.toLocalIterator():
        print(row["json"] if said.json else f"{row['source']} -> {row['target']}")


if __name__ == "__main__":
    main()
