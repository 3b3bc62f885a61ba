"""Derived datasets keep every row of the tables that they are made of."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from sparkwake.operators import edges
from sparkwake.plans.derived import DATASETS, MADE, load
from sparkwake.plans.graph_queries import merged
from sparkwake.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_changes_and_runtime(spark):
    assert load(spark, DATA, "d_changes").count() == load(spark, DATA, "lineitem").count()
    larger = DATA.replace("0.001", "0.01")
    assert load(spark, larger, "d_runtime").count() == load(spark, larger, "events").count() - 1


def test_edges_of_all_candidates(spark):
    pairs = load(spark, DATA, "d_candidates").where(F.col("source") != F.col("target")).select("repo_id", "source", "target").distinct()
    assert merged(spark, DATA).select("repo_id", "source", "target").distinct().count() == pairs.count()


def test_queries_read_all(spark):
    assert QUERIES["SRC_20_otlp_spans"](spark, DATA).count() == load(spark, DATA, "d_spans").count()


def test_not_reached_of_services_and_parts(spark, tmp_path):
    """With few edges the changes of orders leave services unreached, as those of customers leave parts."""
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        few = "WHERE l_orderkey % 40 = 1" if t == "lineitem" else ""
        con.execute(f"COPY (SELECT * FROM '{DATA}/{t}.parquet' {few}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = [(r["change_id"], r["repo_id"], r["service"]) for r in QUERIES["ST_03_not_reached"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT change_id, repo_id, service FROM ({ORACLE_SQL['ST_03_not_reached']})").fetchall())
    assert {repo.split("-")[0] for _, repo, _ in got} == {"repo", "parts"}


def test_datasets_made_another_way(spark):
    """Candidates of neighbouring lines are those that the SQL gives, kinds of columns included."""
    for name in MADE:
        got, want = load(spark, DATA, name), spark.sql(DATASETS[name], d_lines=load(spark, DATA, "d_lines"))
        assert got.dtypes == want.dtypes and want.count() > 100
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_edge_ranks_are_those_of_merged_edges(spark):
    """Without evidence the edges and their confidences stay, http next to gRPC and repeated pieces included."""
    rows = [("r", a, b, t, c, f"f{n % 3}", n % 2, None, n) for n, (a, b, t, c) in enumerate((a, b, t, c) for a in "xy" for b in "xyz" for t in range(5) for c in range(4) if (ord(a) + ord(b) * t + c) % 3)]
    frame = spark.createDataFrame(rows, "repo_id string, source string, target string, type_ord int, conf_rank int, file string, line int, detail string, ordinal long")
    columns = ("repo_id", "source", "target", "type_ord", "conf_rank")
    for candidates in (frame, load(spark, DATA, "d_candidates"), load(spark, DATA, "d_uses")):
        want, got = (sorted(map(tuple, f(candidates).select(*columns).collect())) for f in (edges.merge_edges, edges.edge_ranks))
        assert got == want and want
