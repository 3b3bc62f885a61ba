"""Datasets derived from the driver's tables, in SQL that Spark and DuckDB both run, so that both start from the same rows."""

from __future__ import annotations

import re
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: {name} is a table of the driver or another dataset.
DATASETS = {
    "d_lines": "SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity, min(l_tax) AS l_tax FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    # suppliers are services of two repositories
    "d_services": """
SELECT concat('repo-', CAST(s_suppkey % 2 AS STRING)) AS repo_id, concat('svc-', CAST(s_suppkey AS STRING)) AS name,
  CASE WHEN s_nationkey % 5 <> 4 THEN concat('region_', CAST(n_regionkey AS STRING), '/nation_', CAST(s_nationkey AS STRING), '/svc_', CAST(s_suppkey AS STRING)) END AS root,
  CASE WHEN s_nationkey % 5 = 4 THEN 'infrastructure' ELSE 'code' END AS role,
  CASE s_suppkey % 4 WHEN 0 THEN 'library/redis:6' WHEN 1 THEN 'bitnami/kafka@sha256:ab' WHEN 2 THEN 'demo/web-service:1.2' END AS image, s_suppkey AS pos
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "d_candidates": """
SELECT concat('repo-', CAST(a.l_suppkey % 2 AS STRING)) AS repo_id, concat('svc-', CAST(a.l_suppkey AS STRING)) AS source, concat('svc-', CAST(b.l_suppkey AS STRING)) AS target,
  CAST(CASE b.l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 4 END AS INT) AS type_ord,
  CAST(CASE a.l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS INT) AS conf_rank,
  concat('order-', CAST(a.l_orderkey AS STRING)) AS file, a.l_linenumber AS line, CAST(NULL AS STRING) AS detail, a.l_orderkey * 10 + a.l_linenumber AS ordinal
FROM {d_lines} a JOIN {d_lines} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_suppkey % 2 = b.l_suppkey % 2""",
    # parts are services of eight repositories that know little of each other, so that much is reached weakly or not at all
    "d_parts": """
SELECT concat('parts-', CAST(p_partkey % 8 AS STRING)) AS repo_id, concat('part-', CAST(p_partkey AS STRING)) AS name, concat('lib/p', CAST(p_partkey AS STRING)) AS root,
  CASE WHEN p_size % 10 = 9 THEN 'infrastructure' ELSE 'code' END AS role, CAST(NULL AS STRING) AS image, p_partkey AS pos FROM {part}""",
    "d_uses": """
SELECT concat('parts-', CAST(a.l_partkey % 8 AS STRING)) AS repo_id, concat('part-', CAST(a.l_partkey AS STRING)) AS source, concat('part-', CAST(b.l_partkey AS STRING)) AS target,
  CAST(CASE b.l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 4 END AS INT) AS type_ord,
  CAST(CASE a.l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS INT) AS conf_rank,
  concat('order-', CAST(a.l_orderkey AS STRING)) AS file, a.l_linenumber AS line, CAST(NULL AS STRING) AS detail, a.l_orderkey * 10 + a.l_linenumber AS ordinal
FROM {d_lines} a JOIN {d_lines} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey % 8 = b.l_partkey % 8""",
    # a customer's change is one of two parts, or of one that is not there
    "d_pulls": """
SELECT CAST(c_custkey AS STRING) AS change_id, concat('parts-', CAST(k % 8 AS STRING)) AS repo_id, concat('lib/p', CAST(k AS STRING), '/main.py') AS file, k AS pos
FROM (SELECT c_custkey, c_custkey AS k FROM {customer} UNION ALL SELECT c_custkey, c_custkey + 8 AS k FROM {customer}) x""",
    # the graph of services and the graph of parts side by side, with the changes of both; their repositories differ
    "d_all_services": "SELECT * FROM {d_services} UNION ALL SELECT * FROM {d_parts}",
    "d_all_candidates": "SELECT * FROM {d_candidates} UNION ALL SELECT * FROM {d_uses}",
    "d_all_changes": "SELECT * FROM {d_changes} UNION ALL SELECT * FROM {d_pulls}",
    # half of the names are services, the others resemble none
    "d_runtime": """
SELECT 'repo-0' AS repo_id, CASE WHEN user_id % 10 < 5 THEN 'svc-' || CAST(2 * (user_id % 10) AS STRING) ELSE 'ext' || CAST(user_id % 50 AS STRING) END AS client,
  CASE WHEN callee % 10 < 5 THEN 'svc-' || CAST(2 * (callee % 10) AS STRING) ELSE 'ext' || CAST(callee % 50 AS STRING) END AS server,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 END AS calls, CASE event_id % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'grpc' WHEN 2 THEN 'event' WHEN 3 THEN 'database' ELSE 'unknown' END AS kind, event_id AS ordinal
FROM (SELECT a.*, b.user_id AS callee FROM {events} a JOIN {events} b ON b.event_id = a.event_id + 1) x""",
    "d_changes": """
SELECT CAST(o_orderkey AS STRING) AS change_id, concat('repo-', CAST(l_suppkey % 2 AS STRING)) AS repo_id,
  CASE WHEN l_linenumber % 6 = 5 THEN concat('docs/f', CAST(l_linenumber AS STRING)) ELSE concat('./region_', CAST(n_regionkey AS STRING), '/nation_', CAST(s_nationkey AS STRING), '/svc_', CAST(s_suppkey AS STRING), '/src/f', CAST(l_linenumber AS STRING)) END AS file, l_linenumber AS pos
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "d_mentions": """
SELECT concat('repo-', CAST(p_partkey % 2 AS STRING)) AS repo_id, concat('svc-', CAST(p_partkey % 100 AS STRING)) AS service, lower(p_type) AS topic_key,
  CASE p_size % 3 WHEN 0 THEN 'producer' WHEN 1 THEN 'consumer' ELSE 'unknown' END AS role, p_partkey AS ordinal FROM {part}""",
    "d_spans": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS span_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber - 1 AS STRING)) AS parent_id,
  concat('svc-', CAST(l_suppkey AS STRING)) AS service, CASE l_linenumber % 3 WHEN 0 THEN concat('svc-', CAST(l_partkey % 100 AS STRING)) END AS peer,
  CASE l_linenumber % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'http' WHEN 2 THEN 'grpc' ELSE 'database' END AS kind, l_orderkey * 10 + l_linenumber AS ordinal FROM {d_lines}""",
    "d_names": """
SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN concat(lower(s_name), '-service') WHEN 1 THEN concat('Checkout.', CAST(s_suppkey AS STRING), '_API') WHEN 2 THEN concat('paymnt', CAST(s_suppkey AS STRING)) ELSE 'orders-deployment' END AS variant FROM {supplier}""",
    "d_env": """
SELECT c_custkey AS id, concat('svc-', CAST(c_custkey % 100 AS STRING)) AS service,
  CASE c_custkey % 6 WHEN 0 THEN 'CATALOGUE_HOST' WHEN 1 THEN 'PRODUCT_CATALOG_SERVICE_ADDR' WHEN 2 THEN 'DB_CONNECTION_STRING' WHEN 3 THEN 'PORT' WHEN 4 THEN 'redis_url' ELSE 'LOG_LEVEL' END AS variable,
  CASE c_custkey % 5 WHEN 0 THEN concat('http://svc-', CAST(c_custkey % 90 AS STRING), ':8080/x') WHEN 1 THEN concat('svc-', CAST(c_custkey % 90 AS STRING), ':6379') WHEN 2 THEN concat('Server=svc-', CAST(c_custkey % 90 AS STRING), ',1433;Database=Shop', CAST(c_custkey % 3 AS STRING)) WHEN 3 THEN concat('jdbc:mysql://user@svc-', CAST(c_custkey % 90 AS STRING), '/orders') ELSE '127.0.0.1:80' END AS value
FROM {customer}""",
    "d_commits": """
SELECT o_orderkey AS pos, concat('c', CAST(o_orderkey AS STRING)) AS reference,
  CASE o_orderkey % 5 WHEN 0 THEN concat('Merge pull request #', CAST(o_orderkey % 97 AS STRING), ' from x/y') WHEN 1 THEN concat('feat: add thing (#', CAST(o_orderkey % 89 AS STRING), ')') WHEN 2 THEN 'docs: plain' WHEN 3 THEN concat('See merge request a/b!', CAST(o_orderkey % 83 AS STRING)) ELSE concat('Merged in x (pull request #', CAST(o_orderkey % 79 AS STRING), ') y') END AS subject FROM {orders}""",
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def _next_lines(spark: SparkSession, sf_dir: str, repo: str, name: str, of: int, column: str) -> DataFrame:
    """d_candidates and d_uses without a self-join: the line after a line is the next of its order, if their numbers are one
    apart. Lines are dealt out once, by order."""
    lines = spark.sql(DATASETS["d_lines"], lineitem=load(spark, sf_dir, "lineitem").repartition("l_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    met = lines.select("l_orderkey", "l_linenumber", F.col(column).alias("a"), "l_returnflag", F.lead("l_linenumber").over(order).alias("after"), F.lead(column).over(order).alias("b"))
    met = met.where((F.col("after") == F.col("l_linenumber") + 1) & (F.col("a") % of == F.col("b") % of))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return met.select(
        text(repo, F.col("a") % of).alias("repo_id"), text(name, F.col("a")).alias("source"), text(name, F.col("b")).alias("target"),
        F.expr("CAST(CASE after % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 4 END AS INT)").alias("type_ord"),
        F.expr("CAST(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS INT)").alias("conf_rank"),
        text("order-", F.col("l_orderkey")).alias("file"), F.col("l_linenumber").alias("line"), F.lit(None).cast("string").alias("detail"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
    )


#: Datasets that Spark makes by another way than their SQL, to the same rows.
MADE = {
    "d_candidates": partial(_next_lines, repo="repo-", name="svc-", of=2, column="l_suppkey"),
    "d_uses": partial(_next_lines, repo="parts-", name="part-", of=8, column="l_partkey"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or a dataset."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in MADE:
        return MADE[name](spark, sf_dir)
    sql = DATASETS[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in names_in(sql)})


@cache
def needed(name: str) -> tuple[str, ...]:
    """Datasets on which a dataset rests, itself last."""
    found: dict[str, None] = {}
    for n in names_in(DATASETS[name]):
        if n in DATASETS:
            found |= dict.fromkeys(needed(n))
    return (*found, name)


def oracle(sql: str) -> str:
    """sql with {dataset} names, for DuckDB: the datasets go before it."""
    used: dict[str, None] = {}
    for n in names_in(sql):
        if n in DATASETS:
            used |= dict.fromkeys(needed(n))
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    parts = [f"{n} AS ({plain(DATASETS[n])})" for n in used]
    body = plain(sql).strip()
    if parts and body[:5].upper() == "WITH ":
        recursive = body[5:].lstrip().upper().startswith("RECURSIVE ")
        body = body[5:].lstrip()[len("RECURSIVE ") :] if recursive else body[5:]
        return f"WITH RECURSIVE {', '.join(parts)}, {body}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
