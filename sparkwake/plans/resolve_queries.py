"""Queries of scalar functions, of the resolver's joins and of the runtime join, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.functions import scalars as S
from sparkwake.functions.labels import confidence_label, type_label
from sparkwake.operators import resolve, runtime_join
from sparkwake.operators.findings import discovery_choice
from sparkwake.plans.derived import load, oracle
from sparkwake.plans.graph_queries import CONF, FOLDED, TYPE, merged
from sparkwake.sources import runtime_calls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return register


NORM = "regexp_replace(translate(lower({0}), '-_.', ''), '(service|svc|api|server|deployment|deploy)$', '')"


@query("SC_01_normalise", f"SELECT id, {NORM.format('name')} AS name_key, {NORM.format('variant')} AS variant_key FROM {{d_names}}")
def sc_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_names").select("id", S.normalise(F.col("name")).alias("name_key"), S.normalise(F.col("variant")).alias("variant_key"))


@query("SC_02_image_basename", "SELECT repo_id, name, nullif(split_part(split_part(regexp_extract(image, '[^/]*$'), '@', 1), ':', 1), '') AS base FROM {d_services}")
def sc_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_services").select("repo_id", "name", S.image_basename(F.col("image")).alias("base"))


URL_SQL = "'^([A-Za-z][A-Za-z0-9+.:-]*)://(?:[^/@\\s]*@)?(\\[[^\\]]+\\]|[^/:?#\\s]+)(?::(\\d+))?'"


@query("SC_04_url_parts", f"SELECT page_id, lower(regexp_extract(url, {URL_SQL}, 1)) AS scheme, lower(regexp_extract(url, {URL_SQL}, 2)) AS host FROM {{pages}}")
def sc_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", S.url_scheme(F.col("url")).alias("scheme"), S.url_host(F.col("url")).alias("host"))


ADO = "nullif(lower(trim(regexp_extract(value, '(?i)(?:^|;)\\s*(?:{})\\s*=\\s*{}', 1))), '')"
ADO_DB = ADO.format("database|initial catalog", "([^;]+)")
ADO_HOST = f"CASE WHEN NOT contains(value, '://') AND {ADO_DB} IS NOT NULL THEN {ADO.format('server|host|data source|addr|address', '(?:tcp:)?([^;,:]+)')} END"
HOST = f"coalesce(nullif(lower(regexp_extract(value, {URL_SQL}, 2)), ''), CASE WHEN regexp_matches(lower(regexp_extract(value, '^([A-Za-z0-9][A-Za-z0-9.-]*):(\\d{{2,5}})$', 1)), '[a-z]') THEN lower(regexp_extract(value, '^([A-Za-z0-9][A-Za-z0-9.-]*):(\\d{{2,5}})$', 1)) END, {ADO_HOST})".replace("{2,5}", "{{2,5}}")


def _host(text: F.Column) -> F.Column:
    return F.coalesce(S.url_host(text), S.host_of_pair(text), S.ado_host(text))


def _sql_braces(sql: str) -> str:
    return sql.replace("{{", "{").replace("}}", "}")


@query("SC_05_hosts", None)
def sc_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_env").select("id", _host(F.col("value")).alias("host"), S.ado_database(F.col("value")).alias("ado_database"))


ORACLE_SQL["SC_05_hosts"] = oracle("SELECT id, HOST_EXPRESSION AS host, " + ADO_DB + " AS ado_database FROM {d_env}").replace("HOST_EXPRESSION", _sql_braces(HOST))
SUFFIXES = "(" + "|".join(S.HOSTISH_SUFFIXES) + ")$"


@query("SC_06_hostish", f"SELECT id, regexp_matches(upper(variable), '{SUFFIXES}') AS hostish FROM {{d_env}}")
def sc_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_env").select("id", S.is_hostish(F.col("variable")).alias("hostish"))


@query("SC_07_variable_names", "SELECT id, CASE variable WHEN 'CATALOGUE_HOST' THEN 'catalogue' WHEN 'PRODUCT_CATALOG_SERVICE_ADDR' THEN 'productcatalog' WHEN 'DB_CONNECTION_STRING' THEN 'db' WHEN 'PORT' THEN 'port' WHEN 'redis_url' THEN 'redis' ELSE 'loglevel' END AS key FROM {d_env}")
def sc_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_env").select("id", S.normalise_variable(F.col("variable")).alias("key"))


@query("SC_10_service_kinds", "SELECT repo_id, name, CASE WHEN contains(lower(coalesce(image, '')), 'redis') THEN 'datastore' WHEN contains(lower(coalesce(image, '')), 'kafka') THEN 'broker' ELSE 'other' END AS kind FROM {d_services}")
def sc_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.with_kind(load(spark, sf_dir, "d_services")).select("repo_id", "name", "kind")


@query("SC_15_database_keys", "SELECT id, CASE WHEN starts_with(value, 'jdbc:mysql://') THEN lower(regexp_extract(value, '@([^/]+/[^/?#]+)', 1)) END AS key FROM {d_env}")
def sc_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_env").select("id", S.database_key(F.col("value")).alias("key"))


@query("SC_22_clean_paths", "SELECT change_id, pos, regexp_replace(file, '^(\\./)+', '') AS path FROM {d_changes}")
def sc_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_changes").select("change_id", "pos", S.clean_path(F.col("file")).alias("path"))


@query("SC_23_pull_requests", "SELECT reference, CAST(coalesce(nullif(regexp_extract(subject, '^Merge pull request #(\\d+)', 1), ''), nullif(regexp_extract(subject, '\\(#(\\d+)\\)\\s*$', 1), ''), nullif(regexp_extract(subject, '\\(pull request #(\\d+)\\)', 1), ''), nullif(regexp_extract(subject, 'See merge request \\S*!(\\d+)', 1), '')) AS INT) AS pull_request FROM {d_commits}")
def sc_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_commits").select("reference", S.pull_request(F.col("subject")).alias("pull_request"))


@query("SC_24_relative_paths", "SELECT change_id, pos, CASE WHEN starts_with(p, 'region_1/') THEN substr(p, 10) END AS inside FROM (SELECT change_id, pos, regexp_replace(file, '^(\\./)+', '') AS p FROM {d_changes})")
def sc_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_changes").select("change_id", "pos", S.relative(F.lit("region_1"), S.clean_path(F.col("file"))).alias("inside"))


@query("SC_27_similar_names", f"SELECT id, jaro_winkler_similarity({NORM.format('name')}, {NORM.format('variant')}) AS score FROM {{d_names}}")
def sc_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_names").select("id", S.jaro_winkler_udf(S.normalise(F.col("name")), S.normalise(F.col("variant"))).alias("score"))


@query("SC_28_round_percent", "SELECT o_custkey, round(avg(o_totalprice), 1) AS average, CAST(floor((count(*) FILTER (o_orderstatus = 'F') * 100 + floor(count(*) / 2)) / count(*)) AS INT) AS percent FROM {orders} GROUP BY 1")
def sc_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(S.round1(F.avg("o_totalprice")).alias("average"), S.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("percent"))


@query("SC_30_escapes", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS html, md5(replace(replace(replace(replace(replace(html, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029')) AS json FROM {pages}")
def sc_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.md5(S.escape_html(F.col("html"))).alias("html"), F.md5(S.escape_json(F.col("html"))).alias("json"))


KEYS = f"""keys AS (SELECT repo_id, tier, key, arg_min(service, o) AS service FROM (
  SELECT repo_id, name AS service, 0 AS tier, lower(name) AS key, pos * 2 AS o FROM {{d_services}}
  UNION ALL SELECT repo_id, name, 1, {NORM.format('name')}, pos * 2 FROM {{d_services}}
  UNION ALL SELECT repo_id, name, 1, {NORM.format("nullif(split_part(split_part(regexp_extract(image, '[^/]*$'), '@', 1), ':', 1), '')")}, pos * 2 + 1 FROM {{d_services}})
  WHERE key IS NOT NULL AND (tier = 0 OR length(key) >= 3) GROUP BY 1, 2, 3)"""
HOSTS = """asked AS (SELECT id, 'repo-' || (id % 2) AS repo_id, HOST_EXPRESSION AS host FROM {d_env}),
turns AS (SELECT id, host, a.repo_id, t.tier, t.key, t.turn FROM asked a, LATERAL (SELECT * FROM (VALUES (0, lower(host), 0), (0, split_part(lower(host), '.', 1), 1), (1, NORM_HOST, 2)) AS v(tier, key, turn)) t WHERE host IS NOT NULL AND NOT regexp_matches(host, '^[0-9.]*$')),
targets AS (SELECT id, arg_min(k.service, turn) AS target FROM turns t JOIN keys k ON k.repo_id = t.repo_id AND k.tier = t.tier AND k.key = t.key GROUP BY 1)""".replace("NORM_HOST", NORM.format("host"))


@query("JN_03_hosts", None)
def jn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_env").select("id", F.concat(F.lit("repo-"), F.col("id") % 2).alias("repo_id"), _host(F.col("value")).alias("host"))
    return resolve.hosts(rows, resolve.service_keys(load(spark, sf_dir, "d_services"))).select("id", "host", "target")


ORACLE_SQL["JN_03_hosts"] = oracle(f"WITH {KEYS}, {HOSTS} SELECT a.id, a.host, t.target FROM asked a LEFT JOIN targets t ON t.id = a.id").replace("HOST_EXPRESSION", _sql_braces(HOST))


@query("JN_02_env_values", "SELECT r.id, coalesce(o.value, s.value) AS value FROM {d_env} r LEFT JOIN (SELECT service, variable, min(value) AS value FROM {d_env} WHERE id % 3 = 0 GROUP BY 1, 2) o ON o.service = r.service AND o.variable = r.variable LEFT JOIN (SELECT variable, max(value) AS value FROM {d_env} WHERE id % 7 = 0 GROUP BY 1) s ON s.variable = r.variable")
def jn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_env").withColumn("repo_id", F.lit("repo"))
    own = rows.where(F.col("id") % 3 == 0).groupBy("repo_id", "service", "variable").agg(F.min("value").alias("value"))
    shared = rows.where(F.col("id") % 7 == 0).groupBy("repo_id", "variable").agg(F.max("value").alias("value"))
    return resolve.env_values(rows.drop("value"), own, shared).select("id", "value")


@query("JN_04_variables", None)
def jn_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    variable = F.when(F.col("id") % 4 == 1, F.format_string("SVC_%d_HOST", F.col("id") % 120)).otherwise(F.col("variable"))
    rows = load(spark, sf_dir, "d_env").withColumn("repo_id", F.concat(F.lit("repo-"), F.col("id") % 2)).withColumn("variable", variable)
    own = rows.where(F.col("id") % 3 == 0).groupBy("repo_id", "service", "variable").agg(F.min("value").alias("value"))
    shared = rows.where(F.lit(False)).select("repo_id", "variable", "value")
    refs = rows.select("id", "repo_id", "service", "variable", F.when(F.col("id") % 2 == 0, F.col("value")).alias("default"))
    found = resolve.variables(refs, own, shared, resolve.service_keys(load(spark, sf_dir, "d_services")), _host(F.col("text")))
    return found.select("id", "target", confidence_label(F.col("conf_rank")).alias("confidence"))


ORACLE_SQL["JN_04_variables"] = oracle(f"""WITH {KEYS},
v AS (SELECT id, 'repo-' || (id % 2) AS repo_id, service, CASE WHEN id % 4 = 1 THEN 'SVC_' || (id % 120) || '_HOST' ELSE variable END AS variable, value FROM {{d_env}}),
own AS (SELECT repo_id, service, variable, min(value) AS value FROM v WHERE id % 3 = 0 GROUP BY 1, 2, 3),
r AS (SELECT v.id, v.repo_id, o.value AS configured, CASE WHEN v.id % 2 = 0 THEN v.value END AS fallback, CASE WHEN v.id % 4 = 1 THEN 'svc-' || (v.id % 120) ELSE CASE v.variable WHEN 'CATALOGUE_HOST' THEN 'catalogue' WHEN 'PRODUCT_CATALOG_SERVICE_ADDR' THEN 'productcatalog' WHEN 'redis_url' THEN 'redis' END END AS named FROM v LEFT JOIN own o ON o.repo_id = v.repo_id AND o.service = v.service AND o.variable = v.variable),
asked AS (SELECT id, w, repo_id, HOST_EXPRESSION AS host FROM (SELECT id, repo_id, 0 AS w, configured AS value FROM r UNION ALL SELECT id, repo_id, 1, fallback FROM r) UNION ALL SELECT id, 2, repo_id, named FROM r),
turns AS (SELECT id, w, a.repo_id, t.tier, t.key, t.turn FROM asked a, LATERAL (SELECT * FROM (VALUES (0, lower(host), 0), (0, split_part(lower(host), '.', 1), 1), (1, {NORM.format('host')}, 2)) AS x(tier, key, turn)) t WHERE host IS NOT NULL AND NOT regexp_matches(host, '^[0-9.]*$')),
found AS (SELECT id, arg_min(k.service, w * 10 + turn) AS target, min(w) AS w FROM turns t JOIN keys k ON k.repo_id = t.repo_id AND k.tier = t.tier AND k.key = t.key GROUP BY 1)
SELECT r.id, target, CASE WHEN w < 2 THEN 'static' WHEN w = 2 THEN 'uncertain' END AS confidence FROM r LEFT JOIN found f ON f.id = r.id""").replace("HOST_EXPRESSION", _sql_braces(HOST))


@query("JN_07_topic_edges", "SELECT DISTINCT p.repo_id, p.topic_key, p.service AS source, c.service AS target FROM {d_mentions} p JOIN {d_mentions} c ON c.repo_id = p.repo_id AND c.topic_key = p.topic_key AND c.service <> p.service WHERE p.role IN ('producer', 'unknown') AND c.role IN ('consumer', 'unknown') AND NOT (p.role = 'unknown' AND c.role = 'unknown')")
def jn_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.topic_edges(load(spark, sf_dir, "d_mentions"))


@query("AG_03_topic_sides", "SELECT repo_id, topic_key, count(DISTINCT service) FILTER (role = 'producer') AS producers, count(DISTINCT service) FILTER (role = 'consumer') AS consumers, count(DISTINCT service) FILTER (role = 'unknown') AS unknown FROM {d_mentions} GROUP BY 1, 2")
def ag_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = resolve.topic_sides(load(spark, sf_dir, "d_mentions"))
    return sides.select("repo_id", "topic_key", *[F.size(c).cast("long").alias(c) for c in ("producers", "consumers", "unknown")])


@query("JN_08_brokers", "SELECT DISTINCT u.repo_id, 'kafka' AS family, u.service AS source, s.name AS target FROM {d_mentions} u JOIN {d_services} s ON s.repo_id = u.repo_id AND contains(coalesce(s.image, ''), 'kafka') AND s.name <> u.service")
def jn_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = load(spark, sf_dir, "d_mentions").select("repo_id", "service", F.lit("kafka").alias("family"))
    return resolve.brokers(uses, load(spark, sf_dir, "d_services"))


@query("JN_09_shared_keys", "WITH u AS (SELECT DISTINCT repo_id, topic_key AS db_key, service FROM {d_mentions}), d AS (SELECT DISTINCT repo_id, topic_key AS db_key FROM {d_mentions} WHERE role = 'producer' AND ordinal % 40 = 0) SELECT a.repo_id, a.db_key, a.service AS source, b.service AS target FROM u a JOIN u b ON a.repo_id = b.repo_id AND a.db_key = b.db_key AND a.service <> b.service JOIN d ON d.repo_id = a.repo_id AND d.db_key = a.db_key")
def jn_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = load(spark, sf_dir, "d_mentions").select("repo_id", F.col("topic_key").alias("db_key"), "service", ((F.col("role") == "producer") & (F.col("ordinal") % 40 == 0)).alias("declared"))
    return resolve.shared_keys(uses)


@query("AG_04_database_services", "SELECT repo_id, topic_key AS db_key, count(DISTINCT service) AS services FROM {d_mentions} GROUP BY 1, 2")
def ag_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.database_services(load(spark, sf_dir, "d_mentions").withColumnRenamed("topic_key", "db_key"))


@query("AG_05_symbols", "SELECT repo_id, service, role AS name, topic_key AS value, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, service, role ORDER BY o) AS place FROM (SELECT repo_id, service, role, topic_key, min(ordinal) AS o FROM {d_mentions} GROUP BY 1, 2, 3, 4)) WHERE place <= 8")
def ag_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.symbols(load(spark, sf_dir, "d_mentions").withColumnsRenamed({"role": "name", "topic_key": "value"})).drop("ordinal")


@query("JN_10_symbol_lookup", "WITH s AS (SELECT *, row_number() OVER (PARTITION BY repo_id, service, role ORDER BY o) AS place FROM (SELECT repo_id, service, role, topic_key, min(ordinal) AS o FROM {d_mentions} GROUP BY 1, 2, 3, 4)) SELECT u.ordinal, s.topic_key AS value FROM {d_mentions} u JOIN s ON s.repo_id = u.repo_id AND s.service = u.service AND s.role = u.role AND place <= 8")
def jn_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_mentions")
    table = resolve.symbols(rows.withColumnsRenamed({"role": "name", "topic_key": "value"}))
    uses = rows.select("repo_id", "service", "ordinal", F.concat(F.lit("Topics."), F.col("role")).alias("expression"))
    return resolve.look_up_symbols(uses, table).select("ordinal", "value")


@query("JN_06_proto_owners", f"WITH p AS (SELECT DISTINCT repo_id, CASE WHEN ordinal % 3 = 0 THEN 'Svc-' || (ordinal % 100) || '-Service' ELSE topic_key END AS proto FROM {{d_mentions}}), r AS (SELECT repo_id, topic_key AS proto, arg_min(service, ordinal) AS owner FROM {{d_mentions}} WHERE role = 'producer' GROUP BY 1, 2), n AS (SELECT repo_id, {NORM.format('name')} AS k, arg_min(name, pos) AS name FROM {{d_services}} GROUP BY 1, 2) SELECT p.repo_id, p.proto, coalesce(r.owner, n.name) AS owner FROM p LEFT JOIN r ON r.repo_id = p.repo_id AND r.proto = p.proto LEFT JOIN n ON n.repo_id = p.repo_id AND n.k = {NORM.format('p.proto')} WHERE coalesce(r.owner, n.name) IS NOT NULL")
def jn_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_mentions")
    protos = rows.select("repo_id", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("Svc-"), F.col("ordinal") % 100, F.lit("-Service"))).otherwise(F.col("topic_key")).alias("proto"))
    registered = rows.where(F.col("role") == "producer").withColumnRenamed("topic_key", "proto")
    return resolve.proto_owners(registered, protos, load(spark, sf_dir, "d_services"))


@query("JN_13_packages", "WITH u AS (SELECT DISTINCT repo_id, service, 'org/' || service || '/x.y' AS package, 'org/' || 'svc-' || (ordinal % 37) || '/sub' AS used FROM {d_mentions}), k AS (SELECT repo_id, 'org/' || name AS package, name AS owner FROM {d_services}) SELECT u.repo_id, u.service, u.used AS package, k.owner AS target FROM u JOIN k ON k.repo_id = u.repo_id AND k.package || '/sub' = u.used WHERE k.owner <> u.service")
def jn_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = load(spark, sf_dir, "d_mentions").select("repo_id", "service", F.concat(F.lit("org/svc-"), F.col("ordinal") % 37, F.lit("/sub")).alias("package")).distinct()
    known = load(spark, sf_dir, "d_services").select("repo_id", F.concat(F.lit("org/"), F.col("name")).alias("package"), F.col("name").alias("owner"), "pos")
    return resolve.packages(uses, known).select("repo_id", "service", "package", "target")


@query("JN_17_span_calls", "WITH c AS (SELECT p.service AS client, s.service AS server, p.span_id AS parent FROM {d_spans} s JOIN {d_spans} p ON p.span_id = s.parent_id AND p.service <> s.service) SELECT client, server, count(*) AS calls FROM (SELECT client, server FROM c UNION ALL SELECT service, peer FROM {d_spans} s WHERE peer IS NOT NULL AND peer <> service AND span_id NOT IN (SELECT parent FROM c)) GROUP BY 1, 2")
def jn_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = load(spark, sf_dir, "d_spans").withColumn("span_type", F.lit("client"))
    return runtime_calls.calls_of_spans(spans).groupBy("client", "server").agg(F.sum("calls").alias("calls"))


@query("AG_02_record_calls", "SELECT repo_id, client, server, sum(calls) AS calls, coalesce(arg_min(kind, ordinal) FILTER (kind <> 'unknown'), 'unknown') AS kind FROM {d_runtime} GROUP BY 1, 2, 3")
def ag_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime_calls.record(load(spark, sf_dir, "d_runtime"), ("repo_id",)).drop("first_seen")


NAMES = f"""names AS (SELECT DISTINCT 'repo-' || (id % 2) AS repo_id, variant AS runtime FROM {{d_names}} UNION SELECT 'repo-0', 'svc-4' UNION SELECT 'repo-0', 'SVC_6.api' UNION SELECT 'repo-0', 'svcc-22' UNION SELECT 'repo-0', 'pay' UNION SELECT 'repo-0', 'load-generator'),
mapping AS (SELECT n.repo_id, n.runtime, CASE WHEN n.runtime = 'load-generator' THEN NULL WHEN n.runtime = 'pay' THEN 'svc-8' ELSE coalesce(e.name, k.name, z.name) END AS service,
  CASE WHEN n.runtime = 'load-generator' THEN 'ignored' WHEN n.runtime = 'pay' THEN 'config' WHEN e.name IS NOT NULL THEN 'exact' WHEN k.name IS NOT NULL THEN 'normalised' WHEN z.name IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS how
  FROM names n LEFT JOIN {{d_services}} e ON e.repo_id = n.repo_id AND e.name = n.runtime
  LEFT JOIN (SELECT repo_id, {NORM.format('name')} AS key, arg_min(name, pos) AS name FROM {{d_services}} GROUP BY 1, 2) k ON k.repo_id = n.repo_id AND k.key = {NORM.format('n.runtime')}
  LEFT JOIN (SELECT a.repo_id, a.runtime, arg_max(s.name, struct_pack(x := jaro_winkler_similarity({NORM.format('a.runtime')}, {NORM.format('s.name')}), p := s.pos)) AS name FROM names a JOIN {{d_services}} s ON s.repo_id = a.repo_id WHERE length({NORM.format('a.runtime')}) >= 4 AND length({NORM.format('s.name')}) >= 4 AND jaro_winkler_similarity({NORM.format('a.runtime')}, {NORM.format('s.name')}) >= 0.9 GROUP BY 1, 2) z ON z.repo_id = n.repo_id AND z.runtime = n.runtime)"""


@query("JN_15_match_names", f"WITH {NAMES} SELECT repo_id, runtime, service, how FROM mapping")
def jn_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "d_names").select(F.concat(F.lit("repo-"), F.col("id") % 2).alias("repo_id"), F.col("variant").alias("runtime"))
    more = spark.createDataFrame([("repo-0", n) for n in ("svc-4", "SVC_6.api", "svcc-22", "pay", "load-generator")], "repo_id string, runtime string")
    return runtime_join.match_names(own.unionByName(more), load(spark, sf_dir, "d_services"), {"pay": "svc-8"}, ("load-generator",)).drop("score")


MERGE = f"""{FOLDED},
rec AS (SELECT repo_id, client, server, sum(calls) AS calls, coalesce(arg_min(kind, ordinal) FILTER (kind <> 'unknown'), 'unknown') AS kind, min(ordinal) AS first_seen FROM {{d_runtime}} GROUP BY 1, 2, 3),
known AS (SELECT r.*, s.name AS source, t.name AS target FROM rec r LEFT JOIN {{d_services}} s ON s.repo_id = r.repo_id AND s.name = r.client LEFT JOIN {{d_services}} t ON t.repo_id = r.repo_id AND t.name = r.server),
sums AS (SELECT repo_id, source, target, CASE WHEN kind IN ('event', 'database') THEN kind ELSE 'call' END AS class, sum(calls) AS calls, arg_min(kind, first_seen) AS kind, count(*) AS n FROM known WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target GROUP BY 1, 2, 3, 4),
joined AS (SELECT coalesce(e.repo_id, s.repo_id) AS repo_id, coalesce(e.source, s.source) AS source, coalesce(e.target, s.target) AS target, coalesce(e.type_ord, CASE s.kind WHEN 'grpc' THEN 2 WHEN 'event' THEN 1 WHEN 'database' THEN 3 ELSE 0 END) AS type_ord, CASE WHEN s.repo_id IS NOT NULL THEN 3 ELSE e.conf_rank END AS conf_rank, s.calls, s.repo_id IS NOT NULL AS seen, e.repo_id IS NULL AS runtime_only, CASE WHEN e.repo_id IS NOT NULL THEN s.n END AS confirms, e.n_evidence, e.evidence
  FROM (SELECT *, CASE WHEN type_ord IN (0, 2) THEN 'call' WHEN type_ord = 1 THEN 'event' WHEN type_ord = 3 THEN 'database' ELSE 'import' END AS class FROM edges) e FULL JOIN sums s ON s.repo_id = e.repo_id AND s.source = e.source AND s.target = e.target AND s.class = e.class)"""


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "d_runtime")
    names = rows.select("repo_id", F.explode(F.array("client", "server")).alias("runtime"))
    mapping = runtime_join.match_names(names, load(spark, sf_dir, "d_services"))
    return runtime_join.resolved(runtime_calls.record(rows, ("repo_id",)), mapping), mapping


@query("JN_16_merge_calls", f"WITH {MERGE} SELECT repo_id, source, target, {TYPE} AS type, {CONF.format('conf_rank')} AS confidence, calls, CASE WHEN seen THEN coalesce(CAST(calls AS VARCHAR) || ' calls', 'observed') || ' (otel servicegraph)' END AS detail, runtime_only FROM joined")
def jn_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, _ = _resolved(spark, sf_dir)
    out = runtime_join.merge(merged(spark, sf_dir).select("repo_id", "source", "target", "type_ord", "conf_rank"), calls)
    return out.select("repo_id", "source", "target", type_label(F.col("type_ord")).alias("type"), confidence_label(F.col("conf_rank")).alias("confidence"), "calls", "detail", "runtime_only")


@query("JN_16_evidence", f"WITH {MERGE} SELECT repo_id, source, target, {TYPE} AS type, calls, CASE WHEN seen THEN 'calls.prom: ' || coalesce(CAST(calls AS VARCHAR) || ' calls', 'observed') || ' (otel servicegraph)' END AS first_piece, least(coalesce(n_evidence, 0), 25) + CASE WHEN seen THEN 1 ELSE 0 END AS pieces, evidence AS others FROM joined")
def jn_16_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, _ = _resolved(spark, sf_dir)
    out = runtime_join.merge(merged(spark, sf_dir), calls, read_from="calls.prom")
    first = F.get("evidence", F.lit(0))
    files = F.filter("evidence", lambda e: e["line"].isNotNull())
    others = F.nullif(F.array_join(F.transform(files, lambda e: F.concat_ws(":", e["file"], e["line"])), ","), F.lit(""))
    piece = F.when(first["line"].isNull(), F.concat_ws(": ", first["file"], first["detail"]))
    return out.select("repo_id", "source", "target", type_label(F.col("type_ord")).alias("type"), "calls", piece.alias("first_piece"), F.size("evidence").cast("long").alias("pieces"), others.alias("others"))


@query("AG_17_runtime_summary", f"WITH {MERGE}, n AS (SELECT DISTINCT repo_id, x FROM (SELECT repo_id, client AS x FROM {{d_runtime}} UNION SELECT repo_id, server FROM {{d_runtime}})) SELECT repo_id, (SELECT count(*) FROM n) AS runtime, (SELECT count(*) FROM n JOIN {{d_services}} s ON s.repo_id = n.repo_id AND s.name = n.x) AS matched, (SELECT count(*) FROM n WHERE x NOT IN (SELECT name FROM {{d_services}} WHERE repo_id = 'repo-0')) AS unmatched, count(*) FILTER (seen) AS observed, count(*) FILTER (runtime_only) AS runtime_only, (SELECT count(*) FROM known WHERE source IS NULL OR target IS NULL) AS skipped, (SELECT sum(n) FROM (SELECT max(coalesce(confirms, 0)) AS n FROM joined WHERE repo_id = 'repo-0' GROUP BY source, target, CASE WHEN type_ord IN (0, 2) THEN 0 ELSE type_ord END))::BIGINT AS confirmed FROM joined WHERE repo_id = 'repo-0' GROUP BY 1")
def ag_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, mapping = _resolved(spark, sf_dir)
    out = runtime_join.merge(merged(spark, sf_dir).select("repo_id", "source", "target", "type_ord", "conf_rank"), calls)
    return runtime_join.counts(out, calls, mapping)


@query("AG_21_discovery_choice", "WITH a AS (SELECT 'r' || n_regionkey AS repo_id, CASE s_suppkey % 3 WHEN 0 THEN 'docker-compose' WHEN 1 THEN 'kubernetes' ELSE 'monorepo' END AS strategy, CAST(s_suppkey % 3 AS INT) AS ord, count(*) FILTER (s_acctbal > 8000) AS code, count(*) AS services FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY 1, 2, 3), c AS (SELECT repo_id, min(ord) FILTER (code > 1) AS first, arg_max(ord, struct_pack(a := code, b := services, c := -ord)) AS best, max(ord) AS last FROM a GROUP BY 1) SELECT c.repo_id, a.strategy, coalesce(first, last) + 1 AS tried FROM c JOIN a ON a.repo_id = c.repo_id AND a.ord = coalesce(first, best)")
def ag_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ord_ = (F.col("s_suppkey") % 3).cast("int")
    name = F.when(ord_ == 0, "docker-compose").when(ord_ == 1, "kubernetes").otherwise("monorepo")
    attempts = rows.groupBy(F.concat(F.lit("r"), "n_regionkey").alias("repo_id"), name.alias("strategy"), ord_.alias("ord")).agg(F.count_if(F.col("s_acctbal") > 8000).alias("code"), F.count("*").alias("services"))
    return discovery_choice(attempts)


@query("JN_05_templates", None)
def jn_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_env").select("id", F.concat(F.lit("repo-"), F.col("id") % 2).alias("repo_id"), _host(F.col("value")).alias("host"))
    found = resolve.hosts(rows, resolve.service_keys(load(spark, sf_dir, "d_services")))
    parts = found.select("repo_id", F.floor(F.col("id") / 8).alias("id"), F.col("id").alias("pos"), "target", F.lit(2).alias("conf_rank"))
    return resolve.templates(parts).select("repo_id", "id", "target")


ORACLE_SQL["JN_05_templates"] = oracle(f"WITH {KEYS}, {HOSTS} SELECT a.repo_id, CAST(floor(a.id / 8) AS BIGINT) AS id, arg_min(t.target, a.id) AS target FROM asked a JOIN targets t ON t.id = a.id GROUP BY 1, 2").replace("HOST_EXPRESSION", _sql_braces(HOST))


@query("TK_02_unresolved", None)
def tk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_env").select("id", F.concat(F.lit("repo-"), F.col("id") % 2).alias("repo_id"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("lost-"), (F.col("id") % 60).cast("string"))).otherwise(_host(F.col("value"))).alias("host"))
    found = resolve.hosts(rows, resolve.service_keys(load(spark, sf_dir, "d_services")))
    return resolve.unresolved(found).select("repo_id", "unresolved", F.array_join("names", ",").alias("names"))


ORACLE_SQL["TK_02_unresolved"] = oracle(f"WITH {KEYS}, {HOSTS}, u AS (SELECT a.repo_id, a.host FROM asked a LEFT JOIN targets t ON t.id = a.id WHERE t.target IS NULL AND a.host IS NOT NULL AND NOT regexp_matches(a.host, '^[0-9.]*$')), d AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY host) AS n FROM (SELECT DISTINCT repo_id, host FROM u)) SELECT repo_id, (SELECT count(*) FROM u WHERE u.repo_id = d.repo_id) AS unresolved, string_agg(host, ',' ORDER BY host) AS names FROM d WHERE n <= 50 GROUP BY 1").replace("HOST_EXPRESSION", f"CASE WHEN id % 7 = 0 THEN 'lost-' || (id % 60) ELSE {_sql_braces(HOST)} END")
