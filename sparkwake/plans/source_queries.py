"""Queries of readers, extraction, set operations, look-ups and sinks, most with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.functions import scalars as S
from sparkwake.operators import extract, findings, resolve, review, sinks, walk
from sparkwake.operators.discover import first_by
from sparkwake.plans.derived import load, oracle
from sparkwake.plans.graph_queries import CONF, FOLDED, OWNED, TYPE, change_seeds, graph, merged, of_parts
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


KIND = "CASE event_id % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '{}' END"


@query("SRC_19_prometheus", f"SELECT event_id AS ordinal, 'svc-' || (user_id % 20) AS client, 'svc-' || (event_id % 30) AS server, CAST(round(greatest(event_id / 4.0, 0)) AS BIGINT) AS calls, {KIND.format('event', 'database', 'unknown')} AS kind FROM {{events}} WHERE event_id % 10 < 8")
def src_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "messaging_system").when(F.col("event_id") % 3 == 1, "database").otherwise("")
    sample = F.format_string('traces_service_graph_request_total{client="svc-%d",le="a,b",server="svc-%d",connection_type="%s"} %s 1700000000', F.col("user_id") % 20, F.col("event_id") % 30, kind, (F.col("event_id") / 4).cast("string"))
    line = F.when(F.col("event_id") % 10 == 8, F.concat(F.lit("# "), sample)).when(F.col("event_id") % 10 == 9, F.replace(sample, F.lit("request_total"), F.lit("failed_total"))).otherwise(sample)
    return runtime_calls.prometheus(load(spark, sf_dir, "events").select(line.alias("value"), F.col("event_id").alias("ordinal")))


@query("SRC_20_otlp_spans", "SELECT span_id, parent_id, service, peer, CASE kind WHEN 'database' THEN 'database' WHEN 'grpc' THEN 'grpc' WHEN 'event' THEN 'event' ELSE 'http' END AS kind FROM {d_spans}")
def src_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = load(spark, sf_dir, "d_spans")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    system = {"event": "messaging.system", "database": "db.system", "grpc": "rpc.system"}
    own = [F.when(F.col("kind") == k, pair(a, F.lit("grpc"))) for k, a in system.items()] + [F.when(F.col("peer").isNotNull(), pair("peer.service", F.col("peer")))]
    span = F.struct(F.col("span_id").alias("spanId"), F.col("parent_id").alias("parentSpanId"), F.lit("SPAN_KIND_CLIENT").alias("kind"), F.array_compact(F.array(*own)).alias("attributes"))
    scope = F.array(F.struct(F.array(span).alias("spans")))
    resource = F.struct(F.struct(F.array(pair("service.name", F.col("service"))).alias("attributes")).alias("resource"), scope.alias("scopeSpans"))
    parsed = runtime_calls.otlp_spans(spans.select(F.to_json(F.struct(F.array(resource).alias("resourceSpans"))).alias("value")))
    return parsed.select("span_id", "parent_id", "service", "peer", "kind")


@query("SRC_21_datadog", "SELECT name AS client, 'svc-' || (pos + 1) AS server FROM {d_services} UNION ALL SELECT name, 'svc-' || (pos * 2) FROM {d_services} WHERE pos % 2 = 0 UNION ALL SELECT name, NULL FROM {d_services} WHERE pos % 2 = 0")
def src_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = F.format_string('["svc-%d"]', F.col("pos") + 1), F.format_string('["svc-%d", 7, "svc-%d"]', F.col("pos") + 1, F.col("pos") * 2)
    text = F.format_string('{"%s": {"%s": %s}}', "name", F.when(F.col("pos") % 2 == 0, "calls").otherwise("calls_out"), F.when(F.col("pos") % 2 == 0, two).otherwise(one))
    return runtime_calls.datadog(load(spark, sf_dir, "d_services").select(text.alias("value"))).select("client", "server")


@query("SC_12_env_defaults", "SELECT id, variable AS name, CASE WHEN id % 4 < 3 THEN 'dflt' || id END AS fallback FROM {d_env}")
def sc_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [F.concat("variable", F.lit(x), F.lit("dflt"), F.col("id").cast("string")) for x in (":", ":-", "?")]
    text = F.when(F.col("id") % 4 == 0, forms[0]).when(F.col("id") % 4 == 1, forms[1]).when(F.col("id") % 4 == 2, forms[2]).otherwise(F.col("variable"))
    return load(spark, sf_dir, "d_env").select("id", S.env_name(text).alias("name"), S.env_default(text).alias("fallback"))


#: Literals and whether they name a topic; imports and their broker. Each part takes one in turn.
TOPICS = (
    ("orders.created", True), ("GET", False), ("queue", False), ("user.*.#", True), ("/orders", False), ("two words", False), ("$share", False), ("amqp://host", False), ("x", False), ("a1", True), ("12", False), ("-dash", False),
    (".dot", False), ("localhost", False), ("exchange", False), ("OrderPaidEvent", True), ("event", False), ("events:paid", True), ("application/json", False), ("_private/topic", True), ("t" * 120, True), ("t" * 121, False),
)
IMPORTS = (
    ("Confluent.Kafka", "kafka"), ("github.com/streadway/amqp", "rabbitmq"), ("nats-py", "nats"), ("left-pad", None), ("kombu.mixins", "rabbitmq"), ("bunny", "rabbitmq"), ("github.com/Shopify/sarama", "kafka"), ("paho.client", "mqtt"),
    ("kafka-amqp-bridge", "rabbitmq"), ("MassTransit.RabbitMqTransport", "rabbitmq"), ("MassTransit", None), ("stomp", None), ("jakarta.jms.Queue", "activemq"), ("azure.eventhub", "eventhub"), ("Azure.Messaging.ServiceBus", "servicebus"),
    ("@aws-sdk/client-sqs", "sqs"), ("aws.sns", "sns"), ("org.apache.pulsar", "pulsar"), ("apache-artemis", "activemq"),
)


def _in_turn(cases: tuple) -> F.Column:
    return F.get(F.array(*[F.lit(text) for text, _ in cases]), (F.col("p_partkey") % len(cases)).cast("int"))


def _expected(cases: tuple, name: str) -> str:
    value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper()
    whens = " ".join(f"WHEN {k} THEN {value(x)}" for k, (_, x) in enumerate(cases))
    return f"SELECT p_partkey, CASE p_partkey % {len(cases)} {whens} END AS {name} FROM {{part}}"


@query("SC_18_topic_keys", _expected(TOPICS, "is_key"))
def sc_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", S.is_topic_key(_in_turn(TOPICS)).alias("is_key"))


@query("SC_19_broker_families", _expected(IMPORTS, "family"))
def sc_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", S.broker_family(_in_turn(IMPORTS)).alias("family"))


@query("SC_21_relative_paths", "SELECT name, CASE WHEN root IS NOT NULL THEN regexp_replace(root, '/svc_.*$', '') || '/lib/x' END AS path FROM {d_services}")
def sc_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "d_services").select("name", F.when(F.col("root").isNotNull(), S.resolve_relative(F.col("root"), F.lit("..\\lib\\./x"))).alias("path"))


@query("ST_02_union_distinct", "SELECT DISTINCT repo_id, file FROM (SELECT repo_id, file FROM {d_changes} WHERE pos % 2 = 0 UNION ALL SELECT repo_id, file FROM {d_changes} WHERE pos % 3 = 0)")
def st_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_changes")
    return findings.union_distinct(*(rows.where(F.col("pos") % n == 0).select("repo_id", "file") for n in (2, 3)))


@query("WN_02_first_by_preference", "SELECT repo_id, root_or_none, name FROM (SELECT repo_id, coalesce(image, 'none') AS root_or_none, name, row_number() OVER (PARTITION BY repo_id, coalesce(image, 'none') ORDER BY CASE role WHEN 'code' THEN 0 ELSE 1 END, pos) AS n FROM {d_services}) WHERE n = 1")
def wn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_services").withColumn("root_or_none", F.coalesce("image", F.lit("none")))
    return first_by(rows, ["repo_id", "root_or_none"], [F.when(F.col("role") == "code", 0).otherwise(1), F.asc("pos")]).select("repo_id", "root_or_none", "name")


@query("FL_12_text_filter", "SELECT repo_id, name FROM {d_services} WHERE contains(lower(name), '1') OR contains(lower(coalesce(image, '')), 'redis')")
def fl_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.with_text(load(spark, sf_dir, "d_services"), name="1", image="Redis").select("repo_id", "name")


@query("QY_03_edges_of_service", f"WITH {FOLDED} SELECT 0 AS side, source, target, {TYPE} AS type FROM edges WHERE source = 'svc-3' UNION ALL SELECT 1, source, target, {TYPE} FROM edges WHERE target = 'svc-3'")
def qy_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwake.functions.labels import type_label

    return findings.edges_of(graph(spark, sf_dir), "svc-3").select("side", "source", "target", type_label(F.col("type_ord")).alias("type"))


@query("SNK_01_edges_json", f"WITH {FOLDED} SELECT repo_id, '{{\"source\":\"' || source || '\",\"target\":\"' || target || '\",\"type\":\"' || {TYPE} || '\",\"confidence\":\"' || {CONF.format('conf_rank')} || '\",\"evidence\":[' || (SELECT string_agg('{{\"file\":\"' || r.file || '\",\"line\":' || r.line || '}}', ',' ORDER BY pos) FROM ranked r WHERE r.repo_id = e.repo_id AND r.source = e.source AND r.target = e.target AND r.type_ord = e.type_ord AND pos <= 25) || ']}}' AS json FROM edges e".replace("{{", "{").replace("}}", "}"))
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.edges_json(merged(spark, sf_dir).withColumn("calls", F.lit(None).cast("long")))


#: Every walk of a change with its hops, in the order in which a queue finds them; the first of the best to a service counts.
LINKS = f"""WITH RECURSIVE {FOLDED}, {OWNED},
code AS (SELECT repo_id, name FROM {{d_services}} WHERE role = 'code'),
hops AS (
  SELECT e.repo_id, target AS node, source AS dest, CASE type_ord WHEN 3 THEN 'shares-database' WHEN 4 THEN 'imports' ELSE 'calls' END AS relation, conf_rank, CAST(NULL AS VARCHAR) AS via, FALSE AS seed_only, 0 AS side, source AS a, type_ord AS b, '' AS c, 0 AS d FROM edges e JOIN code k ON k.repo_id = e.repo_id AND k.name = source WHERE type_ord <> 1
  UNION ALL SELECT e.repo_id, source, target, 'consumes', conf_rank, NULL, FALSE, 1, target, 0, '', 0 FROM edges e JOIN code k ON k.repo_id = e.repo_id AND k.name = target WHERE type_ord = 1
  UNION ALL SELECT e.repo_id, e.source, k.source, 'shares-broker', 0, e.target, TRUE, 1, e.target, 1, k.source, k.type_ord FROM edges e JOIN edges k ON k.repo_id = e.repo_id AND k.target = e.target AND k.source <> e.source JOIN code x ON x.repo_id = k.repo_id AND x.name = k.source
    WHERE e.type_ord = 1 AND NOT EXISTS (SELECT 1 FROM code x WHERE x.repo_id = e.repo_id AND x.name = e.target)),
steps AS (SELECT *, row_number() OVER (PARTITION BY repo_id, node ORDER BY side, a, b, c, d, relation, via NULLS FIRST) AS hop_no FROM hops),
walk AS (
  SELECT change_id, repo_id, service, 3 AS rank, 0 AS depth, [row_number() OVER (PARTITION BY change_id, repo_id ORDER BY service)] AS ord, CAST([] AS STRUCT(source VARCHAR, target VARCHAR, relation VARCHAR, confidence VARCHAR)[]) AS path FROM seeds
  UNION ALL SELECT w.change_id, w.repo_id, s.dest, least(w.rank, s.conf_rank), w.depth + 1, list_append(w.ord, s.hop_no), list_append(w.path, struct_pack(source := s.node, target := s.dest, relation := s.relation, confidence := {CONF.format('s.conf_rank')}))
    FROM walk w JOIN steps s ON s.repo_id = w.repo_id AND s.node = w.service WHERE w.depth < 3 AND (w.depth = 0 OR NOT s.seed_only) AND NOT EXISTS (SELECT 1 FROM seeds z WHERE z.change_id = w.change_id AND z.repo_id = w.repo_id AND z.service = s.dest)),
best AS (SELECT * FROM walk WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY change_id, repo_id, service ORDER BY rank DESC, depth, ord) = 1),
weak AS (SELECT change_id, repo_id, depth, rank, service, unnest(range(len(path))) AS place, unnest(path) AS hop FROM best),
first AS (
  SELECT change_id, repo_id, hop.source AS source, hop.target AS target, hop.relation AS relation, min(struct_pack(depth := depth, rank := -rank, low := lower(service), service := service, place := place)) AS first, min(hop.confidence) AS confidence
  FROM weak WHERE hop.confidence IN ('inferred', 'uncertain') GROUP BY ALL),
asked AS (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY first, repo_id, source, target, relation) AS n FROM first QUALIFY n <= 20),
proof AS (SELECT repo_id, source, target, arg_max(least(n_evidence, 3), conf_rank * 10 - type_ord) AS pieces FROM edges GROUP BY 1, 2, 3)
SELECT change_id, q.repo_id, CAST(n AS INT) AS n, q.source, q.target, relation, confidence, coalesce(pieces, 0) AS pieces FROM asked q
LEFT JOIN proof p ON p.repo_id = q.repo_id AND p.source = CASE relation WHEN 'consumes' THEN q.source ELSE q.target END AND p.target = CASE relation WHEN 'consumes' THEN q.target ELSE q.source END"""


@query("JN_23_links_for_review", of_parts(LINKS))
def jn_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = change_seeds(spark, sf_dir, "d_pulls", "d_parts")
    reached = walk.reach_paths(walk.steps(graph(spark, sf_dir, "d_uses"), load(spark, sf_dir, "d_parts")), seeds)
    asked = review.evidence(review.links(reached), merged(spark, sf_dir, "d_uses"))
    return asked.select("change_id", "repo_id", "n", "source", "target", "relation", "confidence", F.size(F.coalesce("evidence", F.array().cast("array<struct<file:string,line:int,detail:string>>"))).alias("pieces"))


@query("JN_24_verdicts", "SELECT c.change_id, c.file AS source, c.repo_id AS target, coalesce(v.verdict, 'unclear') AS verdict, coalesce(v.reason, 'not judged') AS reason FROM (SELECT DISTINCT change_id, file, repo_id FROM {d_changes}) c LEFT JOIN (SELECT change_id, file, repo_id, arg_min('real', pos) AS verdict, arg_min('seen at ' || pos, pos) AS reason FROM {d_changes} WHERE pos % 2 = 1 GROUP BY 1, 2, 3) v ON v.change_id = c.change_id AND v.file = c.file AND v.repo_id = c.repo_id")
def jn_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_changes").withColumnsRenamed({"file": "source", "repo_id": "target"})
    said = rows.where(F.col("pos") % 2 == 1).select("change_id", "source", "target", F.lit("real").alias("verdict"), F.concat(F.lit("seen at "), F.col("pos").cast("string")).alias("reason"), F.col("pos").alias("ordinal"))
    return review.verdicts(rows.select("change_id", "source", "target").distinct(), said)


@query("AG_06_mapping_stats", "SELECT repo_id, count(*) FILTER (NOT contains(file, 'region_')) AS files_outside_services, count(*) FILTER (contains(file, 'region_') AND pos % 2 = 0) AS files_scanned FROM (SELECT DISTINCT change_id, repo_id, file, pos FROM {d_changes}) GROUP BY 1")
def ag_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "d_changes").select("change_id", "repo_id", "file", "pos").distinct()
    ext = F.when(F.col("pos") % 2 == 0, "py").otherwise("bin")
    files = rows.select("repo_id", F.concat(F.concat_ws("#", "change_id", "file", F.col("pos").cast("string")), F.lit("."), ext).alias("path"), ext.alias("ext"), F.lit(10).cast("long").alias("size"))
    return extract.mapping_stats(files, files.where(F.contains("path", F.lit("region_"))).select("repo_id", "path")).select("repo_id", "files_outside_services", "files_scanned")


@query("WN_05_once_per_file", "SELECT service, family_key, min(ordinal) AS ordinal FROM (SELECT service, topic_key AS family_key, ordinal FROM {d_mentions}) GROUP BY 1, 2")
def wn_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.once(load(spark, sf_dir, "d_mentions"), ("service", "topic_key")).select("service", F.col("topic_key").alias("family_key"), "ordinal")
