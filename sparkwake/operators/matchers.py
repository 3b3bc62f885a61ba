"""Facts to candidates: what each file mentions, by kind of target, then to edges by the resolver's joins.

The five matchers run as filters over one table of facts; `matchers` maps their names to functions (facts, context) ->
candidates, to which more can be added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwake.functions import scalars as S
from sparkwake.functions.messaging import DECLARES, HANDLERS, LISTENERS, NO_HANDLERS, RECEIVE_TYPES, RECEIVES, SEND_TYPES, SENDERS, SENDS, SPEAKERS, TOPIC_KEYS
from sparkwake.operators import resolve
from sparkwake.functions.labels import type_order
from sparkwake.operators.edges import DATABASE, EVENT, GRPC, IMPORT
from sparkwake.session import stored


#: Last parts of settings' keys that name an address.
HOST_WORDS = (
    "host", "hostname", "hosts", "url", "uri", "addr", "address", "endpoint", "server", "servers", "brokers", "bootstrap-servers", "bootstrap_servers", "bootstrapservers", "nodes", "seeds",
    "contact-points", "contactpoints", "connection-string", "connectionstring", "connection_string", "dsn",
)


@dataclass
class Context:
    """services (repo_id, name, root, role, image, package, pos), own and shared environment, and host keys."""

    services: DataFrame
    env_own: DataFrame
    env_shared: DataFrame
    keys: DataFrame


COLUMNS = ("repo_id", "source", "target", "type_ord", "conf_rank", "file", "line", "detail", "ordinal", "db_key")


def _shape(rows: DataFrame, type_ord: Column, rank: Column, detail: Column, db_key: Column | None = None) -> DataFrame:
    key = F.lit(None).cast("string") if db_key is None else db_key
    return rows.select("repo_id", F.col("service").alias("source"), "target", type_ord.cast("int").alias("type_ord"), rank.cast("int").alias("conf_rank"), F.col("path").alias("file"), "line", detail.alias("detail"), F.col("ordinal").cast("long").alias("ordinal"), key.alias("db_key")).where(F.col("target").isNotNull() & (F.col("source") != F.col("target")))


def host_of(text: Column) -> Column:
    """The host that a value names: a URL's, host:port's, a connection string's, or the value itself if it is a host name."""
    return F.coalesce(S.url_host(text), S.host_of_pair(text), S.ado_host(text), F.when(S.is_hostname(text), F.lower(text)))


def _type(ctx: Context, rows: DataFrame, text: str) -> DataFrame:
    kinds = resolve.with_kind(ctx.services).select("repo_id", F.col("name").alias("target"), "kind")
    typed = S.edge_type(S.url_scheme(F.col(text)), F.col("kind"), F.lit(False), S.host_of_pair(F.col(text)).isNotNull())
    return rows.join(kinds, ["repo_id", "target"], "left").withColumn("type_ord", type_order(typed))


def http(facts: DataFrame, ctx: Context) -> DataFrame:
    """URLs and host:port (static), plain names of datastores and brokers, and variables of the environment that hold an
    address: by value or default static, by name uncertain."""
    texts = facts.where(F.col("kind").isin("string", "setting", "assign") & F.col("value").isNotNull())
    strict = F.coalesce(S.url_host(F.col("value")), S.host_of_pair(F.col("value")), S.ado_host(F.col("value")))
    host_key = F.regexp_extract("name", r"([^.\[]+)(?:\[[^\]]*\])?$", 1)
    is_host = (F.col("kind") == "setting") & (F.lower(host_key).isin(*HOST_WORDS) | S.is_hostish(F.col("name"))) & S.is_hostname(F.col("value"))
    strict = F.coalesce(strict, F.when(is_host, F.lower("value")))
    named = _type(ctx, resolve.hosts(texts.withColumn("host", strict).drop("kind").where(F.col("host").isNotNull() & ~F.contains("host", F.lit("$"))), ctx.keys), "value")
    by_text = _shape(named, F.col("type_ord"), F.lit(2), F.col("value"))
    plain = texts.where(F.col("kind") != "setting").withColumn("host", F.when(S.is_hostname(F.col("value")), F.lower("value"))).where(F.col("host").isNotNull()).drop("kind")
    bare = _type(ctx, resolve.hosts(plain, ctx.keys), "value").where(F.col("kind").isin("datastore", "broker"))
    by_name = _shape(bare, F.col("type_ord"), F.lit(0), F.col("value"))
    refs = facts.where((F.col("kind") == "env") & S.is_hostish(F.col("name"))).drop("kind", "value").withColumnsRenamed({"name": "variable"})
    valued = resolve.variables(refs, ctx.env_own, ctx.env_shared, ctx.keys, host_of(F.col("text")))
    typed = _type(ctx, valued.withColumn("shown", F.coalesce("value", "default", "variable")), "shown")
    by_env = _shape(typed, F.col("type_ord"), F.col("conf_rank"), F.concat_ws("=", "variable", F.coalesce("value", "default")))
    return by_text.unionByName(by_name).unionByName(by_env).unionByName(_templates(facts, ctx)).unionByName(_feign(facts, ctx))


def _templates(facts: DataFrame, ctx: Context) -> DataFrame:
    """Texts with variables in them, part by part: the first that finds a service counts. A literal's host must be whole: more
    follows it in the literal, or nothing in the text. A variable finds one by its value or default (static), else by its
    name (uncertain). An argument of a call counts if it has a scheme, other texts also if a variable is named as an address."""
    key = ("repo_id", "service", "path", "line", "ordinal", "whole")
    rows = facts.where(F.col("kind").isin("template", "call_template") & F.col("value").isNotNull()).withColumn("parts", S.template_parts(F.col("value")))
    scheme = F.exists("parts", lambda p: ~p["is_var"] & F.contains(p["text"], F.lit("://")))
    named = F.exists("parts", lambda p: p["is_var"] & F.coalesce(S.is_hostish(S.env_name(p["text"])), F.lit(False)))
    told = rows.where(scheme | ((F.col("kind") == "template") & named)).withColumnsRenamed({"value": "whole"})
    parts = told.select(*key, F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "p")).select(*key, "n", "pos", "p.is_var", F.col("p.text").alias("part"))
    refs = parts.where("is_var").select(*key, "pos", F.coalesce(S.env_name(F.col("part")), F.col("part")).alias("variable"), S.env_default(F.col("part")).alias("default"))
    valued = resolve.variables(refs, ctx.env_own, ctx.env_shared, ctx.keys, host_of(F.col("text"))).withColumn("shown", F.coalesce("value", "default", "variable"))
    host = S.url_host(F.col("part"))
    rest = F.regexp_replace("part", r"^.*?://", "")
    complete = (F.length(rest) > F.length(host)) | (F.col("pos") + 1 == F.col("n"))
    literal = parts.where(~F.col("is_var")).withColumn("host", F.when(complete, host)).where(F.col("host").isNotNull()).withColumn("conf_rank", F.lit(2)).withColumn("shown", F.col("part"))
    columns = [*key, "pos", "target", "conf_rank", "shown"]
    each = _type(ctx, valued.select(*columns).unionByName(resolve.hosts(literal, ctx.keys).select(*columns)), "shown")
    best = resolve.templates(each.select(*columns, "type_ord"), key, ("type_ord",))
    return _shape(best, F.col("type_ord"), F.col("conf_rank"), F.col("whole"))


def _feign(facts: DataFrame, ctx: Context) -> DataFrame:
    """Services that a client's annotation names, by URL or name (static)."""
    said = facts.where((F.col("kind") == "annotation") & F.col("name").rlike(r"FeignClient$")).drop("kind").withColumn("host", F.coalesce(S.url_host(F.col("value")), F.lower("value")))
    found = _type(ctx, resolve.hosts(said, ctx.keys), "value")
    return _shape(found, F.col("type_ord"), F.lit(2), F.concat(F.lit("@FeignClient "), F.col("value")))


def grpc(facts: DataFrame, ctx: Context) -> DataFrame:
    """Client stubs to the service that registers the server of that name first, or bears the name."""
    calls = facts.where(F.col("kind") == "stub")
    method = F.element_at(F.split(F.col("name"), r"\.|::|->"), -1)
    stub = F.coalesce(*[F.nullif(F.regexp_extract(method, p, 1), F.lit("")) for p in (r"^New([A-Z]\w{2,})Client$", r"^([A-Z]\w{2,})Client$", r"^([A-Z]\w{2,})Stub$")])
    server = F.coalesce(*[F.nullif(F.regexp_extract(method, p, 1), F.lit("")) for p in (r"^Register([A-Z]\w{2,})Server$", r"^add_([A-Z]\w{2,})Servicer_to_server$")])
    noise = ("Http", "Redis", "Mongo", "Kafka", "Web", "Rest", "Grpc")
    named = calls.withColumn("proto", stub).where(F.col("proto").isNotNull())
    declared = facts.where(F.col("kind") == "proto").select("repo_id", F.col("name").alias("proto")).distinct()
    # a name of the list is a client of something else, unless a .proto file declares a service of that name
    stubs = named.where(~F.col("proto").isin(*noise)).unionByName(named.where(F.col("proto").isin(*noise)).join(declared, ["repo_id", "proto"], "left_semi").select(named.columns))
    registered = calls.withColumn("proto", server).where(F.col("proto").isNotNull()).select("repo_id", "proto", "service", "ordinal")
    owners = resolve.proto_owners(registered, stubs, ctx.services).withColumnRenamed("owner", "target")
    return _shape(stubs.join(owners, ["repo_id", "proto"]), F.lit(GRPC), F.lit(2), F.col("proto"))


def mentions(facts: DataFrame) -> DataFrame:
    """Topics: repo_id, topic_key, service, role, path, line, ordinal. A name in the place of a literal stands for the
    values bound to it in the same service; a typed event's topic is its type, and a handler's base type names what it
    consumes. In a literal among the arguments, values of topic keys count, and those of a list."""
    used = ("call", "call_name", "call_key", "annotation", "annotation_name", "assign", "event_type", "extends")
    facts = stored(facts.where(F.col("kind").isin(*used)), "facts")  # read five times
    callee = F.element_at(F.split("name", "#"), 1)
    method, receiver = S.callee_method(callee), S.callee_receiver(callee)
    last_key = F.when(F.contains("name", F.lit("#")), F.element_at(F.split(F.element_at(F.split("name", "#"), -1), r"\."), -1))
    send = F.coalesce(receiver, F.lit("")).rlike("|".join(SENDERS)) & method.isin("send", "sendasync", "emit", "writemessages")
    noted = F.col("kind").isin("annotation", "annotation_name")
    short = F.element_at(F.split("name", r"\."), -1)
    called = F.col("kind").isin("call", "call_name", "call_key")
    made = called & (F.col("kind") != "call_name")
    role = F.when(noted & short.isin(*LISTENERS), "consumer").when(noted & short.isin(*SPEAKERS), "producer").when(made & callee.rlike(SEND_TYPES), "producer").when(made & callee.rlike(RECEIVE_TYPES), "consumer").when(called & (method.isin(*SENDS) | send), "producer").when(called & method.isin(*RECEIVES), "consumer").when(called & method.isin(*DECLARES), "unknown")
    columns = ["repo_id", "topic_key", "service", "role", "path", "line", "ordinal"]
    own = facts.withColumn("role", role).where(F.col("role").isNotNull() & F.col("value").isNotNull())
    topical = (F.col("kind") != "call_key") | last_key.isNull() | last_key.rlike(TOPIC_KEYS)
    literal = own.where(F.col("kind").isin("call", "annotation", "call_key") & topical).withColumnRenamed("value", "topic_key")
    bound = resolve.symbols(facts.where(F.col("kind") == "assign").select("repo_id", "service", "name", "value", "ordinal"))
    named = own.where(F.col("kind").isin("call_name", "annotation_name")).withColumnRenamed("value", "expression").drop("name")
    through = resolve.look_up_symbols(named, bound).withColumnRenamed("value", "topic_key")
    typed = facts.where(F.col("kind") == "event_type").select("repo_id", F.col("value").alias("topic_key"), "service", F.col("name").alias("role"), "path", "line", "ordinal")
    handles = (F.col("kind") == "extends") & F.col("name").rlike(HANDLERS) & ~F.col("name").rlike(NO_HANDLERS) & F.col("value").isNotNull()
    handled = facts.where(handles).select("repo_id", F.col("value").alias("topic_key"), "service", F.lit("consumer").alias("role"), "path", "line", "ordinal")
    return literal.select(*columns).unionByName(through.select(*columns)).unionByName(typed).unionByName(handled).where(S.is_topic_key(F.col("topic_key")))


def event(facts: DataFrame, ctx: Context) -> DataFrame:
    """Producer to consumer by topic (inferred); users of a broker's library to its services (inferred)."""
    said = mentions(facts)
    place = said.groupBy("repo_id", "topic_key", F.col("service").alias("source")).agg(F.min(F.struct("path", "line", "ordinal")).alias("at"))
    pairs = resolve.topic_edges(said).join(place, ["repo_id", "topic_key", "source"]).select("repo_id", F.col("source").alias("service"), "target", "topic_key", "at.path", "at.line", "at.ordinal")
    topics = _shape(pairs, F.lit(EVENT), F.lit(1), F.concat(F.lit("topic "), F.col("topic_key")))
    uses = facts.where(F.col("kind") == "import").withColumn("family", S.broker_family(F.col("name"))).where(F.col("family").isNotNull())
    first = uses.groupBy("repo_id", "service", "family").agg(F.min(F.struct("path", "line", "ordinal", "name")).alias("at"))
    found = resolve.brokers(first.select("repo_id", "service", "family"), ctx.services).withColumnRenamed("source", "service")
    users = found.join(first, ["repo_id", "service", "family"]).select("repo_id", "service", "target", "at.path", "at.line", "at.ordinal", "at.name")
    return topics.unionByName(_shape(users, F.lit(EVENT), F.lit(1), F.concat(F.lit("imports "), F.col("name"))))


#: Last parts of settings' keys that name a database; calls that take the name of one, and those that declare it.
DATABASE_KEYS = ("database", "dbname", "db", "database-name", "databasename", "database_name", "schema", "catalog", "initial-catalog")
DECLARES_DATABASE = r"(?i)\.Add(?:Npgsql|SqlServer|MySql|Oracle|MongoDB|Cosmos)\w*(?:DbContext|DataSource|Client)$"
NAMES_DATABASE = r"(?i)\.GetConnectionString$"
LITERAL_HOST, LITERAL_DATABASE = r"(?i)^host(?:name)?$", r"(?i)^(?:database|db|dbname)$"


def database_uses(facts: DataFrame, ctx: Context) -> DataFrame:
    """repo_id, service, db_key, declared, path, line, ordinal: databases that files name.

    By a URL or connection string: in a text, a setting, a text whose variables all have values, or a variable's value or
    default. By a pair: a file's first setting of a host with its first of a database, or a host and a database in one literal
    among a call's arguments. By a resource's name (declared), or by one that is only looked up (not declared)."""
    columns = ["repo_id", "service", "db_key", "declared", "path", "line", "ordinal"]
    key_of = lambda c: F.coalesce(S.database_key(c), F.when(S.ado_host(c).isNotNull(), F.concat_ws("/", S.ado_host(c), S.ado_database(c))))
    shown = lambda rows, key: rows.withColumn("db_key", key).where(F.col("db_key").isNotNull()).withColumn("declared", F.lit(True)).select(*columns)
    plain = facts.where(F.col("kind").isin("string", "setting", "assign") & F.col("value").isNotNull())
    # texts with variables, once all of them have a value
    at = ["repo_id", "service", "path", "line", "ordinal"]
    parts = facts.where((F.col("kind") == "template") & F.col("value").isNotNull()).select(*at, F.posexplode(S.template_parts(F.col("value"))).alias("pos", "p"))
    asked = parts.select(*at, "pos", "p.is_var", "p.text", F.when(F.col("p.is_var"), F.coalesce(S.env_name(F.col("p.text")), F.col("p.text"))).alias("variable"))
    put = resolve.env_values(asked, ctx.env_own, ctx.env_shared).withColumn("put", F.when(F.col("is_var"), F.coalesce("value", S.env_default(F.col("text")))).otherwise(F.col("text")))
    whole = put.groupBy(*at).agg(F.count_if(F.col("put").isNull()).alias("open"), F.array_join(F.array_sort(F.collect_list(F.struct("pos", "put")))["put"], "").alias("text")).where(F.col("open") == 0)
    refs = resolve.env_values(facts.where(F.col("kind") == "env").select(*at, F.col("name").alias("variable"), "default"), ctx.env_own, ctx.env_shared)
    # pairs of settings: the first host and the first database of a file
    last = F.lower(F.element_at(F.split("name", r"\."), -1))
    settings = facts.where((F.col("kind") == "setting") & F.col("value").isNotNull() & key_of(F.col("value")).isNull())
    is_database = last.isin(*DATABASE_KEYS) & ~F.contains("value", F.lit("$"))
    is_host = ~is_database & (last.isin(*HOST_WORDS) | F.coalesce(S.is_hostish(F.col("name")), F.lit(False))) & S.is_hostname(F.col("value"))
    first = lambda when: F.min(F.when(when, F.struct("ordinal", "line", F.lower("value").alias("value"))))
    paired = settings.groupBy("repo_id", "service", "path").agg(first(is_host).alias("h"), first(is_database).alias("d")).where(F.col("h").isNotNull() & F.col("d").isNotNull())
    of_files = paired.select("repo_id", "service", "path", "d.line", "d.ordinal", F.concat_ws("/", "h.value", "d.value").alias("key"))
    # literals: of calls of one name in a file the first host goes with the first database, and so on
    keyed = facts.where(F.col("kind") == "call_key").withColumn("key", F.element_at(F.split("name", r"[#.]"), -1)).withColumn("within", F.regexp_replace("name", r"[^#.]*$", ""))
    place = Window.partitionBy("repo_id", "service", "path", "within").orderBy("ordinal")
    side = lambda pattern, name: keyed.where(F.col("key").rlike(pattern)).withColumn("nth", F.row_number().over(place)).withColumn(name, F.lower("value"))
    literal = side(LITERAL_DATABASE, "db").join(side(LITERAL_HOST, "host").select("repo_id", "service", "path", "within", "nth", "host"), ["repo_id", "service", "path", "within", "nth"])
    callee = F.regexp_replace("name", r"<.*?>", "")
    named = facts.where((F.col("kind") == "call") & (callee.rlike(DECLARES_DATABASE) | callee.rlike(NAMES_DATABASE))).withColumn("declared", callee.rlike(DECLARES_DATABASE)).withColumn("db_key", F.lower("value"))
    every = shown(plain, key_of(F.col("value")))
    for more in (shown(whole, key_of(F.col("text"))), shown(refs, F.coalesce(key_of(F.col("value")), key_of(F.col("default")))), shown(of_files, F.col("key")), shown(literal, F.concat_ws("/", "host", "db")), named.select(*columns)):
        every = every.unionByName(more)
    return every


def database(facts: DataFrame, ctx: Context) -> DataFrame:
    """Services that name the same database, both ways (inferred)."""
    uses = database_uses(facts, ctx)
    first = uses.groupBy("repo_id", "service", "db_key").agg(F.min(F.struct("path", "line", "ordinal")).alias("at"))
    pairs = resolve.shared_keys(uses.select("repo_id", "db_key", "service", "declared"))
    placed = pairs.withColumnRenamed("source", "service").join(first, ["repo_id", "service", "db_key"]).select("repo_id", "service", "target", "db_key", "at.path", "at.line", "at.ordinal")
    return _shape(placed, F.lit(DATABASE), F.lit(1), F.concat(F.lit("shared database "), F.col("db_key"), F.lit(" with "), F.col("target")), F.col("db_key"))


def imports(facts: DataFrame, ctx: Context) -> DataFrame:
    """Packages of the same repository (static); relative imports are the service's own."""
    names = facts.where((F.col("kind") == "import") & ~F.col("name").rlike(r"^[./]"))
    listed = facts.where((F.col("kind") == "setting") & F.col("path").rlike(r"package\.json$") & F.col("value").rlike(r"^(workspace:|\^|~|\*|[0-9]|file:|link:)")).drop("default")
    uses = names.select("repo_id", "service", F.col("name").alias("package"), "path", "line", "ordinal").unionByName(listed.select("repo_id", "service", F.col("name").alias("package"), "path", "line", "ordinal"))
    known = ctx.services.where(F.col("role") == "code").select("repo_id", F.explode(F.array_distinct(F.array_compact(F.array("package", "name")))).alias("package"), F.col("name").alias("owner"), "pos")
    return _shape(resolve.packages(uses, known), F.lit(IMPORT), F.lit(2), F.concat(F.lit("imports "), F.col("package")))


matchers: dict[str, Callable[[DataFrame, Context], DataFrame]] = {"http": http, "grpc": grpc, "event": event, "database": database, "import": imports}


def candidates(facts: DataFrame, ctx: Context, names: tuple[str, ...] | None = None) -> DataFrame:
    """Candidates of all matchers, in their order."""
    out = None
    for k, name in enumerate(names or tuple(matchers)):
        own = matchers[name](facts, ctx).withColumn("ordinal", F.col("ordinal") + F.lit(k * 10**9))
        out = own if out is None else out.unionByName(own)
    return out


def empty_env(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "repo_id string, service string, variable string, value string"), spark.createDataFrame([], "repo_id string, variable string, value string")


