"""Joins that turn what a file mentions into services: hosts, variables, templates, topics, brokers, databases, packages.

Every look-up is an equality join on keys prepared beforehand (names in tiers, beginnings of paths), then the best of
the matches by tier and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.functions.scalars import image_basename, is_local, normalise, normalise_variable, service_kind

SYMBOLS = 8
#: What a broker family's services are called.
FAMILY_ALIASES = {
    "kafka": ("kafka", "redpanda"), "rabbitmq": ("rabbitmq", "eventbus"), "nats": ("nats",), "pulsar": ("pulsar",), "mqtt": ("mosquitto", "emqx", "mqtt"),
    "activemq": ("activemq", "artemis"), "servicebus": ("servicebus",), "sqs": ("sqs", "localstack"), "sns": ("sns", "localstack"),
}


def service_keys(services: DataFrame) -> DataFrame:
    """services (repo_id, name, image, pos) -> repo_id, tier, key, service: the names by which a host finds a service. Of a
    tier's key the first service counts; its own name comes before its image."""
    long_key = lambda c: F.when(F.length(normalise(c)) >= 3, normalise(c))
    keys = F.array(
        F.struct(F.lit(0).alias("tier"), F.lower("name").alias("key"), F.lit(0).alias("from_image")),
        F.struct(F.lit(1).alias("tier"), long_key(F.col("name")).alias("key"), F.lit(0).alias("from_image")),
        F.struct(F.lit(1).alias("tier"), long_key(image_basename(F.col("image"))).alias("key"), F.lit(1).alias("from_image")),
    )
    listed = services.select("repo_id", F.col("name").alias("service"), "pos", F.inline(keys)).where(F.col("key").isNotNull())
    return listed.groupBy("repo_id", "tier", "key").agg(F.min_by("service", F.struct("pos", "from_image")).alias("service"))


def hosts(rows: DataFrame, keys: DataFrame, host: str = "host") -> DataFrame:
    """rows with a host column -> the same with target: exact, then its first label, then normalised (host, then label)."""
    asks = rows.select("repo_id", F.col(host).alias("asked")).where(F.col("asked").isNotNull()).distinct().where(~is_local(F.col("asked")))
    label = F.split_part(F.lower("asked"), F.lit("."), F.lit(1))
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key"), F.lit(o).alias("turn")) for o, (t, k) in enumerate([(0, F.lower("asked")), (0, label), (1, normalise(F.col("asked"))), (1, normalise(label))])])
    found = asks.select("repo_id", "asked", F.inline(tiers)).join(keys, ["repo_id", "tier", "key"]).groupBy("repo_id", "asked").agg(F.min_by("service", "turn").alias("target"))
    return rows.join(found.withColumnRenamed("asked", host), ["repo_id", host], "left")


def env_values(refs: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """refs (repo_id, service, variable), own (repo_id, service, variable, value), shared (repo_id, variable, value) ->
    refs with value: the service's, else the repository's."""
    mine = own.withColumnRenamed("value", "own_value")
    every = shared.withColumnRenamed("value", "shared_value")
    return refs.join(mine, ["repo_id", "service", "variable"], "left").join(every, ["repo_id", "variable"], "left").withColumn("value", F.coalesce("own_value", "shared_value")).drop("own_value", "shared_value")


def variables(refs: DataFrame, own: DataFrame, shared: DataFrame, keys: DataFrame, host_of: Column) -> DataFrame:
    """refs (repo_id, service, variable, default) -> target and conf_rank: by the configured value, else the default
    (both static), else by the variable's name (uncertain). host_of reads a host from a column named `text`."""
    valued = env_values(refs, own, shared)
    for name, text in (("configured", "value"), ("fallback", "default")):
        valued = hosts(valued.withColumn("text", F.col(text)).withColumn("_host", host_of).drop("text"), keys, "_host").withColumnRenamed("target", name).drop("_host")
    valued = hosts(valued.withColumn("_host", normalise_variable(F.col("variable"))), keys, "_host").withColumnRenamed("target", "named").drop("_host")
    rank = F.when(F.coalesce("configured", "fallback").isNotNull(), 2).when(F.col("named").isNotNull(), 0)
    return valued.withColumn("target", F.coalesce("configured", "fallback", "named")).withColumn("conf_rank", rank).drop("configured", "fallback", "named")


def templates(parts: DataFrame, keys: tuple[str, ...] = ("repo_id", "id"), more: tuple[str, ...] = ()) -> DataFrame:
    """parts (keys, pos, target, conf_rank, more): of each template the first part that found a service."""
    best = F.min_by(F.struct("target", "conf_rank", *more), "pos").alias("best")
    return parts.where(F.col("target").isNotNull()).groupBy(*keys).agg(best).select(*keys, "best.*")


def proto_owners(registrations: DataFrame, protos: DataFrame, services: DataFrame) -> DataFrame:
    """registrations (repo_id, proto, service, ordinal): who registers a proto service first owns it; else the service of
    the same normalised name does."""
    first = registrations.groupBy("repo_id", "proto").agg(F.min_by("service", "ordinal").alias("registered"))
    named = services.select("repo_id", normalise(F.col("name")).alias("norm"), F.col("name").alias("named"), "pos").groupBy("repo_id", "norm").agg(F.min_by("named", "pos").alias("named"))
    every = protos.select("repo_id", "proto").distinct().withColumn("norm", normalise(F.col("proto")))
    return every.join(first, ["repo_id", "proto"], "left").join(named, ["repo_id", "norm"], "left").select("repo_id", "proto", F.coalesce("registered", "named").alias("owner")).where(F.col("owner").isNotNull())


def topic_sides(mentions: DataFrame) -> DataFrame:
    """mentions (repo_id, topic_key, service, role): who produces, consumes or only names a topic."""
    who = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("service"))))
    return mentions.groupBy("repo_id", "topic_key").agg(who("producer").alias("producers"), who("consumer").alias("consumers"), who("unknown").alias("unknown"))


def topic_edges(mentions: DataFrame) -> DataFrame:
    """Producer to consumer for every topic; a mention of unknown role stands in on the other side. One distinct row a
    (topic, service, role) before the join, so a topic's frequent mentions do not multiply."""
    own = mentions.select("repo_id", "topic_key", "service", "role").distinct()
    left = own.where(F.col("role").isin("producer", "unknown")).select("repo_id", "topic_key", F.col("service").alias("source"), F.col("role").alias("left_role"))
    right = own.where(F.col("role").isin("consumer", "unknown")).select("repo_id", "topic_key", F.col("service").alias("target"), F.col("role").alias("right_role"))
    pairs = left.join(right, ["repo_id", "topic_key"]).where((F.col("source") != F.col("target")) & ~((F.col("left_role") == "unknown") & (F.col("right_role") == "unknown")))
    return pairs.select("repo_id", "topic_key", "source", "target").distinct()


def brokers(uses: DataFrame, services: DataFrame) -> DataFrame:
    """uses (repo_id, service, family) -> source, target: the family's services, infrastructure by name or image, code by
    image only. The family's names are few; each service is labelled once, then joined by family."""
    text = F.lower(F.when(F.col("role") == "code", F.coalesce("image", F.lit(""))).otherwise(F.concat_ws(" ", "name", "image")))
    families = F.array_compact(F.array(*[F.when(text.rlike("|".join(names)), F.lit(family)) for family, names in FAMILY_ALIASES.items()]))
    offered = services.select("repo_id", F.col("name").alias("target"), F.explode(families).alias("family"))
    return uses.distinct().join(offered, ["repo_id", "family"]).where(F.col("service") != F.col("target")).select("repo_id", "family", F.col("service").alias("source"), "target")


def shared_keys(uses: DataFrame) -> DataFrame:
    """uses (repo_id, db_key, service, declared): services with the same database, both ways; a key that is only looked up
    counts if somebody declares it."""
    declared = uses.where("declared").select("repo_id", "db_key").distinct()
    own = uses.select("repo_id", "db_key", "service").distinct().join(declared, ["repo_id", "db_key"], "left_semi")
    other = own.withColumnRenamed("service", "target")
    return own.withColumnRenamed("service", "source").join(other, ["repo_id", "db_key"]).where(F.col("source") != F.col("target"))


def database_services(uses: DataFrame) -> DataFrame:
    """uses (repo_id, db_key, service) -> how many services name each database."""
    return uses.groupBy("repo_id", "db_key").agg(F.countDistinct("service").alias("services"))


def once(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of the rows of a key the first by ordinal."""
    first = Window.partitionBy(*keys).orderBy("ordinal")
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def symbols(assigned: DataFrame, most: int = SYMBOLS) -> DataFrame:
    """assigned (repo_id, service, name, value, ordinal): the first distinct values of a name within a service."""
    first = assigned.groupBy("repo_id", "service", "name", "value").agg(F.min("ordinal").alias("ordinal"))
    place = Window.partitionBy("repo_id", "service", "name").orderBy("ordinal")
    return first.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)


def look_up_symbols(uses: DataFrame, table: DataFrame) -> DataFrame:
    """uses (repo_id, service, expression): values of the expression's last identifier in the same service."""
    name = F.regexp_extract("expression", r"([A-Za-z_$][A-Za-z0-9_$]*)\W*$", 1)
    return uses.withColumn("name", name).join(table.select("repo_id", "service", "name", "value", "place"), ["repo_id", "service", "name"])


def packages(uses: DataFrame, known: DataFrame) -> DataFrame:
    """uses (repo_id, service, package), known (repo_id, package, owner, pos) -> target: the first of the same name, of the
    same name in any case, or the last of the longest that is followed by / . or : in what is used."""
    asked = uses.select("repo_id", "package").distinct()
    cut = F.filter(F.transform(F.sequence(F.lit(1), F.length("package")), lambda i: F.when(F.substring("package", i, F.lit(1)).isin("/", ".", ":"), F.substring("package", F.lit(1), i - 1))), lambda x: x.isNotNull() & (x != ""))
    exact = known.select("repo_id", "package", F.col("owner"), "pos").groupBy("repo_id", "package").agg(F.min_by("owner", "pos").alias("exact"))
    folded = known.groupBy("repo_id", F.lower("package").alias("low")).agg(F.min_by("owner", "pos").alias("folded"))
    long = asked.select("repo_id", "package", F.explode(cut).alias("begin")).join(known.select("repo_id", F.col("package").alias("begin"), "owner", "pos"), ["repo_id", "begin"]).groupBy("repo_id", "package").agg(F.max_by("owner", F.struct(F.octet_length("begin").alias("n"), "pos")).alias("begun"))
    found = asked.withColumn("low", F.lower("package")).join(exact, ["repo_id", "package"], "left").join(folded, ["repo_id", "low"], "left").join(long, ["repo_id", "package"], "left")
    return uses.join(found.select("repo_id", "package", F.coalesce("exact", "folded", "begun").alias("target")), ["repo_id", "package"]).where(F.col("target").isNotNull() & (F.col("target") != F.col("service")))


def with_kind(services: DataFrame) -> DataFrame:
    return services.withColumn("kind", service_kind(F.col("name"), F.col("image")))


def unresolved(rows: DataFrame, most: int = 50) -> DataFrame:
    """rows (repo_id, host, target): how often a host that is not local found no service, and the first such names."""
    lost = rows.where(F.col("host").isNotNull() & F.col("target").isNull() & ~is_local(F.col("host")))
    names = lost.groupBy("repo_id", "host").agg(F.count("*").alias("n"))
    place = Window.partitionBy("repo_id").orderBy("host")
    listed = names.withColumn("place", F.row_number().over(place))
    return listed.groupBy("repo_id").agg(F.sum("n").alias("unresolved"), F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("host")))).alias("names"))
