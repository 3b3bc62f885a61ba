"""Calls seen in production: readers of Prometheus scrapes, OTLP spans and Datadog dependencies, as tables.

Calls are (client, server, calls, kind, ordinal); names are all services that production knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.functions.scalars import span_kind

METRIC = "traces_service_graph_request_total"
SAMPLE = rf"^{METRIC}(?:_total)?\{{([^}}]*)\}}\s+([0-9eE+.\-]+)(?:\s+-?\d+)?\s*$"
LABEL = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string>>>"
SPANS = f"array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,kind:string,attributes:{ATTRIBUTES}>>>>"
OTLP = f"struct<resourceSpans:array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:{SPANS},instrumentationLibrarySpans:{SPANS}>>>"


def sniff(lines: DataFrame) -> tuple[str, bool]:
    """lines (value, ordinal) of the whole input -> otlp, datadog or prometheus, and whether each line is a JSON object of its own.

    One aggregate over all lines: the first that is not blank tells JSON from text, the key of spans may stand anywhere, as may the
    metric in a scrape of many others."""
    line = F.trim(F.regexp_replace("value", r"[\s\x{FEFF}]+", " "))
    rows = lines.select(line.alias("line"), "ordinal").where(F.col("line") != "")
    has = lambda text: F.coalesce(F.max(F.contains("line", F.lit(text))), F.lit(False))
    whole = F.startswith("line", F.lit("{")) & F.endswith("line", F.lit("}")) & F.try_parse_json("line").isNotNull()
    found = rows.agg(F.min_by(F.substring("line", 1, 1), "ordinal").alias("first"), has('"resourceSpans"').alias("spans"), has(METRIC).alias("metric"), F.coalesce(F.every(whole), F.lit(False)).alias("each"), F.count("*").alias("n")).first()
    if found["first"] == "{":
        return ("otlp" if found["spans"] else "datadog"), found["each"] and found["n"] > 1
    if found["metric"]:
        return "prometheus", False
    raise ValueError("neither spans nor a scrape of service graph metrics")


def prometheus(lines: DataFrame) -> DataFrame:
    """lines (value, ordinal) -> calls. Comments, other metrics and samples without client and server are skipped."""
    line = F.trim(F.col("value"))
    found = lines.where(line.rlike(SAMPLE)).select("ordinal", F.regexp_extract(line, SAMPLE, 1).alias("labels"), F.regexp_extract(line, SAMPLE, 2).try_cast("double").alias("number"))
    text = lambda v: F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    pairs = F.arrays_zip(F.regexp_extract_all("labels", F.lit(LABEL), F.lit(1)).alias("k"), F.regexp_extract_all("labels", F.lit(LABEL), F.lit(2)).alias("v"))
    label = lambda name: F.try_element_at(F.filter("pairs", lambda p: p["k"] == name), F.lit(-1))["v"]
    named = found.withColumn("pairs", pairs).select("ordinal", "number", label("client").alias("client"), label("server").alias("server"), label("connection_type").alias("connection"))
    kind = F.when(F.col("connection") == "messaging_system", "event").when(F.col("connection") == "database", "database").otherwise("unknown")
    good = named.where(F.col("number").isNotNull() & (F.coalesce("client", F.lit("")) != "") & (F.coalesce("server", F.lit("")) != ""))
    return good.select(text(F.col("client")).alias("client"), text(F.col("server")).alias("server"), F.round(F.greatest("number", F.lit(0.0))).cast("long").alias("calls"), kind.alias("kind"), "ordinal")


def otlp_spans(documents: DataFrame) -> DataFrame:
    """documents (value: JSON; ordinal, where there are several) -> spans (span_id, parent_id, service, peer, kind, span_type, ordinal)."""
    place = F.col("ordinal") if "ordinal" in documents.columns else F.lit(0)
    parsed = documents.select(place.cast("decimal(38,0)").alias("document"), F.from_json("value", OTLP).alias("x")).select("document", F.posexplode("x.resourceSpans").alias("r", "rs"))
    attribute = lambda a, key: F.nullif(F.try_element_at(F.filter(a, lambda kv: kv["key"] == key), F.lit(1))["value"]["stringValue"], F.lit(""))
    service = attribute(F.col("rs.resource.attributes"), "service.name")
    scopes = parsed.select("document", "r", service.alias("service"), F.posexplode(F.coalesce("rs.scopeSpans", "rs.instrumentationLibrarySpans")).alias("s", "ss")).where(F.col("service").isNotNull())
    spans = scopes.select("document", "r", "s", "service", F.posexplode("ss.spans").alias("n", "span"))
    own = F.map_from_entries(F.array_distinct(F.transform(F.filter(F.coalesce("span.attributes", F.array().cast(ATTRIBUTES)), lambda kv: kv["value"]["stringValue"].isNotNull() & kv["key"].isin("messaging.system", "db.system", "rpc.system", "peer.service")), lambda kv: F.struct(kv["key"], kv["value"]["stringValue"]))))
    number = F.upper(F.regexp_replace(F.coalesce("span.kind", F.lit("")), "^SPAN_KIND_", ""))
    kind_name = F.coalesce(*[F.when(number.isin(*v), F.lit(k)) for k, v in {"server": ("SERVER", "2"), "client": ("CLIENT", "3"), "producer": ("PRODUCER", "4"), "consumer": ("CONSUMER", "5")}.items()], F.lit("internal"))
    return spans.withColumn("own", own).select(
        F.nullif(F.col("span.spanId"), F.lit("")).alias("span_id"), F.nullif(F.col("span.parentSpanId"), F.lit("")).alias("parent_id"), "service",
        F.nullif(F.try_element_at("own", F.lit("peer.service")), F.lit("")).alias("peer"), span_kind(F.col("own"), number).alias("kind"), kind_name.alias("span_type"),
        F.struct("document", "r", "s", "n").alias("ordinal"),
    )


def calls_of_spans(spans: DataFrame) -> DataFrame:
    """A call for each span whose parent is another service's, then for each client or producer span that names a peer
    and whose own call was not counted through a child. Of equal span ids the last counts as parent."""
    parents = spans.where(F.col("span_id").isNotNull()).groupBy(F.col("span_id").alias("parent_id")).agg(F.max_by(F.struct("service", "span_type"), "ordinal").alias("parent"))
    children = spans.where(F.col("parent_id").isNotNull()).join(parents, "parent_id").where(F.col("parent.service") != F.col("service"))
    kind = F.when(F.col("parent.span_type") == "producer", F.lit("event")).otherwise(F.col("kind"))
    through = children.select(F.col("parent.service").alias("client"), F.col("service").alias("server"), F.lit(1).cast("long").alias("calls"), kind.alias("kind"), F.struct(F.lit(0).alias("turn"), "ordinal").alias("ordinal"))
    counted = children.select(F.col("parent_id").alias("span_id")).distinct()
    named = spans.where(F.col("span_type").isin("client", "producer") & F.col("peer").isNotNull() & (F.col("peer") != F.col("service"))).join(counted, "span_id", "left_anti")
    more = named.select(F.col("service").alias("client"), F.col("peer").alias("server"), F.lit(1).cast("long").alias("calls"), "kind", F.struct(F.lit(1).alias("turn"), "ordinal").alias("ordinal"))
    return through.unionByName(more)


def datadog(documents: DataFrame) -> DataFrame:
    """documents (value: JSON of service -> {calls | calls_out}) -> client, server (null for a name without callees), calls null. A
    document that is no object, or an empty one, is an error, raised when the rows are read."""
    held = F.from_json("value", "map<string,string>")
    some = F.when(F.coalesce(F.size(held), F.lit(0)) > 0, held).otherwise(F.raise_error(F.lit("dependencies of no service")))
    services = documents.where(F.trim("value") != "").select(some.alias("m")).select(F.posexplode("m").alias("p", "client", "deps"))
    both = F.from_json("deps", "struct<calls:string,calls_out:string>")
    listed = services.select("p", "client", F.coalesce(both["calls"], both["calls_out"]).alias("list"))
    # a JSON string element starts with a quote; numbers and objects are no names
    items = listed.select("p", "client", F.posexplode_outer(F.variant_get(F.try_parse_json("list"), "$", "array<variant>")).alias("n", "item"))
    name = F.when(F.schema_of_variant("item") == "STRING", F.try_variant_get("item", "$", "string"))
    return items.select("client", F.nullif(name, F.lit("")).alias("server"), F.lit(None).cast("long").alias("calls"), F.lit("unknown").alias("kind"), (F.col("p").cast("long") * 1_000_000 + F.coalesce("n", F.lit(0))).alias("ordinal"))


def record(calls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each client and server: calls summed, null where none was counted, and the first kind that says something."""
    said = F.min_by(F.when(F.col("kind") != "unknown", F.col("kind")), F.when(F.col("kind") != "unknown", F.col("ordinal")))
    return calls.where(F.col("server").isNotNull()).groupBy(*keys, "client", "server").agg(F.sum("calls").alias("calls"), F.coalesce(said, F.lit("unknown")).alias("kind"), F.min("ordinal").alias("first_seen"))


def read(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """What the input is, and its calls. A scrape is a row a line, as is JSON of one object a line; other JSON is one row a file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ordinal"))
    how, each = sniff(lines)
    if how == "prometheus":
        return how, prometheus(lines)
    documents = lines if each else spark.read.text(path, wholetext=True).select("value", F.monotonically_increasing_id().alias("ordinal"))
    return how, calls_of_spans(otlp_spans(documents)) if how == "otlp" else datadog(documents)
