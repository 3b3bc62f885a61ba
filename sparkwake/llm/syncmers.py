"""Document fingerprints from closed syncmers, in Spark's own functions.

A text is lower-cased and cut at spaces, tabs and line ends. Of every run of INNER words there is a hash; a run of
WIDTH words is an anchor if the least hash of its inner runs is that of its first or its last. Whether a run is an
anchor depends on nothing but its own words, so the same passage gives the same anchors wherever it stands. A
fingerprint is the set of a text's anchors (their hashes); a text of fewer than WIDTH words has one anchor, all of
them; one without words has none. Likeness of two fingerprints: shared anchors by all anchors, 1 if both have none.
`anchors` also gives each anchor's word number; `shared_places` matches two texts by position.

Anchors are BITS of their hash. As text, a fingerprint is its whole set in order, in base64: every 8 characters are an
anchor, so likeness can be computed again from what is returned.

The next document, by descending doc_id, is found in ranges of doc_id set by its percentiles: each range is one
window, and the range after lends its first document, so no window holds the table. There are RANGES ranges at most: of
10^10 documents one has some 150,000, which a window sorts and spills.

Defined cases: a null text is empty. Documents of equal doc_id follow each other by descending text, in one range;
null doc_ids come last. A single document is its own next. Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import documents
from sparkwake.llm.native import let

WIDTH, INNER = 6, 2
BITS = 48
#: Documents in a range of doc_id, about, and the most ranges; bounds are looked up in groups of GROUP.
RANGE, RANGES, GROUP = 2000, 1 << 16, 256


def words(text: Column) -> Column:
    spaced = F.lower(text)
    for c in ("\n", "\t", "\r"):
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def _anchor(hashes: Column) -> Column:
    return F.xxhash64(hashes).bitwiseAND(F.lit((1 << BITS) - 1))


def anchors(text: Column, width: int = WIDTH, inner: int = INNER) -> Column:
    """array<struct<at,anchor>>: word number from 0 and hash of each closed syncmer."""
    within = width - inner + 1

    def chosen(hashes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(hashes) - inner + 1), lambda i: F.xxhash64(F.slice(hashes, i, inner)))

        def at_edge(runs: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(runs) - within), lambda i: let(F.array_min(F.slice(runs, i + 1, within)), lambda least: (least == F.get(runs, i)) | (least == F.get(runs, i + within - 1))))
            return F.transform(starts, lambda i: F.struct(i.alias("at"), _anchor(F.slice(hashes, i + 1, width)).alias("anchor")))

        return let(runs, at_edge)

    def sized(hashes: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("at"), _anchor(hashes).alias("anchor")))
        return F.when(F.size(hashes) >= width, chosen(hashes)).when(F.size(hashes) > 0, whole).otherwise(F.array().cast("array<struct<at:int,anchor:bigint>>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), sized)


def fingerprint(text: Column) -> Column:
    """The set of anchors, in order."""
    return F.sort_array(F.array_distinct(anchors(text)["anchor"]))


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every > 0, shared / every).otherwise(1.0)


def written(prints: Column) -> Column:
    """A fingerprint as text."""
    return F.base64(F.unhex(F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")))


def shared_places(a: Column, b: Column) -> Column:
    """Anchors of two texts -> array<struct<anchor,at,other>>: each anchor of a that b has, and the first word number of it in b."""
    first = lambda x: F.map_from_entries(F.transform(F.array_distinct(x["anchor"]), lambda k: F.struct(k, F.get(x["at"], F.array_position(x["anchor"], k).cast("int") - 1))))
    return let(first(b), lambda held: F.filter(F.transform(a, lambda x: F.struct(x["anchor"].alias("anchor"), x["at"].alias("at"), F.try_element_at(held, x["anchor"]).alias("other"))), lambda x: x["other"].isNotNull()))


def _above(bounds: list[int]) -> Column:
    """How many of the bounds (in order) are at least doc_id, so that ranges count from the highest; all for a null doc_id."""
    groups = [bounds[k : k + GROUP] for k in range(0, len(bounds), GROUP)]
    if not groups:
        return F.lit(0)
    count = lambda values: F.size(F.filter(values, lambda b: F.coalesce(F.col("doc_id") <= b, F.lit(True))))
    held, heads = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>"), F.array(*[F.lit(g[0]) for g in groups])
    # groups that begin at or above doc_id count in full, the one before them in part
    in_full = lambda j: F.when(j > 0, len(bounds) - (len(groups) - j) * GROUP).otherwise(0)
    in_part = lambda j: F.when(j < len(groups), count(F.get(held, len(groups) - 1 - j))).otherwise(0)
    return let(count(heads), lambda j: in_full(j) + in_part(j)).cast("int")


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """docs (doc_id, text) with the derived columns, next_text and next_<name> of the next document by descending doc_id."""
    n = docs.count()
    if not n:
        return docs.withColumns(derived).select("*", *[F.col(c).alias(f"next_{c}") for c in ("text", *derived)])
    ranges = max(1, min(RANGES, n // RANGE))
    found = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], max(10_000, 4 * ranges))).first()[0] or []
    rows = docs.withColumn("range", _above(sorted(set(found))))
    firsts = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.max("doc_id").alias("first")).collect()}  # RANGES rows at most
    order = sorted(firsts)
    before = {b: order[k - 1] for k, b in enumerate(order)}  # the first range's first follows the last range
    lend = F.broadcast(docs.sparkSession.createDataFrame([(b, firsts[b], before[b]) for b in order], "range int, first long, to_range int"))
    lent = rows.join(lend, (rows["range"] == lend["range"]) & rows["doc_id"].eqNullSafe(lend["first"])).select(F.col("to_range").alias("range"), "doc_id", "text", F.lit(True).alias("lent"))
    both = rows.select("range", "doc_id", "text", F.lit(False).alias("lent")).unionByName(lent).withColumns(derived)
    follows = Window.partitionBy("range").orderBy("lent", F.desc_nulls_last("doc_id"), F.desc("text"))
    nexts = [F.lead(c).over(follows).alias(f"next_{c}") for c in ("text", *derived)]
    return both.select("doc_id", "text", *derived, "lent", *nexts).where(~F.col("lent")).drop("lent")


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"print": fingerprint(F.col("text"))}).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
