"""Personal data by bootstrapped contextual extraction, in Spark's own functions.

Base: fixed patterns for e-mail addresses, IP addresses, payment cards and phone numbers. They are the seeds. A
token is an identifier if it has '@' or at least three digits; its pattern is the two words before it. Patterns and
identifiers make a graph, weighted by the number of places. Scores go back and forth over it: an identifier that is
a seed has confidence 1, any other the best of its patterns' confidences, damped; a pattern's is the weighted mean
of its identifiers', with one place of doubt added. After ROUNDS rounds, a pattern that at least SUPPORT different
seeds of one kind stand in and that has at least CONFIDENCE finds the other identifiers that stand in it: they are
spans of the kind "like_" and the seeds' kind.

Nothing is collected: the graph is aggregated by (pattern, identifier) before every join; a pattern that very many
identifiers stand in is a large key of a plain equality join, which adaptive execution splits.

Defined cases: null and empty texts have no spans. An identifier's kind is that of the first base span that begins in it. Equal seeds in one text count as one seed with
several places.
Repeated rows get equal results. A token into which a base span reaches is not found. An empty table gives an
empty result.

In the patterns the repetitions are possessive and may not begin inside a run that has just failed, so that every
text is read in linear time; the matches are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, stored
from sparkwake.llm.native import kinds, let, listed, matches, running

#: The base patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ORDER = ("email", "ip", "card", "phone")
#: A whole token with '@' or three digits; possessive parts, so that a text is read in linear time.
IDENTIFIER = r"(?<!\S)(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){3})\S++"
SUPPORT, CONFIDENCE, ROUNDS, DAMPING = 3, 0.6, 3, 0.8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)

        def worth(i: Column) -> Column:
            return let(F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v))

        return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0).otherwise(F.lit(False))

    return let(_digits(x), total)


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, array<struct<start,end,match>>."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.filter(matches(text, IP), lambda s: s["match"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")),
        "card": F.filter(matches(text, CARD), lambda s: _luhn(s["match"])),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda s: F.length(_digits(s["match"])).between(10, 15))).otherwise(none),
    }


NEAR = "struct<left:string,token:string,start:int,kind:string,free:boolean>"


def _places(text: Column, spans: dict[str, Column]) -> Column:
    """array<struct<left,token,start,kind,free>>: identifiers and where they begin, the two words before each (which may
    be identifiers too), the kind of the first base span that begins in each, and whether none reaches into it from before."""
    last_two = lambda words: let(words, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)))

    def placed(tokens: Column, gaps: Column) -> Column:
        """struct<at, order, end, left, token>, by place; order -1 sets them before the spans that begin with them."""
        tails = F.transform(gaps, lambda g: last_two(F.filter(F.split(g, r"\s+"), lambda w: w != "")))
        ends = let(F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), tokens, lambda g, t: F.length(g) + F.length(t)), lambda s: running(s, lambda a, b: a + b))

        def one(words: Column, ends: Column, i: Column) -> Column:
            # what stands before: token i-2, the gap after it, token i-1, the gap after that
            known = F.array_compact(F.concat(F.array(F.get(tokens, i - 2)), F.coalesce(F.get(words, i - 1), F.array().cast("array<string>")), F.array(F.get(tokens, i - 1)), F.get(words, i)))
            end, token = F.get(ends, i), F.get(tokens, i)
            return F.struct((end - F.length(token)).alias("at"), F.lit(-1).alias("order"), end.alias("end"), last_two(known).alias("left"), token.alias("token"))

        return let(tails, lambda words: let(ends, lambda e: F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: one(words, e, i))))

    def with_spans(own: Column) -> Column:
        def listed_as(order: int, kind: Column) -> Column:
            none = lambda t: F.lit(None).cast(t)
            return F.transform(kind, lambda x: F.struct(x["start"].alias("at"), F.lit(order).alias("order"), x["end"].alias("end"), none("array<string>").alias("left"), none("string").alias("token")))

        held = [listed_as(k, s) for k, s in enumerate(spans.values())]
        names = F.array(*map(F.lit, spans))

        def judged(every: Column) -> Column:
            reach = let(F.transform(every, lambda x: F.when(x["order"] < 0, F.lit(0)).otherwise(x["end"])), lambda e: running(e, F.greatest))

            def judge(reach: Column, x: Column, i: Column) -> Column:
                after = F.get(every, i + 1)
                seed = (after["order"] >= 0) & (after["at"] < x["end"])
                return F.struct(F.lower(F.array_join(x["left"], " ")).alias("left"), x["token"].alias("token"), x["at"].alias("start"), F.when(seed, F.get(names, after["order"])).alias("kind"), (F.get(reach, i) <= x["at"]).alias("free"))

            told = lambda r: F.transform(every, lambda x, i: F.when((x["order"] < 0) & (F.size(x["left"]) == 2), judge(r, x, i)))
            return F.filter(let(reach, told), lambda x: x.isNotNull())

        return let(F.sort_array(F.concat(own, *held)), judged)

    none = F.array().cast(f"array<{NEAR}>")
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return let(found, lambda t: F.when(F.size(t) > 0, let(placed(t, F.split(text, IDENTIFIER, -1)), with_spans)).otherwise(none))


def row_key() -> Column:
    return F.xxhash64("text")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Rows of one doc_id and one text: the hash alone may be that of another text among very many."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row, one column of spans for each kind, and `near`: identifiers and what stands before them."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row_key())
    spans = base_spans(F.col("text"))
    rows = own.select("doc_id", "row", "text", *[s.alias(k) for k, s in spans.items()])
    return rows.select("doc_id", "row", *ORDER, _places(F.col("text"), {k: F.col(k) for k in ORDER}).alias("near"))


def patterns(near: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """near (left, token, kind: null unless a seed) -> left, kind, confidence of the patterns that are trusted."""
    places = stored(near.groupBy("left", "token").agg(F.count("*").alias("n"), F.max("kind").alias("kind")), "pattern_places")
    support = places.where(F.col("kind").isNotNull()).groupBy("left", "kind").agg(F.count("*").alias("seeds"))
    best = support.groupBy("left").agg(F.max(F.struct("seeds", "kind")).alias("best")).where(F.col("best.seeds") >= SUPPORT).select("left", F.col("best.kind").alias("kind"))
    tokens = places.select("left", "token", "n", F.col("kind").isNotNull().cast("double").alias("trust"))
    mean = lambda t: t.groupBy("left").agg((F.sum(F.col("n") * F.col("trust")) / (F.sum("n") + 1)).alias("confidence"))
    confidence = stored(mean(tokens), "confidence")
    for _ in range(rounds - 1):
        reached = tokens.join(confidence, "left").groupBy("token").agg(F.greatest(F.max("trust"), DAMPING * F.max("confidence")).alias("trust"))
        confidence = stored(mean(tokens.drop("trust").join(reached, "token")), "confidence")
    return best.join(confidence, "left").where(F.col("confidence") >= CONFIDENCE)


def discovered(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """rows of base() -> doc_id, row, found: array of spans beyond the base, a row for each text that has some."""
    near = rows.select("doc_id", "row", F.inline("near"))
    trusted = patterns(near.select("left", "token", "kind"), rounds)
    seen = near.where(F.col("kind").isNull() & F.col("free")).select("doc_id", "row", "left", "start", F.length("token").alias("n"))
    hits = seen.join(trusted.select("left", "kind"), "left").select("doc_id", "row", "start", (F.col("start") + F.col("n")).alias("end"), F.concat(F.lit("like_"), "kind").alias("kind"))
    return hits.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", F.lit(len(ORDER)).alias("order"), "end", "kind")).alias("found"))


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row, n_<kind>, base (array of spans with kind), found (those of the method)."""
    rows = stored(base(docs), "pii")
    spans = F.concat(*[kinds(F.col(k), k, i) for i, k in enumerate(ORDER)])
    own = rows.select("doc_id", "row", *[F.size(k).cast("long").alias(f"n_{k}") for k in ORDER], spans.alias("base"))
    more = discovered(rows)
    found = F.coalesce("found", F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))
    return own.join(more, same_row(own, more), "left").select(*[own[c] for c in own.columns], found.alias("found"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[f"n_{k}" for k in ORDER], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "found")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; where spans overlap, the first one's mark stands."""

    def cut(code_points: Column, start: Column, end: Column) -> Column:
        # binary pieces are cut in place, where a string is read from its beginning; the byte-order mark is taken off again
        return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(code_points, 4 * start + 1, 4 * (end - start))), "UTF-32")

    def put(own: Column, code_points: Column) -> Column:
        def joined(reach: Column) -> Column:
            before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
            parts = F.transform(own, lambda x, i: F.when(x["start"] >= before(i), F.concat(cut(code_points, before(i), x["start"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(""))
            return F.concat(F.array_join(parts, ""), cut(code_points, F.get(reach, F.size(reach) - 1), (F.octet_length(code_points) / 4).cast("int")))

        return let(running(F.transform(own, lambda x: x["end"]), F.greatest), joined)

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), lambda own: let(F.encode(text, "UTF-32"), lambda c: put(own, c)))).otherwise(text)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; personal data in its text is replaced by marks, and n_chars follows.

    Null and empty texts stay as they are; repeated rows are masked alike, and ties do not arise. Columns of any other
    name are kept. An empty table gives an empty table.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    found = find(docs)
    spans = found.select("doc_id", "row", F.concat("base", "found").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "row"])
    text = F.when(F.col("spans").isNull(), F.col("kept.text")).otherwise(masked(F.col("kept.text"), F.col("spans")))
    out = own.join(spans, same_row(own, spans), "left").select("kept", text.alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").isNull(), F.col("kept.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])
