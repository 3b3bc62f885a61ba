"""Secret scans by a trigram inverted index, in Spark's own functions.

From each rule's regular expression a Boolean query over trigrams is derived: the parse tree's literal stretches
(with small sets of alternatives and optional parts multiplied out) must each occur in one of their forms, and a
form occurs only if all of its trigrams do. A rule no stretch of which has three characters has no query: it scans
every text.

The index holds, for each shard of about SHARD texts and each trigram that some query names, the texts that have
it. A query is answered within each shard by intersecting and uniting these postings. Candidates (text, rules) are
written to the shared folder and joined with the texts, by broadcast only if Spark finds the table small enough;
there the regular expression verifies them. Trigrams are in lower case; verification is exact.

Defined cases: null and empty texts have no spans. Repeated rows get equal results. An empty table gives an empty
result. Texts of any length are indexed and verified whole.
"""

from __future__ import annotations

import json
import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, stored
from sparkwake.llm.native import SPAN, kinds, listed, matches

SHARD = 4096
#: The most forms into which a stretch is multiplied out.
FORMS = 64


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    keep: str = ""  # a match stays if its first group here is as long as `least`
    least: int = 0


#: The base rules, and public formats of keys that the method adds.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
OWN = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)


def _forms(item: tuple) -> set[str] | None:
    """The strings that a node of the parse tree can be, if they are few."""
    kind, value = item
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN:
        if any(k is not sre.LITERAL for k, _ in value):
            return None
        return {chr(v).lower() for _, v in value}
    if kind is sre.SUBPATTERN:
        return _all(value[-1])
    if kind is sre.BRANCH:
        branches = [_all(b) for b in value[1]]
        return set().union(*branches) if all(b is not None for b in branches) else None
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 2:
        one = _all(value[2])
        if one is not None:
            return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n)}
    return {""} if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT) else None


def _all(items: Iterator[tuple]) -> set[str] | None:
    forms = {""}
    for item in items:
        own = _forms(item)
        if own is None or len(forms) * len(own) > FORMS:
            return None
        forms = {a + b for a in forms for b in own}
    return forms


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses that must all hold; of a clause's forms one must, and of a form all trigrams. Empty: no query."""
    clauses: list[list[list[str]]] = []

    def close(forms: set[str]) -> None:
        if forms and min(map(len, forms)) >= 3:
            clauses.append(sorted(sorted({f[k : k + 3] for k in range(len(f) - 2)}) for f in forms))

    def walk(items: Iterator[tuple]) -> None:
        run = {""}
        for item in items:
            own = _forms(item)
            if own is not None and len(run) * len(own) <= FORMS:
                run = {a + b for a in run for b in own}
                continue
            close(run)
            run = own if own is not None else {""}
            if own is None and item[0] is sre.SUBPATTERN:
                walk(item[1][-1])
            elif own is None and item[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and item[1][0] > 0:
                walk(item[1][2])
        close(run)

    walk(parser.parse(pattern))
    return clauses


def row_key() -> Column:
    """Rows of equal hash share their candidates, which are verified: another text's only cost a look."""
    return F.xxhash64("doc_id", "text")


def any_of(trigrams: list[str]) -> str:
    """A pattern that stands at each place where one of the trigrams begins, and captures it."""
    heads: dict[str, dict[str, str]] = {}
    for t in trigrams:
        own = heads.setdefault(t[0], {})
        own[t[1]] = own.get(t[1], "") + t[2]
    cls = lambda chars: "[" + "".join(re.escape(c) for c in chars) + "]"
    return f"(?i)(?={cls(heads)})(?=(" + "|".join(re.escape(a) + "(?:" + "|".join(re.escape(b) + cls(c) for b, c in own.items()) + ")" for a, own in heads.items()) + "))"


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """rows (row, text) -> shard, trigram, rows: the texts of a shard that have a trigram, in order. Each text is read once."""
    shards = max(1, rows.count() // SHARD)
    held = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(any_of(trigrams)), F.lit(1)), lambda t: F.lower(t)))
    listed_rows = rows.select(F.pmod("row", F.lit(shards)).alias("shard"), F.explode(held).alias("trigram"), "row")
    return listed_rows.groupBy("shard", "trigram").agg(F.sort_array(F.collect_set("row")).alias("rows"))


def candidates(index: DataFrame, queries: dict[str, list[list[list[str]]]]) -> DataFrame:
    """index (shard, trigram, rows), queries by rule -> row, rules: the texts that a rule's query admits."""
    shards = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    none = F.array().cast("array<bigint>")
    rest = lambda x: F.slice(x, F.lit(2), F.size(x))
    posting = lambda t: F.coalesce(F.try_element_at("lists", t), none)
    form = lambda ts: F.aggregate(rest(ts), posting(F.get(ts, F.lit(0))), lambda held, t: F.array_intersect(held, posting(t)))
    clause = lambda forms: F.aggregate(forms, none, lambda held, f: F.array_union(held, form(f)))
    answer = lambda clauses: F.aggregate(rest(clauses), clause(F.get(clauses, F.lit(0))), lambda held, c: F.array_intersect(held, clause(c)))
    asked = F.from_json(F.lit(json.dumps([{"rule": name, "clauses": query} for name, query in queries.items()])), "array<struct<rule:string,clauses:array<array<array<string>>>>>")
    pairs = shards.select(F.inline(F.transform(asked, lambda q: F.struct(q["rule"].alias("rule"), answer(q["clauses"]).alias("rows"))))).select("rule", F.explode("rows").alias("row"))
    return pairs.groupBy("row").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + OWN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, and for each rule a column of spans array<struct<start,end,match>>."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row_key())
    queries = {r.name: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for form in clause for t in form})
    if queries:
        index = stored(postings(rows, trigrams), "postings")
        rows = rows.join(stored(candidates(index, queries), "candidates"), "row", "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))

    def spans(rule: Rule) -> Column:
        found = matches(F.col("text"), rule.pattern)
        if rule.keep:
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["match"], rule.keep, 1)) >= rule.least)
        if rule.name not in queries:
            return found
        return F.when(F.coalesce(F.array_contains("rules", rule.name), F.lit(False)), found).otherwise(F.array().cast(f"array<{SPAN}>"))

    return rows.select("doc_id", "text", *[spans(r).alias(r.name) for r in rules])


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir)).drop("text")
    by_kind = [kinds(F.col(r.name), r.name, i) for i, r in enumerate(BASE + OWN)]
    own = found.select("doc_id", *[F.size(r.name).cast("long").alias(f"n_{r.name}") for r in BASE], F.concat(*by_kind[: len(BASE)]).alias("base"), F.concat(*by_kind).alias("every"))
    return own.select("doc_id", *[f"n_{r.name}" for r in BASE], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"))
