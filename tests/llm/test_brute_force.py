"""Language ID and license scans of whole tables, every column recomputed in plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest

from sparkwake.llm.registry import QUERIES

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
EDGE = chr(1)


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]


def grams(text):
    counts = Counter()
    low = "".join(c if c.isalpha() else EDGE for c in (text or "").lower())
    for word in filter(None, low.split(EDGE)):
        padded = EDGE + word + EDGE
        counts.update(word)
        counts.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return counts


def number(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:300]]


def test_languages_by_rank_order(spark, docs):
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    trained: dict[str, Counter] = {}
    for i, text, lang in docs:
        if lang is not None and text is not None and not held[i]:
            trained.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: n for n, g in enumerate(ranked(trained[lang]))} for lang in sorted(trained)}
    want = Counter()
    for i, text, _ in docs:
        own = ranked(grams(text))
        far = {lang: sum(abs(p[g] - n) if g in p else 300 for n, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k)) if own else "und"
        want[i, held[i], best, round(1 - far[best] / (300 * len(own)), 9) if own else 0.0] += 1
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in QUERIES["op1_language_id"](spark, DATA).collect())
    assert got == want and len(profiles) == 4


def test_license_columns(spark):
    phrases = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
    want = Counter()
    for i, text in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(n, label) for phrase, label in phrases for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split()]
        places = [n for n, _ in at]
        want[i, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))] += 1
    rows = QUERIES["op5_license_scans"](spark, MORE).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == want
    assert sum(k[2] > 0 for k in want) > 3
    for r in rows:
        base, labels = set(filter(None, r["base_labels"].split(","))), r["labels"].split(",") if r["labels"] else []
        assert base <= set(labels) and labels == sorted(set(labels)) and 0 <= r["score"] <= 1
