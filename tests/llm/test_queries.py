"""The queries against brute force on a small table of odd rows, and on empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkwake.llm import ann, bpe, hmm, language_id, license_scan, packing, secret_scan, simhash, syncmers
from sparkwake.llm.registry import ORACLE_SQL, QUERIES

from .conftest import LOREM, TEXTS

DOCUMENT_QUERIES = [n for n in QUERIES if n not in ("op4_nearest_neighbours", "op11_sort_means")]
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRETS = {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def rows(spark, name, sf_dir):
    return sorted((r.asDict() for r in QUERIES[name](spark, sf_dir).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def test_pipeline_on_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_languages(spark, sf_dir):
    by = {r["doc_id"]: r for r in rows(spark, "op1_language_id", sf_dir)}
    assert len(by) == 14 and all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in by.items())
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 12)) and by[13]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in by.values())


def test_ngrams_whole_text():
    grams, counts = language_id.ngrams("Ab ab." * 100_000)
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True))[ord("a")] == 200_000


def simhash_of(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in (zip(w, w[1:], w[2:], strict=False) if len(w) >= 3 else [w])] if w else []
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_simhash(spark, sf_dir):
    found = rows(spark, "op2_simhash", sf_dir)
    prints = [(i, simhash_of(t)) for i, t, _ in TEXTS]
    root = list(range(len(prints)))
    for a, (_, x) in enumerate(prints):
        for b, (_, y) in enumerate(prints):
            if (x ^ y).bit_count() <= 3:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    least = {r: min((i for (i, _), q in zip(prints, root, strict=True) if q == r and i is not None), default=None) for r in root}
    want = Counter((i, f"{x:016x}", least[r]) for (i, x), r in zip(prints, root, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == want


@pytest.mark.parametrize("n", [10, 1000, 10**7, 10**10])
def test_plan_finds_every_near_pair(n):
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    parts = simhash.plan(sample, n)
    assert len({b for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)
    for x in sample[:50].tolist():
        flips = rng.choice(64, 3, replace=False)
        y = x ^ sum(1 << int(b) for b in flips)
        assert any(sum(int(b) in p.bits for b in flips) <= p.within for p in parts), (x, y)


def test_links_by_distance(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 12).tolist()
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, d, replace=False)) for b in base for d in (1, 2, 3, 4)]
    prints = sorted(set(map(int, base + near)))
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for parts in ([simhash.Part(tuple(range(0, 32)), 1), simhash.Part(tuple(range(32, 64)), 1)], [simhash.Part(tuple(range(0, 20)), 2), simhash.Part(tuple(range(20, 64)), 0)], simhash.plan(np.array(prints, np.uint64), 100)):
        assert {(r["a"], r["b"]) for r in simhash.links(df, parts).collect()} == want


def test_bpe(spark, sf_dir):
    ranks = bpe.load_ranks()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _ in TEXTS:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(array("i", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op3_byte_bpe", sf_dir)) == want
    for word in ("aaaaaaa" * 300, " éàü" * 400):
        assert bpe.heap_merges(word.encode(), ranks) == enc._encode_single_piece(word.encode())
    rng = random.Random(4)
    odd = ["".join(rng.choice("aab \x00\x01\téß日本\U0001f600'sx.,12") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    many = bpe.encode(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), most=50)
    assert {r["doc_id"]: list(array("I", r["ids"])) for r in many.collect()} == dict(enumerate(map(enc.encode_ordinary, odd)))
    small = bpe.encode(spark.createDataFrame([(1, "low lower lowest  x\n y"), (2, None)], "doc_id long, text string"), most=1)
    assert {r["doc_id"]: list(array("i", r["ids"])) for r in small.collect()} == {1: enc.encode_ordinary("low lower lowest  x\n y"), 2: []}


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300, None), (400, [0.0] * 8), (500, [float("nan")] * 8), (600, [1.0] * 8), (700, [1.0] * 8), (701, [1.0] * 8), (800, [1.0, 2.0]), (900, [None] * 8), (1000, [])]
    spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in data if v and None not in v and np.isfinite(v).all() and any(v)]
    want = {}
    for q, v in good:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))[:10]
            want |= {(q, k + 1): (i, round(d, 12)) for k, (d, i) in enumerate(best)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 12)) for r in QUERIES["op4_nearest_neighbours"](spark, f"file://{tmp_path}").collect()}
    assert got == want and "op4_nearest_neighbours" in ORACLE_SQL


def test_neighbours_of_none_and_of_huge_components(spark):
    search = lambda rows, k=2: {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(*[spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows[:1], rows)], k).collect()}
    assert search([]) == {}
    assert search([(0, [1e200, 0.0]), (1, [3e200, 0.0]), (2, [1.0, 1.0]), (3, [1e-200, 0.0])]) == {(0, 1): (2, 1e200), (0, 2): (3, 1e200)}
    assert search([(0, [3e-200, 0.0]), (1, [1e-200, 0.0]), (2, [1.0, 0.0])]) == {(0, 1): (1, pytest.approx(2e-200)), (0, 2): (2, 1.0)}


@pytest.mark.parametrize("heaps", [20_000, 1])
def test_neighbours_of_repeated_rows(spark, tmp_path, monkeypatch, heaps):
    """Each query row has its ten; repeated candidates count each; SQL says the same."""
    import duckdb

    monkeypatch.setattr(ann, "HEAPS", heaps)
    data = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (0, [5.0, 1.0]), (100, [9.0, 1.0])] + [(i, [float(i), 1.0]) for i in range(1, 21)] + [(7, [7.0, 1.0]), (8, [0.5, 1.0])]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    want = Counter()
    for q, v in data:
        if q % 100 == 0:
            want.update((q, k, i, d) for k, (d, i) in enumerate(sorted((abs(v[0] - w[0]), i) for i, w in data if i != q)[:10], 1))
    got = QUERIES["op4_nearest_neighbours"](spark, f"file://{tmp_path}")
    assert Counter(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want and len(list(want.elements())) == 40
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert Counter(con.execute(ORACLE_SQL["op4_nearest_neighbours"]).fetchall()) == want


def test_licenses(spark, sf_dir):
    by = {r["doc_id"]: r for r in rows(spark, "op5_license_scans", sf_dir)}
    assert (by[7]["n_base"], by[7]["first_word"], by[7]["base_labels"], by[7]["labels"], by[7]["score"]) == (1, 3, "mit", "mit,mit-notice", 1.0)
    assert by[3]["n_words"] == 0 and by[3]["first_word"] is None and by[3]["labels"] == "" and by[13]["n_words"] == 9000
    scan = license_scan.Scanner({"t": "one two [[maybe three]] {{2}} end"}, {"a a": "x"})
    accepts = lambda text: bool(scan.scan(text)[2])
    assert accepts("x One, two end") and accepts("one two maybe three q r end") and not accepts("one two a b c end") and not accepts("one maybe two end")
    assert [w for w, _ in scan.scan("a a a b")[1]] == [0, 1]


def test_fingerprints(spark, sf_dir):
    found = rows(spark, "op6_syncmers", sf_dir)
    order = sorted(((i, t or "") for i, t, _ in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    by = {r["doc_id"]: r for r in found}
    assert by[1]["fingerprint"] == by[10]["fingerprint"] != by[2]["fingerprint"] and by[2]["near_next"] > 0.5
    prints = lambda r, k: {base64.b64decode(r[k])[a : a + 6] for a in range(0, len(base64.b64decode(r[k])), 6)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert all(r["near_edited"] == like(prints(r, "fingerprint"), prints(r, "edited_fingerprint")) for r in found)
    nexts = {i: j for (i, _), (j, _) in zip(order, order[1:], strict=False) if i != j}
    assert all(by[i]["near_next"] == like(prints(by[i], "fingerprint"), prints(by[j], "fingerprint")) for i, j in nexts.items() if i != 10)


def test_anchors_by_brute_force(spark):
    rng = random.Random(1)
    texts = ["", "one two", *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (5, 6, 7, 40, 300)), LOREM + "\n" + LOREM]
    hashed = lambda expr, rows: [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x " + ("string" if isinstance(rows[0], str) else "array<bigint>")).select(expr).collect()]
    for text, own in zip(texts, [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(syncmers.anchors(F.col("t"))).collect()], strict=True):
        words = hashed(F.xxhash64("x"), text.lower().split()) if text else []
        mask = (1 << 48) - 1
        if len(words) < 6:
            assert [(a["at"], a["anchor"]) for a in own] == ([(0, hashed(F.xxhash64("x"), [words])[0] & mask)] if words else [])
            continue
        runs = hashed(F.xxhash64("x"), [words[k : k + 2] for k in range(len(words) - 1)])
        wide = hashed(F.xxhash64("x"), [words[k : k + 6] for k in range(len(words) - 5)])
        want = [(k, wide[k] & mask) for k in range(len(wide)) if min(runs[k : k + 5]) in (runs[k], runs[k + 4])]
        assert [(a["at"], a["anchor"]) for a in own] == want
    a, b = LOREM, "something else first " + LOREM
    shared = spark.createDataFrame([(a, b)], "a string, b string").select(syncmers.shared_places(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b")))).first()[0]
    assert shared and {s["other"] - s["at"] for s in shared} == {3}


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE", 3)
    monkeypatch.setattr(syncmers, "GROUP", 4)
    ids = [*random.Random(2).sample(range(1000), 90), None, None, 5, 5]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in syncmers.with_next(docs, {"n": F.length("text")}).collect()}
    assert got == {a: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}


def spans_of(text, patterns, good):
    return [[(m.start(), n, m.end(), k) for m in re.finditer(p, text, re.A) if good(k, m)] for n, (k, p) in enumerate(patterns.items())]


def good_pii(kind, m):
    d = re.sub("[^0-9]", "", m[0])
    luhn = sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def good_secret(kind, m):
    return len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]


@pytest.mark.parametrize(("name", "patterns", "good"), [("op7_pii", PII, good_pii), ("op8_secret_scans", SECRETS, good_secret)])
def test_base_spans(spark, sf_dir, name, patterns, good):
    want = Counter()
    for i, t, _ in TEXTS:
        own = spans_of(t or "", patterns, good)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(sum(own, [])))
        want[i, *map(len, own), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = rows(spark, name, sf_dir)
    assert Counter((r["doc_id"], *(r[f"n_{k}"] for k in patterns), r["base_sha256"]) for r in got) == want


def test_pii_from_context(spark):
    seeds = [(i, f"please write to user{i}@mail.example.com today") for i in range(6)]
    texts = [*seeds, (10, "please write to joe(at)home99123 today"), (11, "numbers 12345 are not data"), (12, None)]
    from sparkwake.llm.pii import find, mask

    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, source string")
    by = {r["doc_id"]: r for r in find(docs).collect()}
    assert [(s["start"], s["kind"]) for s in by[10]["found"]] == [(16, "like_email")] and not by[11]["found"] and by[0]["n_email"] == 1
    masked = {r["doc_id"]: r["text"] for r in mask(spark, docs, "").collect()}
    assert masked[0] == "please write to <email> today" and masked[10] == "please write to <like_email> today" and masked[11] == texts[7][1] and masked[12] is None


def test_trigram_queries(spark):
    assert secret_scan.trigram_query("abcd[0-9]+(ef|gh)ij") == [[["abc", "bcd"]], [["efi", "fij"], ["ghi", "hij"]]]
    assert secret_scan.trigram_query("[a-z]+") == [] and secret_scan.trigram_query("(abc)?x") == []
    texts = ["ghp_" + "a1B2" * 9, "xx ghp_short", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK", "-----BEGIN RSA PRIVATE KEY-----"]
    found = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: [k for k in ("github", "jwt", "pem") if r[k]] for r in found} == {0: ["github"], 1: [], 2: ["jwt"], 3: ["pem"]}


def test_packing(spark, sf_dir):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in TEXTS:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    got = rows(spark, "op9_best_fit_packing", sf_dir)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_added_tokens_as_the_library_has_them():
    own, library = packing.Encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> <|", "plain < | text", "a\x1cb don't 12 é"]
    assert [list(array("I", ids)) for ids in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice([7, 16, 50])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 80))), reverse=True)
        bins = []
        for s in items:
            rooms = [(cap - sum(b), k) for k, b in enumerate(bins) if cap - sum(b) >= s]
            (bins[min(rooms)[1]] if rooms else bins.append([]) or bins[-1]).append(s)
        filled = Counter()
        counts = Counter(items)
        for s, runs in packing.place(counts, cap).items():
            ends = [r[0] for r in runs[1:]] + [counts[s]]
            for (begin, first, each, _), end in zip(runs, ends, strict=True):
                for rank in range(begin, end):
                    filled[first + (rank - begin) // each] += s
        assert sorted(filled.values()) == sorted(map(sum, bins))


def test_language_model(spark, sf_dir):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t, _ in TEXTS if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)) for i, t, _ in TEXTS)
    got = rows(spark, "op10_hmm_scores", sf_dir)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    model = hmm.Model(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((5, 3)), 0))))
    sequences = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 4, 6, 4)]
    texts = hmm.Texts(sequences)
    got = np.empty(4)
    got[texts.order] = hmm.forward(model, texts)[0]
    for s, value in zip(sequences, got, strict=True):
        alpha = model.start * model.emits[s[0]]
        for x in s[1:]:
            alpha = (alpha @ model.moves) * model.emits[x]
        assert math.isclose(value, math.log10(alpha.sum()), rel_tol=1e-9)
    start, moves, emits = hmm.expected(model, texts)
    assert math.isclose(start.sum(), 4) and math.isclose(moves.sum(), 11) and math.isclose(emits.sum(), 15)


def test_pipeline(spark, sf_dir, docs):
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir).cache()
        seen.append((name, kept.count()))
        if name != "packing":
            assert kept.columns == columns
        if name == "language_id":
            assert {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7, 8, 9, 10, None, 11, 13}
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in kept.collect()]
            assert 1 in ids and 10 not in ids and None in ids
        if name == "personal_data":
            text = next(r["text"] for r in kept.collect() if r["doc_id"] == 7)
            assert "<email>" in text and "<phone>" in text and "<card>" in text and "<ip>" in text
    assert [n for n, _ in seen] == ["language_id", "near_duplicates", "personal_data", "packing"]
