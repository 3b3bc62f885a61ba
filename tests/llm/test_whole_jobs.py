"""Cases in which the operators once read less than the whole."""

from __future__ import annotations

import random

import numpy as np

from pyspark.sql import functions as F

from sparkwake.llm import hmm, language_id, pii, secret_scan, simhash


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stage_joins_texts_of_similarity(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts.append(" ".join(words))
        for changes in (2, 5, 12):
            near = list(words)
            for at in rng.sample(range(300), changes):
                near[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(near))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(spark, docs, "").collect())
    assert kept == sorted(set(root)) and len(kept) < len(texts)


def test_training_texts_are_not_cut():
    long = [np.arange(n, dtype=np.int32) for n in (3, 1500, 5000)]
    got = [t for texts in hmm.gathered(iter(long)) for t in texts.lengths.tolist()]
    assert sorted(got) == [3, 1500, 5000]


def test_moves_across_long_texts_are_counted(spark):
    words = [f"w{k % 7}" for k in range(3000)]
    docs = spark.createDataFrame([(" ".join(words),)], "text string")
    vocabulary = sorted({w.encode() for w in words})
    counts = np.array([1, *([3000 / 7] * 7), *([0] * hmm.CLASSES)], float)
    model = hmm.train(docs, vocabulary, counts, states=2, rounds=2)
    first = hmm.first_model(counts, 2)
    read = hmm.Symbols(vocabulary).read(hmm.words_of(" ".join(words)))
    for _ in range(2):
        start, moves, emits = hmm.expected(first, hmm.Texts([read]))
        emits = emits + hmm.PRIOR * ((counts + 0.5) / (counts + 0.5).sum())[:, None]
        moves, start = moves + 1e-3, start + 1e-3
        first = hmm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    assert np.allclose(model.moves, first.moves) and np.allclose(model.start, first.start) and np.allclose(model.emits, first.emits)


def test_language_stage_uses_the_score(spark):
    english = "the cat and the dog went over to a house by the sea where they sat for a while and then went home again"
    rows = [(i, english + " and " * (i % 5), "en") for i in range(40)] + [(100, "xqzjk vwqxz jjkqx zzxqv wkxjq qqzxj " * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language_id.keep_known(spark, docs, "").collect()} == set(range(40))
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_known(spark, bare, "").count() == 41


def test_profiles_of_all_texts(spark):
    """Letters that one text each of forty thousand has are in the profile."""
    rare = "bcdefghi"
    texts = F.when(F.col("id") < len(rare), F.substring(F.lit(rare), F.col("id").cast("int") + 1, F.lit(1))).otherwise("a")
    docs = spark.range(40_000, numPartitions=4).select(F.col("id").alias("doc_id"), texts.alias("text"), F.lit("en").alias("lang"))
    assert {ord(c) for c in rare} < set(language_id.fit(docs)["en"])


def test_least_score_of_all_labelled_texts(spark):
    """The percentile is that of every labelled text's score, of two languages of 5000 and 7 texts."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", [rng.random() for _ in range(9)], k=rng.randrange(20, 200))) + "a" for _ in range(5007)]
    rows = [(i, t, "en" if i < 5000 else "fr") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (6000, "zzzz", None), (6001, None, "en"), (6002, "1 2", "en")], "doc_id long, text string, lang string")
    profiles = {"en": language_id.ranking(*language_id.ngrams(" ".join(texts[:50])), 300).tolist()}
    model = language_id.Profiles(profiles, language_id.PROFILE_SIZE)
    scores = sorted(model.predict(t)[1] for t in texts)
    assert scores[49] < scores[50] < scores[51]
    assert language_id.least_score(docs, profiles) == language_id.SHARE * scores[50]  # the 51st of 5007
    assert language_id.least_score(docs.where("text is null"), profiles) == 0


def test_whole_identifiers_and_neighbours(spark):
    long, pad = "id" + "9" * 200, "w" * 60
    seeds = [(i, f"please write to user{i}@mail.example.com today") for i in range(6)] + [(20 + i, f"{pad} to{' ' * 9}user{i}@mail.example.com") for i in range(6)]
    texts = [*seeds, (10, f"please write to {long} now"), (11, f"{pad} to {'a' * 90}@9x y"), (12, "write to a111 b222")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    by = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [(s["start"], s["end"]) for s in by[10]["found"]] == [(16, 16 + len(long))]
    assert [(s["start"], s["end"]) for s in by[11]["found"]] == [(64, 64 + 93)]
    near = {r["doc_id"]: [(p["left"], p["token"]) for p in r["near"]] for r in pii.base(docs).collect()}
    assert near[12] == [("write to", "a111"), ("to a111", "b222")]
    assert {r["doc_id"]: r["text"] for r in pii.mask(spark, docs, "").collect()}[10] == "please write to <like_email> now"


def test_long_secrets(spark):
    part = "A" * 3000
    texts = [f"eyJ{part}.eyJ{part}.{part}", "ghp_" + "a" * 400, "xoxb-" + "1" * 400, "sk_live_" + "b" * 400]
    found = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, kind in enumerate(("jwt", "github", "slack", "stripe")):
        assert [(s["start"], s["end"]) for s in found[i][kind]] == [(0, len(texts[i]))]


def test_very_many_spans_in_one_text(spark):
    docs = spark.createDataFrame([(1, "host 10.0.0.1 " * 30_000)], "doc_id long, text string")
    found = pii.find(docs).collect()[0]
    assert found["n_ip"] == 30_000 and [(s["start"], s["end"]) for s in found["base"]] == [(5 + 14 * k, 13 + 14 * k) for k in range(30_000)]
    assert pii.mask(spark, docs, "").collect()[0]["text"] == "host <ip> " * 30_000
    secrets = spark.createDataFrame([(1, "password=abcdef1 " * 30_000)], "doc_id long, text string")
    assert [(s["start"], s["end"]) for s in secret_scan.scan(secrets).collect()[0]["assign"]] == [(17 * k, 17 * k + 16) for k in range(30_000)]


def test_masked_like_one_by_one(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é日\U0001f600﻿") for _ in range(rng.randrange(1, 40)))
        spans = [(a, rng.randrange(2), rng.randrange(a + 1, len(text) + 1), rng.choice("xy")) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(0, 6)))]
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,order:int,end:int,kind:string>>")
    got = {r["i"]: r["done"] for r in df.select("i", pii.masked(F.col("text"), F.col("spans")).alias("done")).collect()}
    for i, text, spans in rows:
        at, done = 0, ""
        for start, _, end, kind in sorted(spans):
            if start >= at:
                done += text[at:start] + f"<{kind}>"
            at = max(at, end)
        assert got[i] == done + text[at:], (text, spans)


def places_of(text):
    """Identifiers, the two words before each and the kind of the first base span that begins in it."""
    import re

    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", text)]
    out = []
    for k, (at, w) in enumerate(words):
        if ("@" in w or len(re.findall("[0-9]", w)) >= 3) and k >= 2:
            out.append((f"{words[k - 2][1]} {words[k - 1][1]}".lower(), w, at))
    return out


def test_places_by_brute_force(spark):
    rng = random.Random(6)
    parts = ["to", "Me", "a@b.co", "1234", "10.0.0.1", "+1 (743) 555-3824", "4111 1111 1111 1111", "x1y2z3", "  ", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.base(docs).collect():
        text = texts[r["doc_id"]]
        assert [(p["left"], p["token"], p["start"]) for p in r["near"]] == places_of(text)
        spans = sorted((s["start"], n, s["end"], k) for n, k in enumerate(pii.ORDER) for s in r[k])
        for p in r["near"]:
            inside = [s for s in spans if p["start"] <= s[0] < p["start"] + len(p["token"])]
            assert p["kind"] == (inside[0][3] if inside else None) and p["free"] == all(s[2] <= p["start"] for s in spans if s[0] < p["start"])


def test_patterns_by_brute_force(spark):
    rng = random.Random(7)
    near = [(rng.choice(["l1", "l2", "l3", "l4"]), rng.choice([f"t{k}" for k in range(12)])) for _ in range(120)]
    seeds = {f"t{k}": "email" if k % 2 else "ip" for k in range(7)}
    places = {}
    for left, token in near:
        places[left, token] = places.get((left, token), 0) + 1
    trust = {t: float(t in seeds) for _, t in places}
    for _ in range(pii.ROUNDS):
        conf = {}
        for left in {a for a, _ in places}:
            own = [(t, n) for (a, t), n in places.items() if a == left]
            conf[left] = sum(n * trust[t] for t, n in own) / (sum(n for _, n in own) + 1)
        trust = {t: max(float(t in seeds), pii.DAMPING * max(conf[a] for a, b in places if b == t)) for t in trust}
    want = {}
    for left, c in conf.items():
        kinds = [seeds[t] for a, t in places if a == left and t in seeds]
        best = max(((kinds.count(k), k) for k in set(kinds)), default=(0, None))
        if best[0] >= pii.SUPPORT and c >= pii.CONFIDENCE:
            want[left] = (best[1], round(c, 9))
    df = spark.createDataFrame([(a, t, seeds.get(t)) for a, t in near], "left string, token string, kind string")
    assert {r["left"]: (r["kind"], round(r["confidence"], 9)) for r in pii.patterns(df).collect()} == want and want


def test_secret_rules_by_brute_force(spark):
    import re

    rng = random.Random(8)
    parts = ["ghp_" + "a1B2" * 9, "gho_short", "xoxb-1234567890-ab", "AIza" + "x" * 35, "sk_live_" + "9" * 16, "rk_live_1", "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "API_KEY: 'abcdef'", "Token=1", "AKIA" + "Z" * 16, "f" * 24, "é", " ", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    rules = secret_scan.BASE + secret_scan.OWN
    for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        for rule in rules:
            found = [m for m in re.finditer(rule.pattern, texts[r["doc_id"]], re.A) if not rule.keep or len(m[2]) >= rule.least]
            assert [(s["start"], s["end"]) for s in r[rule.name]] == [m.span() for m in found], (rule.name, texts[r["doc_id"]])


def test_long_common_words_are_symbols(spark):
    url = "http://example.com/" + "x" * 100
    texts = [f"see {url} and w{k} {'y' * 90}{k}" for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = {bytes(r["word"]): r["n"] for r in hmm.count_words(docs).collect()}
    assert counted[hmm.key(url.encode())] == 8 and max(map(len, counted)) <= hmm.WORD_BYTES
    symbols = hmm.Symbols([b"see", hmm.key(url.encode())])
    assert symbols.read([b"see", url.encode(), b"zz"]).tolist() == [1, 2, 3 + hmm.word_class(b"zz"), 0]
    rows = {r["doc_id"]: r for r in hmm.score(docs, docs.select("text"), states=2, rounds=1).collect()}
    assert all(r["n_tokens"] == r["n_known"] == 6 for r in rows.values())


def test_baum_welch_on_a_toy(spark):
    """Two rounds over few texts give what a plain forward-backward gives, and likelihood does not fall."""
    rng = random.Random(9)
    vocabulary = [b"a", b"b", b"c"]
    sequences = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))] for _ in range(6)]
    docs = spark.createDataFrame([(" ".join(w.decode() for w in s),) for s in sequences], "text string").repartition(3)
    counts = np.array([6, *(sum(s.count(w) for s in sequences) for w in vocabulary), *([0] * hmm.CLASSES)], float)
    model = hmm.first_model(counts, 3)
    unigram = (counts + 0.5) / (counts + 0.5).sum()
    for _ in range(2):
        start, moves, emits = np.full(3, 1e-3), np.full((3, 3), 1e-3), hmm.PRIOR * unigram[:, None] * np.ones(3)
        for s in sequences:
            x = [1 + vocabulary.index(w) for w in s] + [0]
            alpha = [model.start * model.emits[x[0]]]
            for t in x[1:]:
                alpha.append((alpha[-1] @ model.moves) * model.emits[t])
            beta = [np.ones(3)]
            for t in reversed(x[1:]):
                beta.insert(0, model.moves @ (model.emits[t] * beta[0]))
            p = alpha[-1].sum()
            for k, t in enumerate(x):
                gamma = alpha[k] * beta[k] / p
                emits[t] += gamma
                start = start + gamma if k == 0 else start
                if k:
                    moves += alpha[k - 1][:, None] * model.moves * (model.emits[t] * beta[k])[None, :] / p
        model = hmm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    got = hmm.train(docs, vocabulary, counts, states=3, rounds=2)
    assert np.allclose(got.start, model.start) and np.allclose(got.moves, model.moves) and np.allclose(got.emits, model.emits)


def test_short_texts_do_not_wait_for_long_ones():
    """Texts train with those of like length, all of them, and their expected counts are those of plain forward-backward."""
    rng = np.random.default_rng(3)
    model = hmm.first_model(rng.integers(1, 50, 20).astype(float), 3)
    sequences = [rng.integers(0, 20, n).astype(np.int32) for n in (1, 2, 200, 255, 300, 511, 700, 4000, 4100, 9000, 200)]
    batches = list(hmm.gathered(iter(sequences)))
    assert sorted(n for b in batches for n in b.lengths.tolist()) == sorted(map(len, sequences))
    assert sorted(len(b.many) for b in batches) == [255, 511, 700, 4000, 9000]
    got = [sum(parts) for parts in zip(*(hmm.expected(model, b) for b in batches), strict=True)]
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((20, 3))
    for s in sequences:
        alpha, beta = np.empty((len(s), 3)), np.ones((len(s), 3))
        for t, x in enumerate(s):
            alpha[t] = (alpha[t - 1] @ model.moves if t else model.start) * model.emits[x]
            alpha[t] /= alpha[t].sum()
        for t in range(len(s) - 1, 0, -1):
            beta[t - 1] = model.moves @ (model.emits[s[t]] * beta[t])
            beta[t - 1] /= beta[t - 1].sum()
            pair = alpha[t - 1][:, None] * model.moves * (model.emits[s[t]] * beta[t])
            moves += pair / pair.sum()
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        start += gamma[0]
        np.add.at(emits, s, gamma)
    assert all(np.allclose(a, b) for a, b in zip(got, (start, moves, emits), strict=True))
