"""Sort-means, decontamination and token alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwake.llm import alignment, decontaminate, sort_means
from sparkwake.llm.registry import ORACLE_SQL, QUERIES

from .conftest import ITEMS, TEXTS, items

DATA = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_sort_means", "op12_decontamination"])
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    assert [d[0] for d in want.description] == df.columns
    assert Counter(map(tuple, df.collect())) == Counter(want.fetchall())


# ---- sort-means


def lloyd(vectors, k=40, rounds=5):
    """vectors: (vec_id, list of floats). Plain comparison of every vector with every centroid in Python's integers."""
    kept = [(i, [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for n in range(len(centroids)):
            if mine := [v for (_, v), (_, c) in zip(kept, to, strict=True) if c == n]:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    to = assign()
    spread = Counter()
    for d, c in to:
        spread[c] += d
    fits = lambda x: x if x < 1 << 63 else None
    return Counter((i, c, fits(d), fits(spread[c]), fits(sum(spread.values())), sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, to, strict=True))


def written(spark, rows, path, kind="double"):
    spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, center string").write.parquet(f"file://{path}/embeddings.parquet")
    return f"file://{path}"


def vectors(n, spread=1.0, seed=5):
    r = random.Random(seed)
    homes = [[r.gauss(0, spread) for _ in range(64)] for _ in range(12)]
    return [(i, [x + r.gauss(0, spread / 4) for x in homes[r.randrange(12)]]) for i in range(n)]


ODD = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63), (907, [0.0] * 64), (None, [0.5] * 64), (908, [-0.001] * 64)]


@pytest.mark.parametrize("rows", [vectors(150) + ODD + [(3, [0.25] * 64)] * 5, vectors(12), [(7, [0.125] * 64)] * 50, vectors(60) + [(i, [float(i % 2)] * 64) for i in range(200, 260)]], ids=["odd", "fewer than k", "all alike", "ties"])
def test_sort_means(spark, rows, tmp_path):
    assert Counter(map(tuple, QUERIES["op11_sort_means"](spark, written(spark, rows, tmp_path)).collect())) == lloyd(rows)


def test_sort_means_huge_components(spark, tmp_path):
    rows = vectors(30) + [(500 + i, [3e6 * i] * 64) for i in range(20)] + [(600, [1e9] * 64), (601, [-1e9] * 64), (602, [1e17] * 64), (603, [1.1e17] * 64)]
    got = Counter(map(tuple, QUERIES["op11_sort_means"](spark, written(spark, rows, tmp_path)).collect()))
    assert got == lloyd(rows)


def test_sort_means_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert QUERIES["op11_sort_means"](spark, f"file://{tmp_path}").count() == 0


def test_assign_stops_strictly_beyond():
    """A centroid at exactly twice the distance is still measured, since it may tie with a smaller number."""
    held = sort_means.Centroids([[4], [0]])
    cluster, distance = held.assign(np.array([[2]], np.int64), np.array([1]))
    assert (cluster.tolist(), distance.tolist()) == ([0], [4])
    r = np.random.default_rng(1)
    for _ in range(50):
        held = sort_means.Centroids(r.integers(-9, 9, (11, 3)).tolist())
        v, old = r.integers(-9, 9, (200, 3)), r.integers(0, 11, 200)
        cluster, distance = held.assign(v, old)
        plain = ((v[:, None] - held.rows[None]) ** 2).sum(axis=2)
        assert (cluster == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


# ---- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(texts):
    """Distinct windows, each with its items."""
    found = {}
    for item, text in texts:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            found.setdefault(tuple(w[i : i + 10]), set()).add(item)
    return found


def report(doc, found):
    w, hit, ids = words(doc[1]), set(), set()
    for n in {len(x) for x in found}:
        for i in range(len(w) - n + 1):
            if (key := tuple(w[i : i + n])) in found:
                hit |= set(range(i, i + n))
                ids |= {str(x) for x in found[key] if x is not None}
    return doc[0], len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


@pytest.mark.parametrize(("block", "segment", "together"), [(200_000, 1 << 17, 1 << 20), (7, 1 << 17, 1 << 20), (200_000, 16, 64), (3, 11, 1)])
def test_decontamination(spark, sf_dir, monkeypatch, block, segment, together):
    for name, value in (("BLOCK", block), ("SEGMENT", segment), ("TOGETHER", together)):
        monkeypatch.setattr(decontaminate, name, value)
    found = windows(ITEMS)
    want = Counter(report((i, t), found) for i, t, _ in TEXTS)
    assert Counter(map(tuple, QUERIES["op12_decontamination"](spark, sf_dir).collect())) == want
    assert sum(r[5] for r in want.elements()) == 6  # 1, 2, both rows of 10, 6 and 13


def test_occurrences_in_parts(monkeypatch):
    """Rolling hashes over parts of texts find what plain comparison finds."""
    monkeypatch.setattr(decontaminate, "SEGMENT", 23)
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "b", "é", "x1"]) for _ in range(r.randrange(0, 200))) for _ in range(30)]
    items_ = [(n, " ".join(r.choice(["a", "b", "é", "x1"]) for _ in range(r.choice([3, 5, 12])))) for n in range(40)]
    found = windows(items_)
    block = decontaminate.Windows([(" ".join(w).encode(), str(i)) for w, ids in found.items() for i in ids])
    seen = decontaminate.Scanned(block, [t.encode() for t in texts])
    for k, t in enumerate(texts):
        want = report((0, t), found)
        assert (seen.words(k), int(seen.hits[k]), len(seen.items.get(k, ()))) == want[1:4]


def test_removal(spark, docs):
    found = windows(ITEMS)
    hit = {t: report((0, t), found)[2] / max(1, len(words(t))) for _, t, _ in TEXTS if t is not None}
    left = decontaminate.remove_spans(docs, items(spark))
    assert left.columns == docs.columns and left.count() == len(TEXTS)
    again = decontaminate.report(left, items(spark).where(F.length("text") > 30)).collect()
    assert not any(r["contaminated"] for r in again)
    texts = dict(left.where("doc_id = 6").select("doc_id", "text").collect())
    assert texts[6] == " la maison avec les enfants et ils mangent du pain pour la fête"
    assert {r["text"] for r in left.where("doc_id in (3, 4, 5, 9, 11)").collect()} == {t for i, t, _ in TEXTS if i in (3, 4, 5, 9, 11)}
    kept = decontaminate.remove_documents(docs, items(spark), share=0.5)
    assert kept.columns == docs.columns
    assert Counter(r["text"] for r in kept.collect()) == Counter(t for _, t, _ in TEXTS if t is None or hit[t] <= 0.5)


# ---- token alignment


SPACES = ["  two  spaces ", "a \n b\t c", " lead", "trail ", "x▁y", "<|endoftext|> <s> </s> <unk>", "naïve space \x1c odd", "\x00nul é ½ 𝒳 日本語", "''s 's don't   'll", "0x00 <0x41>", "a" * 300 + " " + "b" * 80, "　wide \u0085 x"]


def plain(docs):
    """Whole texts through both libraries; groups by common ends of byte ranges."""
    t = Tokenizer.from_file(alignment.A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.B)
    names, pieces, rows, links = alignment.byte_names(), {i: p for p, i in t.get_vocab().items()}, [], []
    for i, text in docs:
        raw = (" " + text).encode() if text else b""
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        in_a = [bytes(names[c] for c in pieces[x]) for x in a]
        in_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := sp.id_to_piece(x)) else p.replace("▁", " ").encode() for x in b]
        if not raw or b"".join(in_a) != raw or b"".join(in_b) != raw:
            rows.append((i, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = (dict(zip(np.cumsum([len(x) for x in s]).tolist(), range(len(s)), strict=True)) for s in (in_a, in_b))
        at_a = at_b = 0
        groups, own = [], []
        for e in sorted(ends_a.keys() & ends_b.keys()):
            groups.append(",".join(map(str, a[at_a : ends_a[e] + 1])) + "|" + ",".join(map(str, b[at_b : ends_b[e] + 1])))
            own.append((a[ends_a[e]], b[ends_b[e]]))
            at_a, at_b = ends_a[e] + 1, ends_b[e] + 1
        rows.append((i, len(a), len(b), len(groups), sha(";".join(groups))))
        links.append(own)
    n = Counter(x for own in links for x in own)
    best = {}
    for (_, b), k in n.items():
        best[b] = max(best.get(b, 0), k)
    return Counter((*r[:4], len(own), sum(n[x] == best[x[1]] for x in own), sum(n[x] for x in own), r[4]) for r, own in zip(rows, links, strict=True))


@pytest.mark.parametrize("common", [500_000, 20, 0])
def test_token_alignment(spark, docs, tmp_path, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    texts = [(i, t) for i, t, _ in TEXTS] + [(100 + n, t) for n, t in enumerate(SPACES)]
    more = spark.createDataFrame([(100 + n, t) for n, t in enumerate(SPACES)], "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = Counter(map(tuple, QUERIES["op13_token_alignment"](spark, f"file://{tmp_path}").collect()))
    want = plain(texts)
    assert got == want and sum(r[1] == 0 for r in want) >= 3


def test_alignment_forgets(monkeypatch):
    """Bounds on what a worker keeps change nothing."""
    texts = [t for _, t, _ in TEXTS] + SPACES
    want = list(alignment.Aligner(alignment.A, alignment.B).texts(texts))
    for name, value in (("KEPT", 3), ("TRANSITIONS", 5), ("TOGETHER", 7)):
        monkeypatch.setattr(alignment, name, value)
    small = alignment.Aligner(alignment.A, alignment.B)
    assert [x for t in texts for x in small.texts([t])] == want


def test_transducer():
    t = alignment.Transducer({0: b" ab", 1: b"c", 2: b"def"}, {0: b" ", 1: b"a", 2: b"bcd", 3: b"ef", 4: b"x"})
    assert t.groups([0, 1, 2], [0, 1, 2, 3]) == [(3, 4)]
    assert t.groups([1, 0], [4, 0]) is None and t.groups([0], [0, 1]) is None and t.groups([], []) == []


def test_mapping(spark, docs):
    rows = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in alignment.mapping(docs).collect()}
    assert max(n for n, _ in rows.values()) >= 9000  # doc 13 repeats one word
    assert all(best == (n == max(m for (_, y), (m, _) in rows.items() if y == b)) for (_, b), (n, best) in rows.items())
