"""Runs of production calls put into edges, one after another."""

from __future__ import annotations

import random

from sparkwake.functions.labels import EDGE_TYPES
from sparkwake.operators import runtime_join

KINDS = ("http", "grpc", "event", "database", "unknown")
CALLS = "repo_id string, client string, server string, source string, target string, calls long, kind string, first_seen long"
EDGES = "repo_id string, source string, target string, type_ord int, conf_rank int, db_key string, evidence array<struct<file:string,line:int,detail:string>>"


def calls_of(rng, first, n):
    names = ["a", "b", "c", "d", None]
    rows = []
    for k in range(n):
        s, t = rng.choice(names), rng.choice(names)
        rows.append(("r", s or "x", t or "y", s, t, rng.choice([None, 1, 5]), rng.choice(KINDS), first + k))
    return rows


def model(edges, runs, name):
    """Call by call: every edge of the pair that fits is confirmed, else one is added. -> {(source, target, type): (rank, calls, evidence)}, confirmed."""
    fits = {"http": (0, 2), "grpc": (0, 2), "unknown": (0, 2), "event": (1,), "database": (3,)}
    made = {"http": 0, "unknown": 0, "grpc": 2, "event": 1, "database": 3}
    held = {(s, t, o): [rank, None, list(evidence)] for _, s, t, o, rank, _, evidence in edges}
    confirmed = []
    for run in runs:
        there, n = set(held), 0
        for _, _, _, s, t, calls, kind, _ in run:
            if s is None or t is None or s == t:
                continue
            found = [k for k in held if k[:2] == (s, t) and k[2] in fits[kind]]
            n += any(k in there for k in found)
            for k in found or [(s, t, made[kind])]:
                edge = held.setdefault(k, [3, None, []])
                edge[0], edge[1] = 3, calls if edge[1] is None else edge[1] + (calls or 0)
                piece = (name, None, ("observed" if edge[1] is None else f"{edge[1]} calls") + " (otel servicegraph)")
                at = [i for i, e in enumerate(edge[2]) if e[:2] == (name, None)]
                edge[2][at[0] if at else 0 : at[0] + 1 if at else 0] = [piece]
        confirmed.append(n)
    return {k: (rank, calls, evidence) for k, (rank, calls, evidence) in held.items()}, confirmed


def seen(merged):
    return {(r["source"], r["target"], r["type_ord"]): (r["conf_rank"], r["calls"], [tuple(e) for e in r["evidence"] or []]) for r in merged.collect()}


def test_runs_in_turn(spark):
    rng = random.Random(9)
    edges = [("r", s, t, o, rng.randrange(3), f"{s}{t}", [("f.js", 3, "x")] * rng.randrange(3)) for s in "abcd" for t in "abcd" for o in range(len(EDGE_TYPES)) if s != t and rng.random() < 0.3]
    runs = [calls_of(rng, 0, 25), calls_of(rng, 100, 25)]
    frame = spark.createDataFrame(edges, EDGES)
    one, two = (spark.createDataFrame(r, CALLS) for r in runs)
    mapping = spark.createDataFrame([("r", "a", "a", "exact")], "repo_id string, runtime string, service string, how string")
    first = runtime_join.merge(frame, one, read_from="p")
    second = runtime_join.merge(first, two, read_from="p")
    want, confirmed = model(edges, runs, "p")
    assert seen(second) == want
    assert seen(runtime_join.merge(frame, one.unionByName(two), read_from="p")) == want  # one run of both
    assert [runtime_join.counts(m, c, mapping).first()["confirmed"] for m, c in ((first, one), (second, two))] == confirmed
    assert {r["db_key"] for r in second.where("conf_rank < 3").collect()} <= {e[5] for e in edges}


def test_no_calls(spark):
    frame = spark.createDataFrame([("r", "a", "b", 0, 1, None, [("f", 1, None)])], EDGES)
    out = runtime_join.merge(frame, spark.createDataFrame([], CALLS))
    assert seen(out) == {("a", "b", 0): (1, None, [("f", 1, None)])} and out.first()["observed"] is None
    assert runtime_join.merge(frame.limit(0), spark.createDataFrame([], CALLS)).count() == 0
