"""Small source trees, from files to services, edges and runtime calls."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkwake.functions.labels import confidence_label, type_label
from sparkwake.functions.scalars import glob_pattern, jaro_winkler
from sparkwake.operators.discover import attempts, discover
from sparkwake.operators.extract import facts, is_read
from sparkwake.operators.review import evidence, links
from sparkwake.operators.runtime_join import match_names
from sparkwake.operators.workloads import Manifests
from sparkwake.plans.analyze import analyze, with_runtime
from sparkwake.sources.files import compose_env, dotenv, interpolate

TREE = {
    "docker-compose.yml": "services:\n  shop:\n    build: ./shop\n    environment:\n      STOCK_HOST: stock\n  stock:\n    build: ./stock\n  mail:\n    build: ./mail\n  cache:\n    image: redis:7\n  kafka:\n    image: bitnami/kafka:3\n",
    "shop/package.json": '{\n "name": "@x/shop",\n "dependencies": {\n  "@x/stock": "workspace:*"\n }\n}',
    "shop/main.js": "const { Kafka } = require('kafkajs');\nfetch(`http://${host}/x`);\nconst h = process.env.STOCK_HOST || 'stock';\nconst c = 'redis://cache:6379/0';\nawait producer.send({ topic: 'order-created' });\n",
    "stock/package.json": '{"name": "@x/stock"}',
    "stock/main.js": "// nothing\n",
    "mail/pom.xml": "<project/>",
    "mail/Mail.java": 'import org.x.y;\n@KafkaListener(topics = "order-created")\nvoid on(String s) {}\n',
    "node_modules/x/package.json": "{}",
    "README": "text",
    "stock/Dockerfile": "FROM scratch\nENV CACHE=redis://cache:6379/1\n",
    "stock/notes.md": "redis://kafka:6379/0",
    "mail/mail.proto": 'syntax = "proto3";\npackage a.b;\n\nservice Mailer {\n}\n',
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root, analyze(spark, {"tree": str(root)})


def test_services(graph):
    _, a = graph
    assert [(r["name"], r["root"], r["role"], r["language"]) for r in a.services.orderBy("pos").collect()] == [("mail", "mail", "code", "java"), ("shop", "shop", "code", "javascript"), ("stock", "stock", "code", "javascript"), ("cache", None, "infrastructure", None), ("kafka", None, "infrastructure", None)]


def test_edges(graph):
    _, a = graph
    found = {(r["source"], r["target"], r["t"]): r["c"] for r in a.edges.select("source", "target", type_label(F.col("type_ord")).alias("t"), confidence_label(F.col("conf_rank")).alias("c")).collect()}
    assert found == {("shop", "stock", "http"): "static", ("shop", "cache", "database"): "static", ("shop", "kafka", "event"): "inferred", ("shop", "mail", "event"): "inferred", ("shop", "stock", "import"): "static", ("stock", "cache", "database"): "static"}


def test_blast(spark, graph):
    _, a = graph
    changes = spark.createDataFrame([("1", "tree", "./stock/main.js"), ("1", "tree", "README")], "change_id string, repo_id string, file string")
    assert [(r["service"], r["depth"]) for r in a.blast(changes).orderBy("service").collect()] == [("mail", 2), ("shop", 1)]
    with pytest.raises(ValueError):
        a.edges_of("nobody")
    assert {r["target"] for r in a.edges_of("shop").collect()} == {"stock", "cache", "kafka", "mail"}


def test_files_read(spark):
    names = ["a/Dockerfile", "a/run.sh", "a/x.tf", "b.cjs", "LICENSE", "a/package-lock.json", "x.min.js", "a/README.md", "own-lock.json"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r["path"] for r in files.where(is_read(F.col("path"))).collect()] == names[:4]
    assert list(facts("a/x.proto", "package a.b;\n\nservice Mailer {\n}\nservice Two {}\n")) == [(3, "proto", "Mailer", "a.b", None), (5, "proto", "Two", "a.b", None)]


def test_workloads(spark):
    pod = "spec:\n      containers:\n      - image: x/{0}:1\n"
    job = "kind: Job\nmetadata:\n  name: once\nspec:\n  template:\n    " + pod.format("once")
    cron = "kind: CronJob\nmetadata:\n  name: nightly\nspec:\n  jobTemplate:\n    spec:\n      template:\n        spec:\n          containers:\n          - image: x/nightly:1\n            env:\n            - name: A\n              value: b\n"
    both = {"k.yaml": job + "---\n" + cron, "docker-compose.yml": job.replace("once", "twice"), "svc.yaml": "kind: Service\nmetadata: {name: once}\n", "other.yaml": "a: [1"}
    texts = spark.createDataFrame([("r", p, t) for p, t in both.items()], "repo_id string, path string, text string")
    found = discover(texts.select("repo_id", "path"), texts).orderBy("name").collect()
    assert [(s["name"], s["image"], s["detail"], s["strategy"]) for s in found] == [("nightly", "x/nightly:1", "kind: CronJob", "kubernetes"), ("once", "x/once:1", "kind: Job", "kubernetes")]
    assert [(r["service"], r["variable"], r["value"]) for r in Manifests(texts).environment().collect()] == [("nightly", "A", "b")]
    none = texts.limit(0)
    assert discover(none.select("repo_id", "path"), none).count() == 0 and Manifests(none).environment().count() == 0


def test_evidence_of_its_own_repository(spark):
    step = "array<struct<from:string,to:string,relation:string,confidence:string>>"
    reached = spark.createDataFrame([("1", r, "b", 1, 1, [("a", "b", "calls", "inferred")]) for r in ("r1", "r2")], f"change_id string, repo_id string, service string, depth int, conf_rank int, path {step}")
    edges = spark.createDataFrame([("r1", "b", "a", 0, 1, ["of r1"]), ("r2", "b", "a", 0, 2, ["of r2"])], "repo_id string, source string, target string, type_ord int, conf_rank int, evidence array<string>")
    assert {(r["repo_id"], r["n"]): r["evidence"] for r in evidence(links(reached), edges).collect()} == {("r1", 1): ["of r1"], ("r2", 2): ["of r2"]}


def test_mapping_to_no_service(spark):
    names = spark.createDataFrame([("r", "pay"), ("r", "x")], "repo_id string, runtime string")
    services = spark.createDataFrame([("r", "payments", 0), ("q", "other", 0)], "repo_id string, name string, pos int")
    assert {r["runtime"]: r["service"] for r in match_names(names, services, {"pay": "payments"}).collect()} == {"pay": "payments", "x": None}
    with pytest.raises(Exception, match="mapped to no service"):
        match_names(names, services, {"pay": "other"}).collect()
    assert match_names(names, services, {"pay": "other"}, ("pay",)).where("runtime = 'pay'").first()["how"] == "ignored"


def test_runtime(spark, graph, tmp_path):
    _, a = graph
    scrape = tmp_path / "calls.prom"
    scrape.write_text('# x\ntraces_service_graph_request_total{client="shop-api",server="stock"} 3.6\ntraces_service_graph_request_total{client="stock",server="mail",connection_type="messaging_system"} 2\ntraces_service_graph_request_total{client="who",server="mail"} 1\nother{client="a",server="b"} 1\n')
    b, mapping, counts = with_runtime(a, spark, "tree", str(scrape))
    assert {r["runtime"]: r["how"] for r in mapping.collect()} == {"shop-api": "normalised", "stock": "exact", "mail": "exact", "who": "unmatched"}
    assert {(r["source"], r["target"]): (r["calls"], r["runtime_only"]) for r in b.edges.where("conf_rank = 3").select("source", "target", "calls", F.col("n_evidence").isNull().alias("runtime_only")).collect()} == {("shop", "stock"): (4, False), ("stock", "mail"): (2, True)}
    assert tuple(counts.first())[1:] == (4, 3, 1, 2, 1, 1, 1)  # the last: one call confirmed an edge
    pieces = {(r["source"], r["target"]): [(e["file"], e["line"], e["detail"]) for e in r["evidence"]] for r in b.edges.where("conf_rank = 3").collect()}
    assert pieces["shop", "stock"][0] == (str(scrape), None, "4 calls (otel servicegraph)") and len(pieces["shop", "stock"]) == 1 + a.edges.where("source = 'shop' AND target = 'stock' AND type_ord = 0").first()["n_evidence"]
    assert pieces["stock", "mail"] == [(str(scrape), None, "2 calls (otel servicegraph)")]
    dog = tmp_path / "dog.json"
    dog.write_text(json.dumps({"shop": {"calls": ["stock", 3, ""], "calls_out": ["mail"]}}))
    b, _, counts = with_runtime(a, spark, "tree", str(dog))
    assert b.edges.where("conf_rank = 3").select("source", "target", "calls", "observed").collect()[0][:] == ("shop", "stock", None, "datadog")


def test_strategies():
    package = '{"name": "x", "workspaces": ["libs/*", "!libs/tools"]}'
    rows = attempts("r", ["package.json", "libs/a/package.json", "libs/b/go.mod", "libs/tools/package.json", "apps/web/package.json", "apps/api/Dockerfile"], {"package.json": package})
    assert [(r[1], r[3]) for r in rows] == [("monorepo", "api"), ("monorepo", "web"), ("workspace", "a"), ("workspace", "b")]
    assert attempts("r", ["package.json"], {})[0][1:5] == ("root", 4, "r", ".")
    assert attempts("r", [], {}) == []


def test_texts():
    assert dotenv("export A='x y'\nB=1 # c\n# D=2\nC=\n") == [("A", "x y", 1), ("B", "1", 2), ("C", "", 4)]
    assert interpolate("${A}-${B:-d}-${C-e}-$D-${E}", {"A": "1", "D": "2", "B": ""}) == "1-d-e-2-${E}"
    assert compose_env("A=1\nB=${A}2", "A=3\nC=$B") == {"A": "3", "B": "12", "C": "12"}
    import re

    assert re.match(glob_pattern("a/**/*.{js,ts}"), "a/b/c/x.ts") and not re.match(glob_pattern("a/*"), "a/b/c")
    assert round(jaro_winkler("chckout", "checkout"), 4) == 0.9667 and jaro_winkler("", "x") == 0
