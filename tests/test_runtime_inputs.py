"""What runtime inputs are, by all of their lines."""

from __future__ import annotations

import json

import pytest

from sparkwake.functions.scalars import is_topic_key
from sparkwake.sources import runtime_calls


def span(n, parent, service, kind="SPAN_KIND_SERVER"):
    name = {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]}
    return {"resource": name, "scopeSpans": [{"spans": [{"spanId": str(n), "parentSpanId": parent, "kind": kind}]}]}


def read(spark, path):
    how, calls = runtime_calls.read(spark, str(path))
    return how, sorted((r["client"], r["server"]) for r in calls.select("client", "server").collect())


def test_scrape_behind_other_metrics(spark, tmp_path):
    other = "".join(f'other_total{{pod="p{n}"}} {n}\n' for n in range(5000))
    (tmp_path / "s.prom").write_text(other + 'traces_service_graph_request_total{client="a",server="b"} 1\n')
    assert read(spark, tmp_path / "s.prom") == ("prometheus", [("a", "b")])


def test_spans_of_one_document_and_of_lines(spark, tmp_path):
    spans = [span(1, "", "web"), span(2, "1", "cart"), span(3, "2", "db")]
    padded = {"note": "x" * 100_000, "resourceSpans": spans}
    (tmp_path / "one.json").write_text(json.dumps(padded, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"resourceSpans": [s]}) for s in spans) + "\n\n")
    want = ("otlp", [("cart", "db"), ("web", "cart")])
    assert read(spark, tmp_path / "one.json") == want and read(spark, tmp_path / "lines.json") == want


def test_dependencies(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"web": {"calls": ["cart"]}}, indent=2))
    (tmp_path / "l.json").write_text('{"web": {"calls": ["cart"]}}\n{"cart": {"calls_out": ["db"]}}\n')
    assert read(spark, tmp_path / "d.json") == ("datadog", [("web", "cart")])
    assert read(spark, tmp_path / "l.json") == ("datadog", [("cart", "db"), ("web", "cart")])
    for bad in ("{}", "{ }\n"):
        (tmp_path / "e.json").write_text(bad)
        with pytest.raises(Exception, match="dependencies of no service"):
            read(spark, tmp_path / "e.json")


def test_neither(spark, tmp_path):
    for text in ("", "\n\n", "up 1\n", "[1, 2]"):
        (tmp_path / "n.txt").write_text(text)
        with pytest.raises(ValueError):
            runtime_calls.read(spark, str(tmp_path / "n.txt"))


def test_topic_ends_with_its_text(spark):
    rows = spark.createDataFrame([("orders",), ("orders\n",), ("orders\r\n",)], "t string")
    assert [r[0] for r in rows.select(is_topic_key(rows["t"])).collect()] == [True, False, False]
