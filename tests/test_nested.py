"""Facts that nest, on odd texts; the four languages' golden lists are queries."""

from __future__ import annotations

import pytest

from sparkwake.functions.messaging import METHODS
from sparkwake.operators import extract, intervals

ODD = {
    "escapes.js": r"""log("a \"quoted) b", 'it\'s', `x\`(`, "back\\");""" + "\nnext('one');",
    "open.js": "send('never closed', [1, {\nbus.publish('still.read')\n",
    "close.py": ")))]}\nf('after')\n",
    "empty.ts": "",
    "null.go": None,
    "notes.txt": "call('not read here')",
    "Handler.cs": 'public class PaidHandler : IConsumer<OrderPaid>\n{\n  public PaidHandler(IBus bus)\n  {\n    bus.PublishAsync(\n      new OrderSentIntegrationEvent(1));\n    var h = Configuration["EventBus:Host"];\n  }\n}\n',
    "a.php": "<?php\n$bus->publish('orders.php',\n  $payload);\n$h = $_ENV['DB_HOST'] ?? 'mysql';\n",
    "deep.js": "a(" * 60 + "'bottom'" + ")" * 60,
    "many.py": "\n".join(f"publish('topic.{n}', value)" for n in range(3000)),
    "lines.ts": "await channel.publish(" + "\n" * 40 + "  'far.away'\n);\n",
    "strings.java": 'String s = """\n  text("block")\n  """;\nlog.info("a // b", x); // call("c")\n',
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("r", "s", p, t, p) for p, t in ODD.items()], "repo_id string, service string, path string, text string, kind string")
    out: dict[str, set] = {p: set() for p in ODD}
    for r in intervals.facts(files, tuple(METHODS)).collect():
        out[r["path"]].add((r["line"], r["kind"], r["name"], r["value"]))
    return out


def test_strings_and_escapes(found):
    assert found["escapes.js"] == {(1, "call", "log", 'a \\"quoted) b'), (1, "call", "log", "it\\'s"), (1, "call", "log", "x\\`("), (1, "call", "log", "back\\\\"), (2, "call", "next", "one")}
    assert {f for f in found["strings.java"] if f[1] == "call"} == {(4, "call", "log.info", "a // b")}


def test_unbalanced(found):
    assert (1, "call", "send", "never closed") in found["open.js"] and (2, "call", "bus.publish", "still.read") in found["open.js"]
    assert found["close.py"] == {(2, "call", "f", "after")}


def test_nothing_to_read(found):
    assert not found["empty.ts"] and not found["null.go"] and not found["notes.txt"]


def test_other_languages(found):
    assert {(1, "extends", "IConsumer", "OrderPaid"), (6, "event_type", "producer", "OrderSentIntegrationEvent"), (7, "env", "EventBus:Host", None)} <= found["Handler.cs"]
    assert not any(name == "PaidHandler" for _, kind, name, _ in found["Handler.cs"] if kind == "call")
    assert {(4, "env", "DB_HOST", None)} <= found["a.php"] and any(f[1:2] == ("call",) and f[3] == "orders.php" for f in found["a.php"])


def test_far_and_many(found):
    assert (41, "call", "channel.publish", "far.away") in found["lines.ts"]
    assert (1, "call", "a", "bottom") in found["deep.js"]
    assert len({f for f in found["many.py"] if f[1] == "call"}) == 3000 and (2999, "call", "publish", "topic.2998") in found["many.py"]


def test_tokens_are_dealt_once(spark):
    """Texts are the only thing that is shuffled."""
    files = spark.createDataFrame([("r", "s", "a.js", "f('x')")], "repo_id string, service string, path string, text string")
    plan = intervals.facts(files, tuple(METHODS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan


def test_calls_of_other_files_end_at_their_bracket():
    text = "publish(\n" + "\n" * 20 + '  "orders",\n  (1),\n  KEY)\nother("x"\n'
    facts = [(line, kind, name, value) for line, kind, name, value, _ in extract.facts("a.rb", text)]
    assert (1, "call", "publish", "orders") in facts and (1, "call_name", "publish", "KEY") in facts and (25, "call", "other", "x") in facts
    assert len(list(extract.facts("b.rb", "f(" * 20_000))) == 0
