"""Facts a file at once are those of windows over tokens."""

from __future__ import annotations

import random
import re
from collections import Counter

from sparkwake.functions.messaging import METHODS
from sparkwake.operators import file_facts, intervals, matchers
from sparkwake.plans.nested_queries import SOURCES

MORE = ["(", ")", "{", "}", "[", "]", ",", "=>", "new ", "process.env.X", "os.getenv(", '"a\\"b"', "`t ${y}`", "@Note(", "class ", "extends ", "List.of(", "publish(", "subscribe<Paid>(", "||", " or ", "+", "é", "// c\n", "# c\n", "/* x */", '"""d"""', "PaidEvent("]


def test_scrambled_sources(spark):
    """Unbalanced brackets, open strings and misplaced words included."""
    rng, texts = random.Random(7), [t for t, _ in SOURCES.values()]
    words = [w for t in texts for w in re.findall(r"\w+(?:\.\w+)*|\s+|[^\w\s]|\"[^\"\n]*\"|'[^'\n]*'", t)] + MORE
    rows = []
    for n in range(400):
        text = list(rng.choice(texts))
        for _ in range(rng.randint(1, 12)):
            text[rng.randrange(len(text))] = rng.choice(["", "\n", " new ", *MORE])
        rows += [("r", "s", f"a{n}.{rng.choice(list(intervals.LANGUAGES))}", "".join(text)), ("r", "s", f"b{n}.{rng.choice(list(intervals.LANGUAGES))}", "".join(rng.choice(words) for _ in range(60)))]
    files = spark.createDataFrame(rows, "repo_id string, service string, path string, text string")
    columns = ("repo_id", "service", "path", "ordinal", "line", "kind", "name", "value", "default")
    want, got = (Counter(tuple(r) for r in f(files, tuple(METHODS)).select(*columns).collect()) for f in (intervals.facts, file_facts.facts))
    assert got == want and len({r[5] for r in want}) == 10


def test_texts_alone_are_dealt_out(spark):
    files = spark.createDataFrame([("r", "s", "a.js", "f('x')")], "repo_id string, service string, path string, text string")
    plan = file_facts.facts(files, tuple(METHODS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Sort" not in plan


def test_mentions_read_files_once(spark):
    """What reads the facts several times reads stored ones, whose plan has no pass over files."""
    files = spark.createDataFrame([("r", "s", "a.js", "publish('orders.paid', TOPIC)")], "repo_id string, service string, path string, text string")
    found = matchers.mentions(file_facts.facts(files, tuple(METHODS)))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["topic_key"], r["role"]) for r in found.collect()] == [("orders.paid", "producer")]
