"""Facts of source files: strings, variables of the environment, calls, imports, settings and assignments.

What stands on one line is read line by line, for all languages. What nests, calls and their arguments, annotations, base
types and look-ups of the environment, is read by `intervals` for the languages it knows, whatever the lines between; for
other files by line, a call going on to its closing bracket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwake.functions.messaging import METHODS
from sparkwake.operators import file_facts, intervals

SCHEMA = "repo_id string, service string, path string, ordinal int, line int, kind string, name string, value string, default string"
#: How files are read, by language.
PARSERS = ("intervals", "lines")
#: Ends of names and names of files that are not read.
SKIP_SUFFIXES = (
    ".min.js", ".min.css", ".map", ".lock", "-lock.json", "-lock.yaml", ".sum", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp", ".bmp", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pdf", ".zip", ".gz", ".tgz",
    ".tar", ".jar", ".war", ".class", ".dll", ".exe", ".so", ".dylib", ".wasm", ".pyc", ".csv", ".snap", ".md", ".markdown", ".txt", ".rst", ".log", ".mp3", ".mp4", ".mov", ".avi", ".pb", ".bin", ".dat", ".db", ".sqlite", ".ipynb",
)
SKIP_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "poetry.lock", "mix.lock", "license", "licence", "notice", "changelog",
)
#: Languages by extension; a file of any other extension is read too, as text.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp",
    "php": "php", "rb": "ruby", "rs": "rust", "scala": "scala", "yml": "yaml", "yaml": "yaml", "json": "json", "properties": "properties", "env": "env", "toml": "toml", "xml": "xml",
    "conf": "conf", "template": "conf", "tmpl": "conf", "cjs": "javascript", "mts": "typescript", "cts": "typescript", "ini": "properties", "cfg": "properties", "csproj": "xml", "mod": "go",
}
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|`((?:[^`\\]|\\.)*)`')
ENV = re.compile(r"""(?:process\.env\.([A-Za-z_]\w*)|process\.env\[\s*["'](\w+)["']\s*\]|(?:os\.environ(?:\.get)?|os\.getenv|os\.Getenv|System\.getenv|getenv|Environment\.GetEnvironmentVariable|ENV(?:\.fetch)?|env::var|Configuration)\s*[\[(]\s*["']([\w:]+)["'])""")
DEFAULT = re.compile(r"""^[\])]*\s*(?:\|\||\?\?|\?:|or|,)\s*["'`]([^"'`]*)["'`]""")
INNER = re.compile(r"\$\{([A-Za-z_]\w*)(?:(?::-|:|-)([^}]*))?\}")
CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*(?:<[^<>()]*>)?)\s*\(")
ASSIGN = re.compile(r"""(?:^|[\s({;,])([A-Za-z_$][\w$]*)\s*(?::\s*[\w<>\[\]]+\s*)?(?::=|=)(?!=)(?=[^=]*["'`])""")
IMPORT = re.compile(r"""^\s*(?:import\s+(?:[\w*{},\s]+\s+from\s+)?["']([^"']+)["']|import\s+(?:static\s+)?([\w.]+)|from\s+([\w.]+)\s+import|using\s+([\w.]+)\s*;|use\s+([\w\\]+)|(?:const|let|var).*require\(\s*["']([^"']+)["']\s*\)|(?:[\w.]+\s+)?"((?:[\w.-]+/)+[\w.-]+)"\s*$)""")
SETTING = re.compile(r"""^\s*-?\s*["']?([@A-Za-z_][\w.\-/@\[\]]*)["']?\s*[:=]\s*["']?([^"'#{\[]+?)["']?\s*,?\s*$""")
NAMES = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
COMMENT = re.compile(r"^\s*(?://|#(?!\[)|\*|/\*|--|<!--)")


BRACKETS = re.compile(r""""[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*+`|[()\[\]{}]""")
OPENS = {"(": ")", "[": "]", "{": "}"}


def closings(text: str) -> dict[int, int]:
    """Where each bracket that opens is closed; strings hold none. A bracket that none of its kind closes has no entry."""
    ends, open_ = {}, []
    for m in BRACKETS.finditer(text):
        if m[0] in OPENS:
            open_.append((OPENS[m[0]], m.start()))
        elif len(m[0]) == 1 and open_ and open_[-1][0] == m[0]:
            ends[open_.pop()[1]] = m.start()
    return ends


def is_read(path: Column) -> Column:
    """Whether facts are read from a file: all but the names and ends of names listed above."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ends = "|".join(map(re.escape, SKIP_SUFFIXES))
    return ~(name.isin(*SKIP_NAMES) | name.rlike(f"(?:{ends})$"))


def literals(text: str) -> list[str]:
    return [next(g for g in m.groups() if g is not None) for m in STRING.finditer(text)]


def calls(text: str, line: str, begins: int, ends: dict[int, int]) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """(kind, name, value, default) of the calls of a line, which begins there in the text; an unclosed one ends with the line."""
    for m in CALL.finditer(line):
        name, inside = m[1], text[begins + m.end() : ends.get(begins + m.end() - 1, begins + len(line))]
        method = re.sub(r"<.*", "", name).rsplit(".", 1)[-1].rsplit("::", 1)[-1].lower()
        for k, value in enumerate(literals(inside)):
            yield "call", name, value, str(k)
        if method in METHODS:
            yield from (("call_name", name, x, None) for x in NAMES.findall(re.sub(r"\w+\s*=(?!=)", "", STRING.sub("", inside))))
            if generic := re.search(r"<\s*(\w+)", name):
                yield "event_type", "consumer" if "subscri" in method else "producer", generic[1], None
        if re.search(r"(?:Client|Stub|Server|to_server)$", name.split("<")[0]):
            yield "stub", name, None, None
        if name.endswith("Event") and not name.endswith("DomainEvent") and line[: m.start()].rstrip().endswith("new"):
            yield "event_type", "producer", name, None


def facts(path: str, text: str) -> Iterator[tuple[int, str, str | None, str | None, str | None]]:
    """(line, kind, name, value, default)."""
    base, language = path.rpartition("/")[2], LANGUAGES.get(path.rpartition(".")[2].lower(), "text")
    if base == "pom.xml":
        own = re.sub(r"(?s)<parent>.*?</parent>", "", text)
        yield from ((0, "import", name, None, None) for name in re.findall(r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)", own))
        return
    if language == "xml":
        yield from ((0, "import", m[1], None, None) for m in re.finditer(r"""ProjectReference\s+Include="(?:[^"]*[\\/])?([^"\\/]+)\.(?:cs|fs)proj\"""", text))
    if path.endswith(".proto"):
        package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", text)
        for m in re.finditer(r"(?m)^\s*service\s+(\w+)\s*\{", text):
            yield text.count("\n", 0, m.start(1)) + 1, "proto", m[1], package[1] if package else None, None
        return
    nested = path.rpartition(".")[2].lower() in intervals.LANGUAGES
    lines, at, ends = text.split("\n"), 0, {} if nested else closings(text)
    for n, line in enumerate(lines, 1):
        begins, at = at, at + len(line) + 1
        if COMMENT.match(line):
            continue
        values = literals(line)
        for value in values:
            yield n, "template" if re.search(r"\$\{|#\{|\{\w*\}", value) else "string", None, value, None
        if language in ("yaml", "properties", "json", "env", "toml", "conf") or "://" in line:
            for m in re.finditer(r"[A-Za-z][A-Za-z0-9+.:-]*://[^\s\"'`<>;,)]+", STRING.sub("", line)):
                yield n, "string", None, m[0], None
        for m in () if nested else ENV.finditer(line):
            tail = DEFAULT.match(line[m.end() :])
            yield n, "env", next(g for g in m.groups() if g), None, tail[1] if tail else None
        for m in INNER.finditer(line):
            if m[1].isupper():
                yield n, "env", m[1], None, m[2]
        if not nested and "(" in line:
            yield from ((n, *c) for c in calls(text, line, begins, ends))
        if m := IMPORT.match(line):
            yield n, "import", next(g for g in m.groups() if g), None, None
        for m in () if nested else re.finditer(r"@([A-Z]\w+)\s*\(([^)]*)\)", line):
            yield from ((n, "annotation", m[1], value, None) for value in literals(m[2]))
            yield from ((n, "annotation_name", m[1], x, None) for x in NAMES.findall(re.sub(r"\w+\s*=(?!=)", "", STRING.sub("", m[2]))))
        if values and (m := ASSIGN.search(line)):
            yield n, "assign", m[1], values[-1], None
        if language == "toml" and (m := re.match(r"\s*([\w-]+)\s*=\s*\{[^}]*path\s*=", line)):
            yield n, "import", m[1], None, None
        if language in ("yaml", "properties", "json", "env", "toml") and (m := SETTING.match(line)):
            yield n, "setting", m[1], m[2].strip(), None


def extract(files: DataFrame) -> DataFrame:
    """files (repo_id, service, path, text) -> facts; ordinals follow the lines, and within one the text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r.repo_id, r.service, r.path, k, *f) for r in part.itertuples() for k, f in enumerate(facts(r.path, r.text))]
            yield pd.DataFrame(rows, columns=["repo_id", "service", "path", "ordinal", "line", "kind", "name", "value", "default"])

    read = files.where(is_read(F.col("path"))).select("repo_id", "service", "path", "text")
    both = read.mapInPandas(run, SCHEMA).unionByName(file_facts.facts(read, tuple(METHODS)))
    return both.withColumn("ordinal", (F.least("line", F.lit(2_000_000)) * 1000 + F.pmod("ordinal", F.lit(1000))).cast("int"))


def mapping_stats(files: DataFrame, owned: DataFrame) -> DataFrame:
    """files (repo_id, path, ext, size), owned (repo_id, path) -> files read, outside services, skipped by extension."""
    rows = files.join(owned.select("repo_id", "path", F.lit(True).alias("own")), ["repo_id", "path"], "left")
    inside = F.col("own").isNotNull()
    label = F.when(F.col("size") > 1 << 20, "large").when(~is_read(F.col("path")), F.col("ext"))
    counts = rows.where(inside).groupBy("repo_id", label.alias("label")).agg(F.count("*").alias("n"))
    skipped = counts.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n"))))).alias("files_skipped"), F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("files_scanned"))
    outside = rows.groupBy("repo_id").agg(F.count_if(~inside).alias("files_outside_services"))
    return outside.join(skipped, "repo_id", "left")
