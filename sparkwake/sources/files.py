"""Files of source trees as a table: repo_id, path, ext, text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.functions.scalars import glob_pattern
from sparkwake.session import stored
from sparkwake.sources.ignore import is_ignored

#: Directories that are not read, and those of tests, read only if asked for.
IGNORED = ("node_modules", ".git", "vendor", "dist", "build", "target", ".next", "__pycache__", ".venv", "venv", "bin", "obj")
TESTS = ("test", "tests", "__tests__", "e2e", "fixtures", "__fixtures__", "testdata", "examples")
LARGEST = 1 << 20


def extension(path: str) -> str:
    """What follows the last dot of the whole path."""
    return path.rpartition(".")[2].lower() if "." in path else "(none)"


FOUND = "repo_id string, root_dir string, path string, size long, is_folder boolean, rules string"


def _inside(root: str, folder: str, rules: list, include_tests: bool) -> list[tuple[str, int, bool, str]]:
    """(path, size, is_folder, rules for what it holds) of a folder's entries. Hidden ones but .env files, IGNORED names, links and
    what .gitignore files say are left out, folders of tests unless asked for."""
    own = Path(root, folder, ".gitignore")
    try:
        if own.is_file() and not own.is_symlink():
            rules = [*rules, (folder, own.read_text(errors="replace"))]
        entries = sorted(os.scandir(Path(root, folder)), key=lambda e: e.name)
    except OSError:
        return []
    found, told = [], json.dumps(rules)
    for e in entries:
        path, is_folder = f"{folder}/{e.name}" if folder else e.name, e.is_dir(follow_symlinks=False)
        if e.is_symlink() or not (is_folder or e.is_file(follow_symlinks=False)):
            continue
        if not is_folder and e.name in (".env", ".env.example"):
            found.append((path, e.stat().st_size, False, ""))
        elif not (e.name.startswith(".") or e.name in IGNORED or (is_folder and not include_tests and e.name in TESTS) or is_ignored(path, is_folder, rules)):
            found.append((path, 0 if is_folder else e.stat().st_size, is_folder, told if is_folder else ""))
    return found


def listing(spark: SparkSession, roots: dict[str, str], include_tests: bool = False) -> DataFrame:
    """roots: folder of each repository -> repo_id, root_dir, path, ext, size.

    Folders are listed by the executors, a level of all repositories at once: what a level finds is stored, its folders are the
    next level. A folder carries the .gitignore texts above it. Nothing but the roots passes through the driver."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r.repo_id, r.root_dir, *f) for r in part.itertuples() for f in _inside(r.root_dir, r.path, json.loads(r.rules), include_tests)]
            yield pd.DataFrame(rows, columns=["repo_id", "root_dir", "path", "size", "is_folder", "rules"])

    level = spark.createDataFrame([(repo, root, "", 0, True, "[]") for repo, root in roots.items()], FOUND)
    every = None
    while True:
        found = stored(level.repartition("repo_id", "path").mapInPandas(run, FOUND), "listed")
        files = found.where(~F.col("is_folder"))
        every = files if every is None else every.unionByName(files)
        level = found.where("is_folder")
        if level.isEmpty():
            break
    ext = F.when(F.contains("path", F.lit(".")), F.lower(F.substring_index("path", ".", -1))).otherwise("(none)")
    return every.select("repo_id", "root_dir", "path", ext.alias("ext"), "size")


def matching(files: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> DataFrame:
    """The files whose path fits a glob of include and none of exclude; a set of globs is one expression."""
    one = lambda globs: "|".join(f"(?:{glob_pattern(g)})" for g in globs)
    wanted = files.where(F.col("path").rlike(one(include)))
    return wanted.where(~F.col("path").rlike(one(exclude))) if exclude else wanted


def folders(files: DataFrame, depth: int | None = None) -> DataFrame:
    """repo_id, folder: the folders that hold files, at any depth, those of up to `depth` names alone if asked."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = files.where(F.size(parts) > 1).select("repo_id", F.explode(above).alias("folder")).distinct()
    return rows if depth is None else rows.where(F.size(F.split("folder", "/")) <= depth)


def with_text(files: DataFrame) -> DataFrame:
    """The files up to LARGEST bytes with their text, read where the task runs; undecodable bytes are replaced."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = []
            for root, path in zip(part["root_dir"], part["path"], strict=True):
                try:
                    texts.append(Path(root, path).read_bytes().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield part.assign(text=texts)

    small = files.where(F.col("size") <= LARGEST)
    return small.mapInPandas(read, "repo_id string, root_dir string, path string, ext string, size long, text string").where(F.col("text").isNotNull())


def dotenv(text: str) -> list[tuple[str, str, int]]:
    """(name, value, line) of lines NAME=value; an export, quotes and a # after a space go."""
    found = []
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(.*?)\s*$", line):
            value = m[2]
            if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
                value = value[1:-1]
            else:
                value = re.split(r"\s#", value)[0].rstrip()
            found.append((m[1], value, n))
    return found


def interpolate(text: str, env: dict[str, str]) -> str:
    """${V}, ${V:-d}, ${V-d} and $V by env; an empty value is none, what stays unknown stays as written."""

    def put(m: re.Match) -> str:
        name, default = m[1] or m[3], m[2]
        return env.get(name) or (default if default is not None else m[0])

    return re.sub(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)(?::?-([^}]*))?\}|([A-Za-z_][A-Za-z0-9_]*))", put, text)


def compose_env(example: str, own: str) -> dict[str, str]:
    """Values of .env.example, then of .env; each may use those before it."""
    env: dict[str, str] = {}
    for name, value, _ in dotenv(example) + dotenv(own):
        env[name] = interpolate(value, env)
    return env
