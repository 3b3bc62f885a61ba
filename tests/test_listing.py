"""Listing of folders and rules of .gitignore files, against git itself."""

from __future__ import annotations

import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkwake.functions.scalars import glob_pattern
from sparkwake.sources import files, ignore

NAMES = ("a", "b", "log", "x.log", "keep.log", "doc", "foo1", "foo!", "sp ace", "deep")
LINES = ("*.log", "!keep.log", "/a", "a/", "doc/*", "!doc/a", "**/deep/x.log", "a/**/b", "foo[0-9]", "foo[!0-9]", "b/**", "# no", "", "log", "!log/", "sp\\ ace", "x.lo?", "/b/a", "a/*.log", "\\!b", "trail  ", "!/a/b", "deep/")


def tree(rng, root, depth=0):
    for name in rng.sample(NAMES, 5):
        if depth < 3 and rng.random() < 0.5:
            (root / name).mkdir()
            tree(rng, root / name, depth + 1)
        else:
            (root / name).write_text("x")
    if rng.random() < (1 if not depth else 0.4):
        (root / ".gitignore").write_text("\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 7))) + "\n")


@pytest.mark.skipif(not shutil.which("git"), reason="no git to compare with")
def test_as_git(spark, tmp_path):
    rng, roots, want = random.Random(3), {}, set()
    for n in range(12):
        root = tmp_path / f"r{n}"
        root.mkdir()
        tree(rng, root)
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        listed = subprocess.run(["git", "-C", str(root), "ls-files", "-z", "--others", "--exclude-per-directory=.gitignore"], check=True, capture_output=True, text=True).stdout
        want |= {(f"r{n}", p) for p in listed.split("\0") if p and not p.endswith(".gitignore")}
        roots[f"r{n}"] = str(root)
    assert {(r["repo_id"], r["path"]) for r in files.listing(spark, roots).collect()} == want and len(want) > 150


def test_entries_left_out(spark, tmp_path):
    for p in ("src/main.js", "src/.hidden", ".env", "sub/.env.example", "node_modules/x/a.js", "tests/t.py", "src/bin", "tests.py", "a.b/c", ".github/w.yml", "no/ext"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("12345")
    os.symlink(tmp_path / "src", tmp_path / "link")
    (tmp_path / ".gitignore").write_text(".env\n*.pyc\n")
    got = {r["path"]: (r["ext"], r["size"]) for r in files.listing(spark, {"r": str(tmp_path), "none": str(tmp_path / "missing")}).collect()}
    assert got == {"src/main.js": ("js", 5), ".env": ("env", 5), "sub/.env.example": ("example", 5), "tests.py": ("py", 5), "a.b/c": ("b/c", 5), "no/ext": ("(none)", 5)}
    assert "tests/t.py" in {r["path"] for r in files.listing(spark, {"r": str(tmp_path)}, include_tests=True).collect()}
    assert files.listing(spark, {}).count() == 0


def test_rules():
    rules = ignore.Rules("*.log\n!keep.log\n/top\nonly/\na/b\n")
    said = {(p, d): rules.verdict(p, d) for p, d in (("x.log", False), ("d/keep.log", False), ("top", False), ("d/top", False), ("only", False), ("d/only", True), ("a/b", False), ("d/a/b", False))}
    assert said == {("x.log", False): True, ("d/keep.log", False): False, ("top", False): True, ("d/top", False): None, ("only", False): None, ("d/only", True): True, ("a/b", False): True, ("d/a/b", False): None}


def plain(glob, path):
    """Name by name."""
    def fit(g, p):
        if not g:
            return not p
        if g[0] == "**":
            return any(fit(g[1:], p[n:]) for n in range(len(p) + 1)) if len(g) > 1 else True
        return bool(p) and name(g[0], p[0]) and fit(g[1:], p[1:])

    def name(g, p):
        if not g:
            return not p
        if g[0] == "*":
            return any(name(g[1:], p[n:]) for n in range(len(p) + 1))
        if g[0] == "{":
            end = g.index("}")
            return any(p.startswith(x) and name(g[end + 1 :], p[len(x) :]) for x in g[1:end].split(","))
        return bool(p) and (g[0] in ("?", p[0])) and name(g[1:], p[1:])

    return fit(glob.split("/"), path.split("/"))


def test_globs(spark):
    rng = random.Random(8)
    paths = sorted({"/".join(rng.choice(("a", "b", "ab", "x.js", "x.ts", "a.yml")) for _ in range(rng.randrange(1, 5))) for _ in range(300)})
    include, exclude = ("**/*.{js,ts}", "a/*", "b/**/a*", "?b/x.js"), ("a/**/x.js", "**/ab/*.ts")
    assert all(bool(__import__("re").match(glob_pattern(g), p)) == plain(g, p) for g in include + exclude for p in paths)
    rows = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    want = {p for p in paths if any(plain(g, p) for g in include) and not any(plain(g, p) for g in exclude)}
    assert {r["path"] for r in files.matching(rows, include, exclude).collect()} == want and 20 < len(want) < len(paths)
    held = {"/".join(p.split("/")[:n]) for p in paths for n in range(1, p.count("/") + 1)}
    assert {r["folder"] for r in files.folders(rows).collect()} == held
    assert {r["folder"] for r in files.folders(rows, 2).where(F.col("repo_id") == "r").collect()} == {d for d in held if d.count("/") < 2}
