"""The driver's contract, with and without the text operators; git readers and the configuration."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from sparkwake import session
from sparkwake.sources import config, git

from .conftest import ROOT


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_without_text_operators(tmp_path):
    shutil.copytree(ROOT / "sparkwake", tmp_path / "sparkwake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'JN_21_walk' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["change_id", "repo_id", "service", "depth", "confidence"]


def test_git(spark, tmp_path):
    def do(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *args], check=True, capture_output=True)

    do("init", "-b", "main")
    for name, subject in (("a", "first"), ("b", "feat (#8)"), ("c", "docs")):
        (tmp_path / name).write_text(name)
        do("add", ".")
        do("commit", "-m", subject)
    root = str(tmp_path)
    rows = git.commits(spark, "r", root).orderBy("pos").collect()
    assert [r["subject"] for r in rows] == ["docs", "feat (#8)", "first"] and git.commit_files(root, rows[2]["commit"]) == ["a"]
    assert git.diff_files(root, "HEAD~2 HEAD") == ["b", "c"] and git.pull_request_files(root, 8) == ["b"]
    assert [(r["subject"], r["file"]) for r in git.changes(spark, "r", root).collect()] == [("feat (#8)", "b")]
    (tmp_path / "d").write_text("d")
    assert git.working_files(root) == ["d"] and git.repository_name(root) == tmp_path.name
    for bad in ("--output=x", ""):
        with pytest.raises(ValueError):
            git.diff_files(root, bad)
    with pytest.raises(ValueError):
        git.pull_request_files(root, 99)


def test_config(tmp_path):
    assert config.load(str(tmp_path)) == config.Config()
    (tmp_path / config.FILE).write_text('{"runtime": {"map": {"pay": "payment"}, "ignore": ["load"]}, "other": 1}')
    assert config.load(str(tmp_path)) == config.Config({"pay": "payment"}, ("load",))
    (tmp_path / config.FILE).write_text("{")
    with pytest.raises(ValueError, match=config.FILE):
        config.load(str(tmp_path))
