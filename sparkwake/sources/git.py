"""Commits and changed files from git, read on the driver and handed on as tables."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MOST = 10_000
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"

from sparkwake.functions.scalars import REQUEST_FORMS


def run(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.strip()}")
    return done.stdout


def commits(spark: SparkSession, repo_id: str, root: str, most: int = MOST) -> DataFrame:
    """First-parent history, the newest first: repo_id, pos, commit, short, parents, date, subject."""
    rows = []
    for pos, record in enumerate(filter(None, run(root, "log", "--first-parent", f"-{most}", "--format=%H%x1f%h%x1f%P%x1f%cs%x1f%s%x1e").split("\x1e"))):
        if fields := record.strip("\n").split("\x1f"):
            if len(fields) == 5:
                rows.append((repo_id, pos, *fields[:2], len(fields[2].split()), *fields[3:]))
    return spark.createDataFrame(rows, "repo_id string, pos int, commit string, short string, parents int, date string, subject string")


def commit_files(root: str, commit: str) -> list[str]:
    """Files changed against the first parent; a root commit is compared with the empty tree."""
    parents = run(root, "rev-list", "--parents", "-n1", commit).split()[1:]
    return run(root, "diff", "--name-only", parents[0] if parents else EMPTY_TREE, commit, "--").splitlines()


def diff_files(root: str, expression: str) -> list[str]:
    """Files of a diff range. Options are refused."""
    tokens = expression.split()
    if not tokens or any(t.startswith("-") for t in tokens):
        raise ValueError("a diff range is one or two revisions, and no option")
    return run(root, "diff", "--name-only", *tokens, "--").splitlines()


def working_files(root: str) -> list[str] | None:
    """Files of the branch since it left the default branch, uncommitted and untracked; None if there are none."""
    found = set(run(root, "diff", "--name-only", "HEAD", "--").splitlines()) | set(run(root, "ls-files", "--others", "--exclude-standard").splitlines())
    for branch in ("origin/HEAD", "origin/main", "origin/master", "main", "master"):
        try:
            base = run(root, "merge-base", branch, "HEAD").strip()
        except RuntimeError:
            continue
        found |= set(run(root, "diff", "--name-only", base, "HEAD", "--").splitlines())
        break
    return sorted(found) or None


def repository_name(root: str) -> str:
    """owner/name of the origin, else the folder's name."""
    try:
        url = run(root, "remote", "get-url", "origin").strip()
    except RuntimeError:
        url = ""
    found = re.search(r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?$", url)
    return found[1] if found else Path(root).resolve().name


def pull_request_files(root: str, number: int) -> list[str]:
    """Files of a merged pull request's commit, else those of its ref since it left the current branch."""
    for line in run(root, "log", "--first-parent", f"-{MOST}", "--format=%H %s").splitlines():
        commit, _, subject = line.partition(" ")
        if any(re.search(form.format(rf"{number}(?!\d)"), subject) for form in REQUEST_FORMS):
            return commit_files(root, commit)
    for ref in (f"refs/pull/{number}/head", f"refs/remotes/origin/pr/{number}", f"refs/remotes/origin/pull/{number}/head", f"refs/heads/pr/{number}", f"refs/heads/pull/{number}", f"refs/merge-requests/{number}/head"):
        try:
            base = run(root, "merge-base", "HEAD", ref).strip()
        except RuntimeError:
            continue
        return run(root, "diff", "--name-only", base, ref, "--").splitlines()
    raise ValueError(f"no commit or ref of pull request {number}; fetch it first: git fetch origin pull/{number}/head:pr/{number}")


def changes(spark: SparkSession, repo_id: str, root: str, count: int = 20) -> DataFrame:
    """The last pull requests of the first-parent history, or the last commits if it names none: change_id, repo_id, pos,
    subject, date, file (null for a change without files)."""
    rows = [r.asDict() for r in commits(spark, repo_id, root).collect()]  # MOST rows at most
    requests = [r for r in rows if any(re.search(form.format(r"\d+"), r["subject"]) for form in REQUEST_FORMS)]
    chosen = (requests or rows)[:count]
    listed = [(r["commit"], repo_id, r["pos"], r["subject"], r["date"], f) for r in chosen for f in commit_files(root, r["commit"]) or [None]]
    return spark.createDataFrame(listed, "change_id string, repo_id string, pos int, subject string, date string, file string")
