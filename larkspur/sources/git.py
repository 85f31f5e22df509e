"""Commits of a repository. Runs git on the driver; everything above these functions takes plain rows."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

Git = Callable[[str, list[str]], str]
COMMIT_DDL = "sha string, date string, epoch_ms bigint"


def run_git(path: str, args: list[str]) -> str:
    """git's output; empty if it fails."""
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else ""


def parse_log(text: str) -> Iterator[tuple[str, str, int]]:
    """(sha, date, epoch ms) of lines ``sha date``; others are passed over."""
    for line in (text or "").split("\n"):
        sha, _, date = line.strip().partition(" ")
        try:
            at = datetime.fromisoformat(date.strip())
        except ValueError:
            continue
        yield sha, date.strip(), int(at.timestamp() * 1000)


def commits_between(path: str, since: datetime, until: datetime, git: Git = run_git) -> list[tuple[str, str, int]]:
    """Newest first, both ends included (git's own start is not)."""
    after = since - timedelta(seconds=1)
    return list(parse_log(git(path, ["log", f"--after={after.isoformat()}", f"--before={until.isoformat()}", "--format=%H %cI"])))


def commit_up_to(path: str, at: datetime, git: Git = run_git) -> tuple[str, str, int] | None:
    before = at + timedelta(seconds=1)
    return next(parse_log(git(path, ["log", f"--before={before.isoformat()}", "-n", "1", "--format=%H %cI"])), None)


def commit_frame(spark: SparkSession, commits: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(commits, COMMIT_DDL)


def describe(path: str, git: Git = run_git) -> dict[str, str | None]:
    """Remote, branch, commit and its time; null where git has none."""
    ask = {
        "repoUrl": ["remote", "get-url", "origin"],
        "branch": ["rev-parse", "--abbrev-ref", "HEAD"],
        "commitSha": ["rev-parse", "HEAD"],
        "codeAt": ["log", "-1", "--format=%cI"],
        "subpath": ["rev-parse", "--show-prefix"],
    }
    return {k: git(path, args).strip().rstrip("/") or None for k, args in ask.items()}


@contextmanager
def worktree(path: str, sha: str, git: Git = run_git) -> Iterator[str]:
    """A folder with the files of a commit, gone afterwards. Of a project in a sub-folder, that sub-folder."""
    prefix = (describe(path, git)["subpath"] or "").strip("/")
    with tempfile.TemporaryDirectory(prefix="larkspur-tree-") as folder:
        git(path, ["worktree", "add", "--detach", f"{folder}/tree", sha])
        try:
            yield f"{folder}/tree/{prefix}".rstrip("/")
        finally:
            git(path, ["worktree", "remove", "--force", f"{folder}/tree"])
