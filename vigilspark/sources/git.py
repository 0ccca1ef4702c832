"""Working copies, read on the driver by the git command; only names of files come back."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

#: The tree without files.
_NOTHING = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def head(repo: str) -> str:
    return _git(repo, "rev-parse", "HEAD").strip()


def origin(repo: str) -> str | None:
    try:
        return _git(repo, "remote", "get-url", "origin").strip()
    except subprocess.CalledProcessError:
        return None


def changed_paths(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    """path of each file that differs between HEAD and since, else its first parent, else nothing."""
    if since is None:
        parents = _git(repo, "rev-list", "--parents", "-n", "1", "HEAD").split()[1:]
        since = parents[0] if parents else _NOTHING
    paths = [p for p in _git(repo, "diff", "--name-only", "-z", since, "HEAD").split("\0") if p]
    return spark.createDataFrame([(p,) for p in paths], "path string")


def clone(url: str, into: str) -> str:
    """The last commit alone, into a new folder."""
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", url, into], check=True, capture_output=True)
    return into
