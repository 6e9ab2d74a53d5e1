"""Commits, branches, trees and blobs of a git repository that all workers can reach, as rows.

Listings are read by one git call each; contents are read where the rows are, many blobs per call.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "sha string, author_name string, author_email string, commit_message string, committed_at timestamp"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, encoding="utf-8", errors="replace").stdout


def commits(spark: SparkSession, repo: str, branch: str = "HEAD") -> DataFrame:
    """sha, author, message and time (UTC) of each commit a branch holds."""
    out = []
    for record in _git(repo, "log", "-z", "--format=%H%x1f%an%x1f%ae%x1f%ct%x1f%B", branch, "--").split("\0"):
        if record:
            sha, name, mail, at, message = record.split("\x1f", 4)
            out.append((sha, name, mail, message.strip(), datetime.fromtimestamp(int(at), timezone.utc)))
    return spark.createDataFrame(out, COMMITS)


def branches(spark: SparkSession, repo: str, remote: str | None = None) -> DataFrame:
    """name and head_commit_sha of the branches, of a remote without its prefix."""
    prefix = f"refs/remotes/{remote}/" if remote else "refs/heads/"
    rows = [x.split(" ", 1) for x in _git(repo, "for-each-ref", "--format=%(objectname) %(refname)", prefix).splitlines()]
    named = [(ref.removeprefix(prefix), sha) for sha, ref in rows if not ref.endswith("/HEAD")]
    return spark.createDataFrame(named, "name string, head_commit_sha string")


def branch_exists(repo: str, name: str, remote: str | None = None) -> bool:
    ref = f"refs/remotes/{remote}/{name}" if remote else f"refs/heads/{name}"
    return subprocess.run(["git", "-C", repo, "show-ref", "--verify", "--quiet", ref], check=False).returncode == 0


def tree(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """file_path, digest (the blob's id) and size_bytes of each file of a commit; none for a commit that is not there."""
    try:
        listed = _git(repo, "ls-tree", "-r", "-z", "-l", commit)
    except subprocess.CalledProcessError:
        listed = ""
    out = []
    for record in listed.split("\0"):
        meta, _, path = record.partition("\t")
        parts = meta.split()
        if len(parts) == 4 and parts[1] == "blob":
            out.append((path, parts[2], int(parts[3])))
    return spark.createDataFrame(out, "file_path string, digest string, size_bytes long")


def with_contents(files: DataFrame, repo: str) -> DataFrame:
    """files with the column digest; adds content, null for a blob that is missing or holds a NUL."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="".join(f"{d}\n" for d in b["digest"]).encode(), check=True, capture_output=True).stdout
            at, texts = 0, []
            for _ in range(len(b)):
                end = out.index(b"\n", at)
                head = out[at:end].split()
                at = end + 1
                if len(head) < 3:
                    texts.append(None)
                    continue
                raw = out[at : at + int(head[2])]
                at += int(head[2]) + 1
                texts.append(None if b"\0" in raw else raw.decode("utf-8", "replace"))
            yield b.assign(content=texts)

    return files.mapInPandas(read, f"{kinds}, content string")


def changes(spark: SparkSession, repo: str, was: str | None, now: str) -> DataFrame:
    """file_path, change and old_file_path between two commits; everything is added if there was none."""
    from ..operators.indexing import tree_diff

    new = tree(spark, repo, now).select("file_path", "digest")
    old = tree(spark, repo, was).select("file_path", "digest") if was else new.limit(0)
    return tree_diff(old, new).select("file_path", F.col("change"), "old_file_path")
