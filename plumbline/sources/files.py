"""Files as rows: trees, their contents, byte ranges of giant files, and query sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and endings that a corpus does without.
EXCLUDED = r"(^|/)(bin|obj|\.git)/|\.(user|suo)$"


def tree(spark: SparkSession, root: str, repo_id: str, branch_name: str, commit_sha: str, glob: str | None = None, exclude: str | None = EXCLUDED) -> DataFrame:
    """All files below root: scope, file_path (relative), size_bytes, digest, content (null if binary)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    x = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^{base}/", "")
    x = x.withColumn("file_path", path)
    if exclude:
        x = x.where(~F.col("file_path").rlike(exclude))
    binary = F.decode("content", "ISO-8859-1").contains("\x00")  # of the whole file, a character a byte
    text = F.when(~F.coalesce(binary, F.lit(False)), F.decode("content", "UTF-8"))
    return x.select(F.lit(repo_id).alias("repo_id"), F.lit(branch_name).alias("branch_name"), F.lit(commit_sha).alias("commit_sha"), "file_path", F.col("length").alias("size_bytes"), F.sha1("content").alias("digest"), text.alias("content"))


def ranges(spark: SparkSession, paths: DataFrame, size: int = 64 << 20, halo: int = 1 << 10) -> DataFrame:
    """paths: path, length. Byte ranges of files, each read on its own with a halo: path, part, start, bytes.

    No task holds more of a file than one range and its halo.
    """
    parts = paths.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / size))).alias("part"))
    parts = parts.repartition(F.col("path"), F.col("part"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for r in b.itertuples(index=False):
                system, at = fs.FileSystem.from_uri(r.path) if "://" in r.path else (fs.LocalFileSystem(), r.path.removeprefix("file:"))
                with system.open_input_file(at) as f:
                    f.seek(r.part * size)
                    yield pd.DataFrame({"path": [r.path], "part": [r.part], "start": [r.part * size], "bytes": [f.read(size + halo)]})

    return parts.mapInPandas(read, "path string, part long, start long, bytes binary")


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of queries with expected symbols: name, top_k, query, expected_symbols; an error if it is malformed."""
    x = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("name string, topK int, queries array<struct<query:string,expectedSymbols:array<string>>>").json(path)
    return x.select("name", F.col("topK").alias("top_k"), F.explode("queries").alias("q")).select("name", "top_k", "q.query", F.col("q.expectedSymbols").alias("expected_symbols"))


def glob_patterns(folders: list[str], files: list[str], extensions: list[str]) -> list[str]:
    """Exclusion globs of folders, files and extensions, each once without regard to case."""
    every = [*(f"**/{x.strip('/')}/**" for x in folders if x.strip()), *(f"**/{x}" for x in files if x.strip()), *(f"**/*.{x.lstrip('.')}" for x in extensions if x.strip())]
    seen: dict[str, str] = {}
    for g in every:
        seen.setdefault(g.lower(), g)
    return list(seen.values())


def copy_corpus(source: str, target: str, exclude: str = EXCLUDED) -> int:
    """Copy a folder of the driver's without what a corpus does without; the number of files copied."""
    import os
    import re
    import shutil

    skip, n = re.compile(exclude), 0
    for folder, _, names in os.walk(source):
        for name in names:
            at = os.path.join(folder, name)
            path = os.path.relpath(at, source).replace(os.sep, "/")
            if not skip.search(path):
                to = os.path.join(target, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                shutil.copy2(at, to)
                n += 1
    return n
