"""Statistics of repositories, branches, languages, kinds, edges, symbols, commits and indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop_path

STATES = ("Pending", "InProgress", "Completed", "Failed", "Stale")


def _per(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def file_sums(files: DataFrame, keys: list[str]) -> DataFrame:
    return _per(files, keys, file_count=F.countDistinct("id"), total_size_bytes=F.sum("size_bytes"), total_lines=F.sum(F.col("line_count").cast("long")), last_indexed_at=F.max("indexed_at"), rows=F.count(F.lit(1)))


def repo_stats(repos: DataFrame, files: DataFrame, symbols: DataFrame, chunks: DataFrame, vectors: DataFrame, faithful: bool = False) -> DataFrame:
    """Per repository; each input is summed before it is joined. faithful multiplies sums by the rows the joins would have made."""
    n = lambda df, name: _per(df, ["repo_id"], **{name: F.countDistinct("id"), f"{name}_rows": F.count(F.lit(1))})
    x = repos.select(F.col("id").alias("repo_id"), "name").join(file_sums(files, ["repo_id"]), "repo_id", "left")
    for df, name in ((symbols, "symbol_count"), (chunks, "chunk_count"), (vectors, "embedding_count")):
        x = x.join(n(df, name), "repo_id", "left")
    x = x.join(_per(files, ["repo_id"], branch_count=F.countDistinct("branch_name")), "repo_id", "left")
    times = F.lit(1)
    if faithful:
        times = F.greatest(F.coalesce("branch_count", F.lit(1)), F.lit(1))
        for name in ("symbol_count", "chunk_count", "embedding_count"):
            times = times * F.greatest(F.coalesce(f"{name}_rows", F.lit(1)), F.lit(1))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("branch_count", "file_count", "symbol_count", "chunk_count", "embedding_count")]
    return x.select("repo_id", "name", *counts, (F.col("total_size_bytes").cast("decimal(38,0)") * times).cast("double").alias("total_size_bytes"), (F.col("total_lines").cast("decimal(38,0)") * times).cast("double").alias("total_lines"), "last_indexed_at")


def branches_of(files: DataFrame) -> DataFrame:
    """Branches as the files show them: their newest commit."""
    return files.groupBy("repo_id", "branch_name").agg(F.max(F.struct("indexed_at", "commit_sha")).alias("h")).select("repo_id", "branch_name", F.col("h.commit_sha").alias("head_commit_sha"), F.col("h.indexed_at").alias("last_indexed_at"))


def branch_stats(files: DataFrame, symbols: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """Per branch of the files; with chunks and vectors their counts, with states (jobs.branch_states) state and indexed commit."""
    keys = ["repo_id", "branch_name"]
    x = branches_of(files).join(file_sums(files, keys).drop("last_indexed_at", "rows"), keys, "left")
    for df, name in ((symbols, "symbol_count"), (chunks, "chunk_count"), (vectors, "embedding_count")):
        if df is not None:
            x = x.join(_per(df, keys, **{name: F.countDistinct("id")}), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return x.join(states.select(*keys, "index_state", "indexed_commit_sha"), keys, "left") if states is not None else x


def language_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per repository and language of its files: files, their sums, and the symbols in them."""
    per = file_sums(files, ["repo_id", "language"]).drop("rows", "last_indexed_at")
    paths = files.where("language is not null").select("repo_id", "file_path", F.col("language").alias("file_language")).distinct()
    inside = symbols.select("repo_id", "file_path", "id").distinct().join(paths, ["repo_id", "file_path"])
    n = inside.groupBy("repo_id", F.col("file_language").alias("language")).agg(F.countDistinct("id").alias("symbol_count"))
    return per.join(n, ["repo_id", "language"], "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))


def symbol_kind_stats(symbols: DataFrame) -> DataFrame:
    return _per(symbols, ["repo_id", "kind"], symbol_count=F.countDistinct("id"), file_count=F.countDistinct("file_path"))


def edge_kind_stats(edges: DataFrame) -> DataFrame:
    return _per(edges, ["repo_id", "kind"], edge_count=F.count(F.lit(1)))


def hot_symbols(edges: DataFrame) -> DataFrame:
    """Per target: edges, and distinct sources that call and that refer to it; only targets that have any."""
    return _per(
        edges, ["target_id"], reference_count=F.count(F.lit(1)), call_count=F.countDistinct(F.when(F.col("kind") == "Calls", F.col("source_id"))), ref_count=F.countDistinct(F.when(F.col("kind") == "References", F.col("source_id")))
    ).where("reference_count > 0")


def hot_symbols_named(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """hot_symbols with the symbols' own columns, the most referenced first."""
    x = hot_symbols(edges).join(symbols.select(F.col("id").alias("target_id"), "name", "file_path"), "target_id")
    return x.orderBy(F.desc("reference_count"), "target_id")


def recent_activity(symbols: DataFrame) -> DataFrame:
    return _per(symbols, ["repo_id", "branch_name", "commit_sha"], files_changed=F.countDistinct("file_path"), symbols_changed=F.countDistinct("id"), committed_at=F.max("indexed_at")).orderBy(F.desc("committed_at"), "commit_sha")


def indexing_progress(rows: DataFrame, group: str, item: str, state: str, states: dict[str, str]) -> DataFrame:
    """Per group: items, items in each state, and the share completed in per cent."""
    n = {"total": F.countDistinct(item)} | {name: F.countDistinct(F.when(F.col(state) == v, F.col(item))) for name, v in states.items()}
    x = _per(rows, [group], **n)
    return x.withColumn("completed_percent", F.round(100.0 * F.col("completed") / F.nullif("total", F.lit(0)), 2))


def distinct_models(vectors: DataFrame) -> DataFrame:
    return vectors.where("model is not null").select(F.lower("model").alias("model")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """out_degree and in_degree of each symbol that has an edge."""
    out = edges.groupBy(F.col("source_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("target_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(into, "symbol_id", "full_outer").select("symbol_id", zero("out_degree"), zero("in_degree"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value at rank ceil(p n) of each group, from counts of equal values."""
    from pyspark.sql import Window

    same = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value))
    every = F.sum("n").over(Window.partitionBy(*keys))
    rank = F.greatest(F.ceil(F.lit(p) * F.col("every")), F.lit(1))
    return same.withColumns({"upto": upto, "every": every}).where(F.col("upto") >= rank).groupBy(*keys).agg(F.min(value).alias("value"))


def top_k_hit_rate(results: DataFrame, expected: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """Share of the queries with an expected item among their first k."""
    hit = results.where(F.col(rank) <= k).join(expected, [query, item], "left_semi").select(query).distinct().withColumn("hit", F.lit(1))
    return expected.select(query).distinct().join(hit, query, "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("hit_rate"), F.count(F.lit(1)).alias("queries"))


def percent(share: float, digits: int = 1) -> str:
    """A share as a report shows it."""
    return f"{100 * share:.{digits}f} %"


def refresh(spark: SparkSession, into: str, views: dict[str, Callable[[], DataFrame]], only: str | None = None) -> list[str]:
    """Write the statistics named (all of them, or one) anew as snapshots under a folder; readers see the old one until the new is complete."""
    if only is not None and only not in views:
        raise KeyError(f"no statistics called {only}")
    done = [only] if only is not None else sorted(views)
    for name in done:
        have = versions(spark, f"{into}/{name}")
        views[name]().write.parquet(f"{into}/{name}/__v={(have[-1] if have else 0) + 1}")
        for v in have[:-1]:
            drop_path(spark, f"{into}/{name}/__v={v}")
    return done


def versions(spark: SparkSession, at: str) -> list[int]:
    """Complete snapshots, the oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(at)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[4:]) for n in names if n.startswith("__v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS")))


def snapshot(spark: SparkSession, into: str, name: str) -> DataFrame:
    """The newest complete snapshot of statistics."""
    have = versions(spark, f"{into}/{name}")
    if not have:
        raise FileNotFoundError(f"{into}/{name}")
    return spark.read.parquet(f"{into}/{name}/__v={have[-1]}")


def sizes(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text).cast("long")).alias("bytes"), F.sum(F.floor(F.length(text) / 4)).alias("tokens"))
