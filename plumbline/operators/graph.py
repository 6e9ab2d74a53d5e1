"""Edges between symbols: references, dependencies, call chains, relations, re-ranking by degree.

edges: source_id, target_id, kind, repo_id, line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import relational as R
from . import stats

#: Parts of the old score and of the degree in a re-ranked one, and the degree that counts in full.
OLD, DEGREE, FULL = 0.7, 0.3, 20.0


def references(edges: DataFrame, symbols: DataFrame, target: str, kind: str | None = None, k: int | None = 100) -> DataFrame:
    """What points at a symbol, with the source symbol's place."""
    x = R.where_given(edges, target_id=target, kind=kind).join(symbols.select(F.col("id").alias("source_id"), "name", "file_path"), "source_id")
    x = x.select("source_id", "name", "kind", "file_path", "line").orderBy("file_path", "line", "source_id")
    return x.limit(k) if k is not None else x


def dependencies(edges: DataFrame, source: str, kind: str | None = None, k: int | None = 100) -> DataFrame:
    x = R.where_given(edges, source_id=source, kind=kind).select("target_id", "kind", "line").orderBy("line", "target_id")
    return x.limit(k) if k is not None else x


def call_chain(edges: DataFrame, start: DataFrame, depth: int = 5, kind: str = "Calls", distinct: bool = False) -> DataFrame:
    """All walks from the start symbols (column symbol_id) along edges of a kind: start_id, symbol_id, depth, walks.

    Equal walks' ends are counted, not repeated; distinct keeps each symbol at its least depth only.
    """
    calls = edges.where(F.col("kind") == kind).groupBy(F.col("source_id").alias("symbol_id"), F.col("target_id").alias("next")).agg(F.count(F.lit(1)).alias("edges"))
    calls = cut(calls, "calls")
    level = start.select(F.col("symbol_id").alias("start_id"), "symbol_id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("walks")).distinct()
    every = level
    for d in range(1, depth + 1):
        level = level.join(calls, "symbol_id").groupBy("start_id", F.col("next").alias("symbol_id")).agg(F.sum(F.col("walks") * F.col("edges")).alias("walks"))
        level = level.select("start_id", "symbol_id", F.lit(d).alias("depth"), "walks")
        if distinct:
            level = level.join(every.select("start_id", "symbol_id"), ["start_id", "symbol_id"], "left_anti")
        level = cut(level, "chain")
        every = every.unionByName(level)
    return every


def related(edges: DataFrame, wanted: DataFrame, out: int = 10, into: int = 10) -> DataFrame:
    """Per symbol of wanted (symbol_id): the first outgoing and incoming edges: symbol_id, other_id, relation, place."""
    a = R.top_per(edges.join(wanted.select(F.col("symbol_id").alias("source_id")), "source_id", "left_semi"), ["source_id"], out, "line", "target_id", "kind")
    b = R.top_per(edges.join(wanted.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi"), ["target_id"], into, "line", "source_id", "kind")
    a = a.select(F.col("source_id").alias("symbol_id"), F.col("target_id").alias("other_id"), F.col("kind").alias("relation"))
    b = b.select(F.col("target_id").alias("symbol_id"), F.col("source_id").alias("other_id"), F.concat(F.lit("CalledBy_"), "kind").alias("relation"))
    return a.unionByName(b)


def rerank(results: DataFrame, edges: DataFrame) -> DataFrame:
    """results: symbol_id (or null), score, ordinal. Adds graph_score, mixes it into score, keeps the order of equals."""
    x = results.join(stats.degrees(edges), "symbol_id", "left")
    g = F.least(F.lit(1.0), (F.coalesce("out_degree", F.lit(0)) + 2 * F.coalesce("in_degree", F.lit(0))) / FULL)
    known = F.col("symbol_id").isNotNull()
    x = x.withColumn("graph_score", F.when(known, F.round(g, 6)))
    x = x.withColumn("score", F.when(known, F.round(OLD * F.col("score") + DEGREE * F.col("graph_score"), 6)).otherwise(F.col("score")))
    return x.drop("out_degree", "in_degree").orderBy(F.desc("score"), "ordinal")


def children(symbols: DataFrame) -> DataFrame:
    """Parents with their number of direct children."""
    one = symbols.select(F.lower("id").alias("id"), F.lower("parent_symbol_id").alias("parent_id")).distinct()
    return one.where("parent_id is not null and trim(parent_id) <> ''").groupBy("parent_id").agg(F.countDistinct("id").alias("child_count"))
