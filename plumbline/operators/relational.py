"""Lookups, scoped scans, ordered joins, fusion, upserts: the relational shapes the engine is asked for."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **equal: Any) -> DataFrame:
    """Equality filters for the arguments that are not None, so each reaches the scan."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def by_ids(df: DataFrame, ids: Iterable[str], key: str = "id") -> DataFrame:
    """Rows whose key is among a driver-side list."""
    ids = list(dict.fromkeys(ids))
    if len(ids) <= 1000:
        return df.where(F.col(key).isin(ids)) if ids else df.limit(0)
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} string")
    return df.join(wanted, key, "left_semi")


def scan(df: DataFrame, order: list[str | Column], n: int | None = None, **equal: Any) -> DataFrame:
    out = where_given(df, **equal).orderBy(*order)
    return out.limit(n) if n is not None else out


def prefix(df: DataFrame, text: str, *cols: str) -> DataFrame:
    """Rows one of whose columns begins with text in any case; % and _ in it are wild."""
    some = F.lit(False)
    for c in cols:
        some = some | F.coalesce(F.col(c).ilike(f"{text}%"), F.lit(False))
    return df.where(some)


def first_per(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row per key in an order that must be total to be repeatable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per(df: DataFrame, keys: list[str], n: int, *order: str | Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def lookup_in_order(probe: DataFrame, build: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Inner join that keeps the order of the probing side; keys without a match are skipped."""
    return probe.join(build, key).orderBy(ordinal)


def full_outer_scores(a: DataFrame, b: DataFrame, key: str, wa: float, wb: float) -> DataFrame:
    """a: key, bm25_score; b: key, vector_score. Missing scores are 0; score is their weighted sum."""
    x = a.join(b, key, "full_outer").select(key, F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"))
    return x.withColumn("score", F.lit(wa) * F.col("bm25_score") + F.lit(wb) * F.col("vector_score"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool, order: str | None = None) -> DataFrame:
    """Old and new rows, one per key: the new row if update, else the old one; of several new ones the first by order."""
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    by = [F.desc("__side") if update else F.asc("__side"), *([F.col(order)] if order else [])]
    return first_per(both, keys, *by).drop("__side")


def delete_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def cascade_delete(parents: DataFrame, deleted: DataFrame, parent_key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parents without the deleted keys, and children without rows that hang on them."""
    out = {"parents": delete_matching(parents, deleted, [parent_key])}
    for name, (child, fk) in children.items():
        out[name] = child.join(deleted.select(F.col(parent_key).alias(fk)), fk, "left_anti")
    return out


def set_null_where_deleted(df: DataFrame, deleted: DataFrame, key: str, fk: str) -> DataFrame:
    gone = deleted.select(F.col(key).alias(fk), F.lit(True).alias("__gone")).distinct()
    cols = df.columns
    return df.join(gone, fk, "left").withColumn(fk, F.when(F.col("__gone").isNull(), F.col(fk))).select(*cols)


def replace_paths(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the old table whose file is not among the new ones', and the new rows."""
    return delete_matching(old, new.select(*keys).distinct(), keys).unionByName(new)


def running_budget(df: DataFrame, budget: int, text: str, keys: list[str], *order: str | Column) -> DataFrame:
    """Texts cut and then blanked so that together, in order, they stay within a number of characters."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).over(w), F.lit(0))
    left = F.greatest(F.lit(budget) - used, F.lit(0)).cast("int")
    return df.withColumn("__left", left).withColumn(text, F.when(F.col("__left") > 0, F.expr(f"substring({text}, 1, __left)"))).drop("__left")
