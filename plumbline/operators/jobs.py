"""A table of embedding jobs with leases, and branch states, rewritten batch by batch.

jobs: id, target_id, model, status, attempts, next_attempt_at, locked_at, locked_by, created_at, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enqueue(targets: DataFrame, model: str | None, now: Column, enabled: bool = True) -> DataFrame:
    """A pending job per target; blocked under the model __missing__ if none is set; none at all if disabled."""
    status = "Pending" if model else "Blocked"
    null = lambda kind: F.lit(None).cast(kind)
    out = targets.select(
        F.sha1(F.concat_ws("|", "target_id", F.lit(model or "__missing__"))).alias("id"), "target_id", F.lit(model or "__missing__").alias("model"), F.lit(status).alias("status"), F.lit(0).alias("attempts"),
        null("timestamp").alias("next_attempt_at"), null("timestamp").alias("locked_at"), null("string").alias("locked_by"), now.alias("created_at"), now.alias("updated_at"),
    )
    return out if enabled else out.limit(0)


def eligible(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "Pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))


def claim(jobs: DataFrame, n: int, worker: str, now: Column) -> DataFrame:
    """The table with the n oldest eligible jobs in process: one writer at a time, so none need be skipped."""
    mine = eligible(jobs, now).orderBy("created_at", "id").limit(n).select("id", F.lit(True).alias("mine"))
    x = jobs.join(F.broadcast(mine), "id", "left")  # at most n rows
    hit = F.col("mine").isNotNull()
    return x.withColumns({"status": F.when(hit, F.lit("Processing")).otherwise(F.col("status")), "attempts": F.col("attempts") + hit.cast("int"), "locked_at": F.when(hit, now).otherwise(F.col("locked_at")), "locked_by": F.when(hit, F.lit(worker)).otherwise(F.col("locked_by")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("mine")


def _release(jobs: DataFrame, which: Column, status: str, now: Column, next_attempt: Column | None = None) -> DataFrame:
    null = F.lit(None)
    set_ = lambda c, v: F.when(which, v).otherwise(F.col(c))
    out = {"status": set_("status", F.lit(status)), "locked_at": set_("locked_at", null), "locked_by": set_("locked_by", null), "updated_at": set_("updated_at", now)}
    if next_attempt is not None:
        out["next_attempt_at"] = set_("next_attempt_at", next_attempt)
    return jobs.withColumns(out)


def complete(jobs: DataFrame, ids: list[str], now: Column) -> DataFrame:
    return _release(jobs, F.col("id").isin(ids), "Completed", now)


def requeue(jobs: DataFrame, ids: list[str], now: Column, next_attempt: Column) -> DataFrame:
    return _release(jobs, F.col("id").isin(ids), "Pending", now, next_attempt)


def requeue_stale(jobs: DataFrame, cutoff: Column, now: Column) -> DataFrame:
    return _release(jobs, F.coalesce((F.col("status") == "Processing") & (F.col("locked_at") < cutoff), F.lit(False)), "Pending", now)


def branch_states(changes: DataFrame) -> DataFrame:
    """changes: repo_id, branch_name, at, head, indexed. The latest head, the last indexed head, and the state between them."""
    keys = ["repo_id", "branch_name"]
    x = changes.groupBy(*keys).agg(F.max(F.struct("at", "head")).alias("h"), F.max(F.when(F.col("indexed"), F.struct("at", "head"))).alias("i"))
    state = F.when(F.col("i").isNull(), F.lit("Pending")).when(F.col("i.head") == F.col("h.head"), F.lit("Completed")).otherwise("Stale")
    return x.select(*keys, F.col("h.head").alias("head_commit_sha"), F.col("i.head").alias("indexed_commit_sha"), state.alias("index_state"), (state != "Completed").alias("needs_indexing"))


def stale_branches(branches: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Branches other than the default not used for some days."""
    return branches.where((F.col("last_accessed") < now - F.make_dt_interval(days=F.lit(days))) & (F.col("branch_name") != F.col("default_branch")))
