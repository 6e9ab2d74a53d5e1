"""Records of several sources mixed to target shares of the total size, by systematic sampling.

Each source has a rate, the copies expected of each of its records; a record's copies are the integers that
the running sum of rates, from one random offset per source, passes at it. Records are numbered by size
first, so a source's drawn size is off by little more than one record. The numbering sums per range of
sizes before it numbers within a range: no source is one task.

Defined results: the total is the largest that every source with records can fill at its share without a
text used more than max_repeats times, or the one asked for, and then sources may fall short; names of
sources compare without case, outer blanks and with - as _; a text that several records hold is one text,
its smallest id and source; sources without a target and records with null source, id or text, or without
tokens, are left out; a source without records is reported with share 0; null shares or repeats, or below
0, count as 0; of repeated targets of a source the largest counts; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, cut_counted
from . import tokens as T

#: Denominator of rates; parts that a range of sizes is spread over by hash at least, and records that make one more.
UNIT, SPREAD, EACH = 1_000_000_000, 64, 500_000


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[-\\s]+", "_")


def sized(documents: DataFrame, ranks: str = T.RANKS) -> DataFrame:
    """id, source, tokens of each distinct text: the smallest id and its source stand for it."""
    rows = T.with_tokens(documents.withColumn("__digest", F.sha2(F.col("text"), 256)), "text", ["doc_id", "source", "__digest"], ranks)
    rows = rows.where("doc_id is not null and source is not null and tokens > 0")
    one = rows.groupBy("__digest").agg(F.min(F.struct(F.col("doc_id").alias("id"), source_name(F.col("source")).alias("source"), "tokens")).alias("r"))
    return one.select("r.*")


def mix(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """records: id, source, tokens. Gives the draw (id, source, tokens, copies > 0) and the report per source."""
    records, n_records = cut_counted(records, "records")
    spread = max(SPREAD, n_records // EACH)  # a source may hold nearly all records, in few size ranges
    want = targets.where("source is not null").select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("most"))
    want = want.groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    have = records.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("texts"))
    plan = want.join(have, "source", "left")
    # One row per target source. The total: what the scarcest source can fill.
    able = F.col("most").cast("long") * F.col("available") / F.when(F.col("share") > 0, F.col("share"))
    whole = F.lit(float(total)) if total is not None else F.min(F.when((F.col("share") > 0) & (F.col("available") > 0) & (F.col("most") > 0), able)).over(Window.partitionBy(F.lit(0)))
    rate = F.least(F.floor(F.col("share") * whole / F.col("available") * float(UNIT)), F.col("most").cast("long") * F.lit(UNIT).cast("long")).cast("long")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(UNIT)).cast("long")
    plan = plan.select("source", "share", "most", "available", "texts", F.coalesce(rate, F.lit(0).cast("long")).alias("rate"), offset.alias("offset"))
    plan, _ = cut_counted(plan, "plan")

    size_range = F.floor(F.log2(F.col("tokens").cast("double")) * 8).cast("int")
    rows = records.join(F.broadcast(plan.select("source")), "source", "left_semi")  # as many rows as there are targets
    rows = rows.withColumns({"range": size_range, "part": F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(spread)).cast("int")})
    sums = rows.groupBy("source", "range", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "range", "part").orderBy("tokens", "id"))
    placed = rows.withColumn("inside", inside).join(sums, ["source", "range", "part"]).join(F.broadcast(plan.select("source", "rate", "offset")), "source")
    at = F.col("before") + F.col("inside")
    passed = lambda i: F.expr(f"(cast({i} as decimal(19, 0)) * rate + offset) div {UNIT}")
    placed = placed.withColumn("at", at)
    drawn = placed.select("id", "source", "tokens", (passed("at") - passed("(at - 1)")).cast("int").alias("copies")).where("copies > 0")
    drawn = cut(drawn, "drawn")

    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_texts"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left")
    every = Window.partitionBy(F.lit(0))  # as many rows as there are targets
    tokens = F.coalesce("drawn_tokens", F.lit(0))
    report = report.select(
        "source",
        F.col("share").alias("target_share"),
        F.col("most").alias("max_repeats"),
        F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("available", F.lit(0)).alias("available_tokens"),
        tokens.alias("drawn_tokens"),
        F.coalesce("drawn_texts", F.lit(0)).alias("drawn_texts"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(tokens / F.sum(tokens).over(every), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.col("share") / F.sum(F.when(F.col("available") > 0, F.col("share"))).over(every), F.lit(0.0)).alias("share_of_present"),
    )
    return drawn, report
