"""Streams of file changes: duplicates suppressed, batches indexed idempotently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators import relational as R
from ..runtime import drop_path


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Changes once per key while they are at most that late."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


#: Parts a table is divided into by a hash of the keys; a batch rewrites those it touches.
PARTS = 16


def index_into(stream: DataFrame, table: str, keys: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, order: str | None = None, parts: int = PARTS) -> StreamingQuery:
    """Upserts each batch into a parquet table of parts by key hash, each with versions of which the newest complete one counts.

    A batch rewrites the parts its keys fall into, as version n of batch n, and drops their versions before the last.
    A batch that is run again writes the same version from the same base, so it changes nothing.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = (prepare(df) if prepare else df).withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        new = new.persist()
        touched = [r[0] for r in new.select("__part").distinct().collect()]  # at most `parts`
        have = _versions(spark, table, below=n)
        paths = [f"{table}/__v={have[p][0]}/__part={p}" for p in touched if p in have]
        schema = new.drop("__part").schema
        old = spark.read.schema(schema).option("basePath", table).parquet(*paths) if paths else spark.createDataFrame([], schema)
        old = old.select(*schema.names).withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        R.upsert(old, new, keys, update=True, order=order).write.mode("overwrite").partitionBy("__part").parquet(f"{table}/__v={n}")
        new.unpersist()
        for p in touched:
            for v in have.get(p, [])[1:]:
                drop_path(spark, f"{table}/__v={v}/__part={p}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str, below: int | None = None) -> dict[int, list[int]]:
    """The complete versions of each part, newest first, below one if given."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if not fs.exists(root):
        return out
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if not name.startswith("__v=") or not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/{name}/_SUCCESS")):
            continue
        v = int(name[4:])
        if below is None or v < below:
            for p in fs.listStatus(s.getPath()):
                part = p.getPath().getName()
                if part.startswith("__part="):
                    out.setdefault(int(part[7:]), []).append(v)
    return {p: sorted(v, reverse=True) for p, v in out.items()}


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest complete version of every part of a table that index_into writes."""
    have = _versions(spark, table)
    if not have:
        raise FileNotFoundError(table)
    return spark.read.option("basePath", table).parquet(*[f"{table}/__v={v[0]}/__part={p}" for p, v in have.items()]).drop("__v", "__part")
