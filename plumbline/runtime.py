"""Session settings, table access, and lineage cuts in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: set[str] = set()


def local_session(app: str = "plumbline", cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only for a local session that has none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        _made.add(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh place under the shared folder, removed when this process ends."""
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.add(at)
    return at


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and survives lost executors."""
    return cut_counted(df, what)[0]


def cut_counted(df: DataFrame, what: str = "cut", path: str | None = None) -> tuple[DataFrame, int]:
    """As cut, with the number of rows, counted while they are written."""
    spark = df.sparkSession
    path = path or new_path(spark, what)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["n"] or 0)


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """A table built once per session and name, as an index is: written to the shared folder, with `by` in its order, so that filters on it skip row groups."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        df = build()
        if by:
            df = df.repartitionByRange(partitions(spark), by).sortWithinPartitions(by)
        path = new_path(spark, "stored")
        df.write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a place made by new_path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    _made.discard(path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for at in sorted(_made, key=len, reverse=True):
        if at.startswith("file://"):
            shutil.rmtree(at[7:], ignore_errors=True)
        elif spark is not None:
            try:
                drop_path(spark, at)
            except Exception:  # the session may be gone by then
                pass


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
