"""Session settings, and tables that several branches of a plan read."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "textgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC, Arrow and filters pushed to Python sources; further settings as keywords with underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true"}
    for key, value in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for a block, then as they were; keywords with double underscores for dots."""
    wanted = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` dealt over the cores where it comes in fewer splits than there are; a table of many splits, such as any large one, stays as it is.

    `rows`: so many at most to a task, for tables of narrow rows, whose splits hold millions of them.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt evenly, or by keys, over as many tasks as a shuffle has, or there are cores: for rows that are few bytes and much work, as tasks of a given number are not merged for want of bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def scratch(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; one is made here only where it is unset, and only on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="textgauge-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str, suffix: str = "") -> str:
    """A new name in the folder of `scratch`, removed with all under it when the interpreter ends."""
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}{suffix}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is already gone when the interpreter exits
        pass


def materialized(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the folder of `scratch`."""
    scratch(df.sparkSession)
    return df.checkpoint()
