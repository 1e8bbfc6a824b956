"""What the operators of this subpackage share: table readers, scratch tables, small expressions."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Rows of a batch of texts, and the bytes of text that a function handles at once.
TEXT_ROWS, TEXT_BYTES = 128, 4 << 20

#: Words are runs of anything but ASCII white space; the same class in Java, RE2 and Python.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an integer's decimal text, modulo a small number; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is made on a single machine; a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="textgauge-"))
    return sc.getCheckpointDir()


def sliced(batches: Iterator, rows: int = TEXT_ROWS) -> Iterator:
    """Arrow batches in slices of at most `rows` rows, and of TEXT_BYTES bytes where more than one row is in them, so that
    what a function builds for one follows neither the size of Spark's batches nor the length of the texts in them."""
    for batch in batches:
        many = isinstance(batch, tuple)
        column = batch[0] if many else batch
        held = np.arange(len(column) + 1)
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            held = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        at = 0
        while at < len(column):
            end = int(np.searchsorted(held, held[at] + TEXT_BYTES, "right")) - 1
            end = max(at + 1, min(end, at + rows, len(column)))
            yield tuple(x.slice(at, end - at) for x in batch) if many else batch.slice(at, end - at)
            at = end


def low_hash(c: Column, share: Column) -> Column:
    """True for about `share` of the values, always the same ones: a small part to take the lowest hashes from,
    so that no task sorts, and the driver never sees, a part that grows with the number of tasks."""
    return F.pmod(F.xxhash64(c), F.lit(1 << 40)) < share * F.lit(float(1 << 40))


def wide_share(wanted: int, total: int) -> float:
    """The share that holds `wanted` rows of `total` with near certainty."""
    return 1.0 if total <= 4 * wanted + 64 else (2 * wanted + 64) / total


def hold_batches(spark: SparkSession) -> None:
    """Holds the session's batches of rows to TEXT_ROWS from here on, in the Parquet reader and on the way to Python.

    Documents are large: the reader's vectors, the Arrow buffers outside the heap and the Python
    worker each hold a whole batch. This is for applications, such as the queries and the pipeline
    here; no operator changes the settings of the session it is given.
    """
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(name)) > TEXT_ROWS:
            spark.conf.set(name, str(TEXT_ROWS))


def text_udf(f, ddl: str):
    """An Arrow function over texts."""
    return arrow_udf(f, ddl)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is already gone when the interpreter exits
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder. Cuts the lineage; survives lost executors.

    The table goes when the interpreter ends, or earlier through `discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by `written`; nothing may read it afterwards."""
    if path := getattr(df, "_scratch_path", None):
        _remove(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished plans now. It does so when the driver's heap is collected, which a
    driver with little to do puts off while the executors' disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
