"""Small files on any file system that Spark knows, through Hadoop's API on the driver.

What is written appears under its name at once or not at all: bytes go to a temporary name beside it, which a rename
replaces. Content that is compared or copied does not pass through Python.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file, or a folder with all that is in it."""
    fs, at = _path(spark, path)
    return fs.delete(at, True)


def _temporary(spark: SparkSession, at):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{at.getName()}.{uuid.uuid4().hex}")


def _put(spark: SparkSession, fs, temporary, at) -> None:
    """Renames over what is there, in one step where the file system has one."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(at), over)


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    """`content` under `path`, whose folder is made if need be."""
    fs, at = _path(spark, path)
    fs.mkdirs(at.getParent())
    temporary = _temporary(spark, at)
    try:
        out = fs.create(temporary, True)
        try:
            out.write(content)
        finally:
            out.close()
        _put(spark, fs, temporary, at)
    except BaseException:
        fs.delete(temporary, False)
        raise


def write_text(spark: SparkSession, text: str, path: str) -> None:
    write_bytes(spark, text.encode("utf-8"), path)


def copy(spark: SparkSession, source: str, target: str) -> int:
    """A byte-for-byte copy, between file systems if need be; its size."""
    (fs, at), (to_fs, to) = _path(spark, source), _path(spark, target)
    to_fs.mkdirs(to.getParent())
    temporary = _temporary(spark, to)
    try:
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, to_fs, temporary, False, True, spark.sparkContext._jsc.hadoopConfiguration())
        _put(spark, to_fs, temporary, to)
    except BaseException:
        to_fs.delete(temporary, False)
        raise
    return to_fs.getFileStatus(to).getLen()


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Gives a file or folder another name on its file system; what was there goes first."""
    fs, at = _path(spark, target)
    fs.delete(at, True)
    if not fs.rename(_path(spark, source)[1], at):
        raise OSError(f"{source} could not be renamed to {target}")


def contents(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, content) of files, a row each."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", "content")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(contents(spark, path).first().content)


def read_json(spark: SparkSession, path: str):
    return json.loads(read_bytes(spark, path))


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, sha256) of files, read by the executors."""
    return contents(spark, *paths).select("path", "length", F.sha2("content", 256).alias("sha256"))
