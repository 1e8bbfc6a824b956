"""Reading transcription records and score documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textgauge.sources import files
from textgauge.sources.records import register

_RATES = T.StructType([T.StructField("corpus_rate", T.DoubleType()), T.StructField("ci95", T.ArrayType(T.DoubleType())), T.StructField("utterance_mean", T.DoubleType())])
_ENGINE = T.StructType(
    [T.StructField("n_utterances", T.IntegerType()), T.StructField("empty_transcripts", T.IntegerType()), T.StructField("cer", _RATES), T.StructField("wer", _RATES), T.StructField("rtf_p50", T.DoubleType()), T.StructField("rtf_p90", T.DoubleType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("model_ids", "run_dates")]
    + [T.StructField("price_per_audio_hour_usd", T.DoubleType())]
)
_LANG = T.StructType([T.StructField("headline_metric", T.StringType()), T.StructField("tie_groups", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("engines", T.MapType(T.StringType(), _ENGINE))])
SCORES = T.StructType([T.StructField("tracks", T.MapType(T.StringType(), T.MapType(T.StringType(), _LANG)))])


def read_records(spark: SparkSession, root: str, track: str = "*", engine: str = "*", lang: str = "*") -> DataFrame:
    """Records under {root}/{engine}/{track}/{lang}, single files and archives, with engine_key, track, lang_key and file_utt_id from their names.

    Folders of another track, engine or language than the given ones are not listed; filters on these columns do the same where the
    session has spark.sql.python.filterPushdown.enabled. Nested objects come as JSON text. A file that is no JSON gives
    a row of nulls, which `checks` finds.
    """
    register(spark)
    fixed = {"engine_key": engine, "track": track, "lang_key": lang, "pushed": spark.conf.get("spark.sql.python.filterPushdown.enabled")}
    return spark.read.format("records").options(**fixed).load(root).drop("file_time")


def engines(records: DataFrame) -> DataFrame:
    return records.select(F.col("engine_key").alias("engine")).distinct().orderBy("engine")


def partitions(records: DataFrame) -> DataFrame:
    return records.select("track", F.col("lang_key").alias("lang")).distinct().orderBy("track", "lang")


def in_order(records: DataFrame) -> DataFrame:
    """`records` with ord, the place of an utterance in its cell by file name, from 0."""
    by = Window.partitionBy("engine_key", "track", "lang_key").orderBy("file_utt_id")
    return records.withColumn("ord", F.row_number().over(by) - 1)


def _canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True) for x in texts.to_pylist()], pa.string())


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and plain Unicode; null for null."""
    return arrow_udf(_canonical, "string")(c)


def transcriptions(records: DataFrame) -> DataFrame:
    """The flat table of records, by engine, language and utterance."""
    from textgauge.operators.aggregates import model_id

    out = records.select(
        F.col("engine_key").alias("engine"),
        model_id(F.col("params")).alias("model_id"),
        F.col("lang_key").alias("lang"),
        "utt_id", "duration_sec", "ref_text_raw", "ref_text_normalized",
        F.col("text").alias("hypothesis"), "latency_sec", "timestamp_utc",
        F.coalesce("retries", F.lit(0)).alias("retries"),
        canonical_json(F.col("error")).alias("error"),
        canonical_json(F.coalesce("params", F.lit("{}"))).alias("params_json"),
        canonical_json(F.coalesce("raw_response", F.lit("null"))).alias("raw_response_json"),
    )
    return out.orderBy("engine", "lang", "utt_id")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A nested score document as one row an engine: track, lang, engine, headline_metric, tie_groups and the fields of the engine."""
    doc = spark.read.schema(SCORES).option("multiLine", True).json(path)
    rows = doc.select(F.explode("tracks").alias("track", "langs")).select("track", F.explode("langs").alias("lang", "node"))
    rows = rows.select("track", "lang", "node.headline_metric", "node.tie_groups", F.explode("node.engines").alias("engine", "e"))
    return rows.select("track", "lang", "engine", "headline_metric", "tie_groups", "e.*")


def read_strings(folder: str, locale: str) -> dict[str, str]:
    """UI strings of a locale; none where the file is missing."""
    spark, path = SparkSession.active(), f"{folder}/{locale}.json"
    return files.read_json(spark, path) if files.exists(spark, path) else {}


def require_strings(strings: dict[str, str], locale: str = "en") -> None:
    """A page needs the strings of its fallback locale."""
    if not strings:
        raise FileNotFoundError(f"no strings of the locale {locale}")


def template(strings: dict[str, str], fallback: dict[str, str], key: str, **values: str) -> str:
    """A string of the locale, or of the fallback, with {name} replaced."""
    text = strings.get(key, fallback.get(key, ""))
    for name, value in values.items():
        text = text.replace("{" + name + "}", value)
    return text


def read_wavs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
