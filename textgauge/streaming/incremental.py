"""Incremental cell figures from a stream of records.

`running_rates` adds up whatever arrives. `changes` knows what each utterance contributed last: a record that comes again
changes nothing, a corrected one takes the place of the former. Its output is a log of what is added and taken away, by utterance,
so that no state and no task grows with a cell; `current` nets the log, and the figures of cells over that are those of the batch engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.functions.normalize import BY_CHARACTER, normal_forms
from textgauge.operators import aggregates as A
from textgauge.operators.align import char_errors, word_errors
from textgauge.plans.session import dealt
from textgauge.sources.records import register


def read_stream(spark: SparkSession, root: str, settle: float = 2) -> DataFrame:
    """New record files and archives under {root}/{engine}/{track}/{lang}, with keys from their paths and file_time, when the file was written."""
    register(spark)
    return spark.readStream.format("records").option("settle", settle).load(root)


def running_rates(records: DataFrame, watermark: str = "72 hours", literal: bool = True) -> DataFrame:
    """Character errors, lengths and their rate by cell and day of the run, over the texts as they are, or over their normal forms (literal=False).

    A record without a readable timestamp counts at the time its file was written. Records later than
    the watermark are left out.
    """
    ts = F.try_to_timestamp("timestamp_utc")
    rows = dealt(records).withColumn("ts", F.coalesce(ts, F.col("file_time")) if "file_time" in records.columns else ts).withWatermark("ts", watermark)
    ref, hyp = F.coalesce("ref_text_raw", F.lit("")), F.coalesce("text", F.lit(""))
    if not literal:
        strip = F.col("lang_key").isin(*BY_CHARACTER)
        ref, hyp = normal_forms(F.col("lang_key"), ref, strip)["chars"], normal_forms(F.col("lang_key"), hyp, strip)["chars"]
    scored = rows.select("engine_key", "track", "lang_key", "ts", char_errors(ref, hyp).alias("errors"), F.char_length(ref).alias("ref_len"))
    day = F.window("ts", "1 day")
    sums = scored.groupBy(day, "engine_key", "track", "lang_key").agg(F.sum("errors").alias("errors"), F.sum("ref_len").alias("ref_len"), A.corpus_rate(F.col("errors"), F.col("ref_len")).alias("rate"))
    return sums.select(F.col("window.start").alias("day"), "engine_key", "track", "lang_key", "errors", "ref_len", "rate")


#: What an utterance contributes to its cell.
_GIVEN_NAMES = ["cer_errors", "cer_len", "wer_errors", "wer_len", "empty", "rtf", "params", "timestamp_utc"]
_KEYS = ["engine", "track", "lang", "utt_id"]
#: The state store that keeps state by key on disk; what runs `changes` must have it in its session (spark.sql.streaming.stateStore.providerClass).
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def contributions(records: DataFrame, literal: bool = False) -> DataFrame:
    """engine, track, lang, utt_id, version and what each record contributes; the version is the time its file was written, then its own timestamp."""
    strip = F.lit(False) if literal else F.col("lang_key").isin(*BY_CHARACTER)
    lang = F.col("lang_key")
    # an archive is one split, and its texts take longer to compare than to read
    rows = dealt(records).select(
        F.col("engine_key").alias("engine"), "track", lang.alias("lang"), F.col("file_utt_id").alias("utt_id"),
        F.concat_ws(" ", F.date_format(F.to_utc_timestamp("file_time", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.coalesce("timestamp_utc", F.lit(""))).alias("version"),
        normal_forms(lang, F.coalesce("ref_text_raw", F.lit("")), strip).alias("r"), normal_forms(lang, F.coalesce("text", F.lit("")), strip).alias("h"),
        A.is_empty(F.col("text")).alias("empty"), A.real_time_factor(F.col("latency_sec"), F.col("duration_sec")).alias("rtf"), "params", "timestamp_utc",
    )
    return rows.select(
        *_KEYS, "version", char_errors(F.col("r.chars"), F.col("h.chars")).cast("long").alias("cer_errors"), F.char_length("r.chars").cast("long").alias("cer_len"),
        word_errors(F.col("r.words"), F.col("h.words")).cast("long").alias("wer_errors"), F.when(F.col("r.words").isNotNull(), F.size("r.words")).cast("long").alias("wer_len"),
        "empty", "rtf", "params", "timestamp_utc",
    )


def changes(records: DataFrame, literal: bool = False) -> DataFrame:
    """The log of a stream of records: keys, sign (1 comes, -1 leaves) and contribution, a row or two for each utterance that a batch changes.

    Of several records of an utterance the newest counts, in whatever order and batches they arrive. Null keys are keys.
    The state of an utterance is what its records contributed, each with the time of the batch that brought it; so the newest before this
    batch is known beside the newest now, by built-in aggregation. No state or task grows with a cell, but an utterance's state grows
    with its own records.
    """
    # one time for a whole batch, and the same one where it is run again
    seen = contributions(records, literal).withColumn("batch", F.current_timestamp())
    told = seen.groupBy(*_KEYS).agg(F.collect_set(F.struct("batch", F.struct("version", *_GIVEN_NAMES).alias("v"))).alias("all"), F.current_timestamp().alias("now"))
    earlier = F.filter("all", lambda x: x["batch"] != F.col("now"))
    newest = told.select(*_KEYS, F.array_max(F.transform("all", lambda x: x["v"])).alias("after"), F.array_max(F.transform(earlier, lambda x: x["v"])).alias("before"))
    given = {side: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in _GIVEN_NAMES)) for side in ("after", "before")}
    changed = newest.where(F.col("before").isNull() | (given["after"] != given["before"]))
    comes, leaves = (F.struct(F.lit(sign).alias("sign"), given[side].alias("v")) for sign, side in ((1, "after"), (-1, "before")))
    rows = changed.select(*_KEYS, F.explode(F.when(F.col("before").isNull(), F.array(comes)).otherwise(F.array(leaves, comes))).alias("x"))
    return rows.select(*_KEYS, "x.sign", "x.v.*")


def current(log: DataFrame) -> DataFrame:
    """The utterances that the log of `changes` leaves, as the batch engine scores them (see plans.score.figures)."""
    kept = log.groupBy(*_KEYS, *_GIVEN_NAMES).agg(F.sum("sign").alias("n")).where("n > 0")
    return kept.select(*_KEYS, *_GIVEN_NAMES)
