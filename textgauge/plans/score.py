"""From records to cell scores: the plan of a whole evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.functions.normalize import BY_CHARACTER, normal_forms
from textgauge.operators import aggregates as A
from textgauge.operators import checks, stats
from textgauge.operators.align import char_errors, edit_split, word_errors
from textgauge.plans.session import dealt

#: List prices in USD per audio hour; engines that are not listed have none. Fixed values.
PRICES = {"elevenlabs": 0.22, "openai": 0.36, "whisper1": 0.36, "google_stt_v2": 0.96, "deepgram": 0.258, "mai_transcribe": 0.36, "mistral_voxtral": 0.18}


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES.items()), "engine string, price_per_audio_hour_usd double")


def score_utterances(records: DataFrame, literal: bool = False) -> DataFrame:
    """One row a record: engine, track, lang, utt_id, errors and lengths by character and by word, their splits in cer_ops and wer_ops, empty, rtf, params, timestamp_utc.

    A null transcription counts as an empty one and is never left out; an unknown language stops the
    query. Every text is normalized once, every reference once however many engines have it; they
    meet by a digest of the reference. Characters of ja, th and zh are compared without white space,
    unless `literal` asks for the normalized text as it is; the word columns are null where a language
    has no words to count. Totals are built-in expressions; the Python function behind the splits runs
    only where cer_ops or wer_ops are kept.
    """
    strip = F.lit(False) if literal else F.col("lang").isin(*BY_CHARACTER)
    rows = records.select(
        F.col("engine_key").alias("engine"), "track", F.col("lang_key").alias("lang"), F.col("file_utt_id").alias("utt_id"),
        F.coalesce("ref_text_raw", F.lit("")).alias("ref"), F.coalesce("text", F.lit("")).alias("hyp"),
        "params", "timestamp_utc", A.real_time_factor(F.col("latency_sec"), F.col("duration_sec")).alias("rtf"),
    ).withColumn("digest", F.unhex(F.sha2("ref", 256)))
    refs = rows.select("lang", "digest", "ref").dropDuplicates(["lang", "digest"]).select("lang", "digest", normal_forms(F.col("lang"), F.col("ref"), strip).alias("r"))
    hyps = rows.drop("ref").withColumn("h", normal_forms(F.col("lang"), F.col("hyp"), strip))
    # a frequent reference, or few bytes that take long to compare, are no reason for few tasks
    both = dealt(hyps.join(refs, ["lang", "digest"]))
    return both.select(
        "engine", "track", "lang", "utt_id", "params", "timestamp_utc", "rtf", A.is_empty(F.col("hyp")).alias("empty"),
        char_errors(F.col("r.chars"), F.col("h.chars")).alias("cer_errors"), F.char_length("r.chars").alias("cer_len"),
        word_errors(F.col("r.words"), F.col("h.words")).alias("wer_errors"), F.when(F.col("r.words").isNotNull(), F.size("r.words")).alias("wer_len"),
        edit_split(F.col("r.chars"), F.col("h.chars")).alias("cer_ops"), edit_split(F.col("r.words"), F.col("h.words")).alias("wer_ops"),
    )


_CER, _WER = ("cer_errors", "cer_len"), ("wer_errors", "wer_len")


def figures(utterances: DataFrame) -> DataFrame:
    """One row a cell with all that needs no resampling: counts, rates, percentiles of real-time factors in __rtf, run dates, model ids."""
    has_words = F.max(F.col("wer_len").isNotNull())
    return utterances.groupBy(*A.CELL).agg(
        F.count("*").cast("int").alias("n_utterances"),
        F.count_if("empty").cast("int").alias("empty_transcripts"),
        A.corpus_rate(*map(F.col, _CER)).alias("cer_corpus"),
        A.utterance_mean(*map(F.col, _CER)).alias("cer_utterance_mean"),
        F.when(has_words, A.corpus_rate(*map(F.col, _WER))).alias("wer_corpus"),
        F.when(has_words, A.utterance_mean(*map(F.col, _WER))).alias("wer_utterance_mean"),
        A.percentiles(F.col("rtf"), 0.5, 0.9).alias("__rtf"),
        A.sorted_set(A.run_date(F.col("timestamp_utc"))).alias("run_dates"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(A.model_ids(F.col("params")))))).alias("model_ids"),
    )


def cell_table(utterances: DataFrame, pairing: str = "strict", n: int = stats.RESAMPLES, seed: int = stats.SEED) -> DataFrame:
    """One row a cell with every published figure; strict pairing raises, intersect keeps common utterances."""
    rows = checks.paired(utterances, pairing)
    keys = list(A.CELL)
    cells = figures(rows)
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(e).cast("long").alias("e"), F.col(r).cast("long").alias("r")) for kind, (e, r) in (("cer", _CER), ("wer", _WER))))
    each = rows.select(*keys, "utt_id", F.explode(kinds).alias("x")).select(*keys, "utt_id", "x.*").where("r is not null")
    ci = stats.cell_intervals(each, [*keys, "kind"], "e", "r", n=n, seed=seed)
    bounds = [F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_ci95_{c}") for kind in ("cer", "wer") for c in ("lo", "hi")]
    cells = cells.join(ci.groupBy(*keys).agg(*bounds), keys, "left")
    main = rows.withColumns({"errors": A.headline(F.col("lang"), F.col("cer_errors"), F.col("wer_errors")), "ref_len": A.headline(F.col("lang"), F.col("cer_len"), F.col("wer_len"))})
    groups = stats.tie_group_table(main, ["track", "lang"], n=n, seed=seed)
    return priced(cells).join(groups, ["track", "lang"]).join(A.tiers(groups), ["track", "lang", "engine"])


def priced(cells: DataFrame) -> DataFrame:
    """Cells with prices, the two percentiles and the metric of the headline."""
    cells = cells.join(F.broadcast(prices(cells.sparkSession)), "engine", "left")
    return cells.withColumns({"rtf_p50": F.col("__rtf")[0], "rtf_p90": F.col("__rtf")[1], "headline_metric": A.headline(F.col("lang"), F.lit("cer"), F.lit("wer"))}).drop("__rtf")


def cell_scores(cells: DataFrame, track: str = "a") -> DataFrame:
    """The flat table of one track, by language and engine."""
    joined = {c: F.array_join(c, ";") for c in ("model_ids", "run_dates")}
    rates = [f"{kind}_{x}" for kind in ("cer", "wer") for x in ("corpus", "utterance_mean", "ci95_lo", "ci95_hi")]
    columns = ["lang", "engine", "headline_metric", "n_utterances", "empty_transcripts", "model_ids", "run_dates", "price_per_audio_hour_usd", "rtf_p50", "rtf_p90", *rates, "tie_group", "tie_group_members"]
    return cells.where(F.col("track") == track).withColumns(joined).select(*columns).orderBy("lang", "engine")


def both_whitespace_modes(records: DataFrame) -> DataFrame:
    """Corpus rates by cell under both rules for white space: whitespace_mode is literal or stripped."""
    out = None
    for mode, literal in (("literal", True), ("stripped", False)):
        rows = score_utterances(records, literal).groupBy(*A.CELL).agg(A.corpus_rate(F.col("cer_errors"), F.col("cer_len")).alias("cer_corpus"))
        rows = rows.withColumn("whitespace_mode", F.lit(mode))
        out = rows if out is None else out.union(rows)
    return out


def nest(cells: DataFrame) -> DataFrame:
    """track and langs: a map of languages to maps of engines to their headline rate."""
    by_lang = cells.groupBy("track", "lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "rate")))).alias("engines"))
    return by_lang.groupBy("track").agg(F.map_from_entries(F.collect_list(F.struct("lang", "engines"))).alias("langs"))


def unnest(nested: DataFrame) -> DataFrame:
    rows = nested.select("track", F.explode("langs").alias("lang", "engines")).select("track", "lang", F.explode("engines").alias("engine", "rate"))
    return rows
