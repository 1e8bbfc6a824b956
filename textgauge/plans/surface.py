"""Registered queries of the sources and sinks: what is written is read again and compared in SQL."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.operators import aggregates as A
from textgauge.operators import audio, checks
from textgauge.plans import catalog, score
from textgauge.plans.catalog import _RATES_SQL, _RECORDS_SQL, _TIER_SQL, query
from textgauge.plans.session import scratch_path, settings
from textgauge.sources import files, raw, sinks
from textgauge.sources.records import write_records
from textgauge.streaming import incremental


@cache
def _record_root(application: str, sf: str) -> str:
    """Adjacent turns of two engines as archives of records, the second on a track of its own; written once a session, gone when it ends."""
    spark = SparkSession.active()
    root = scratch_path(spark, "records")
    rows = catalog.records(spark, sf)
    params = F.format_string('{"model": "%s", "b": [1, 2], "a": {"z": "é", "k": null}}', "engine_key")
    rows = rows.withColumns({
        "utt_id": F.col("file_utt_id"), "lang": F.col("lang_key"), "engine": F.concat(F.lit("vendor "), "engine_key"), "track": F.when(F.col("engine_key") == "next", "a").otherwise("b"),
        "params": F.parse_json(params), "error": F.lit(None).cast("string"), "raw_response": F.parse_json(F.to_json(F.struct("text"))), "retries": F.when(F.col("engine_key") == "next", 1),
    })
    write_records(rows, root)
    return root


def _written_records(spark: SparkSession, sf: str) -> str:
    return _record_root(spark.sparkContext.applicationId, sf)


def _read(spark, sf, **how) -> DataFrame:
    return raw.read_records(spark, _written_records(spark, sf), **how)


_KEYS_SQL = f"SELECT engine AS engine_key, CASE engine WHEN 'next' THEN 'a' ELSE 'b' END AS track, lang AS lang_key, utt_id AS file_utt_id, * EXCLUDE (engine, track, lang) FROM ({_RECORDS_SQL})"


@query(f"SELECT engine_key, track, lang_key, file_utt_id, utt_id, md5(ref_raw) AS ref, CASE WHEN engine_key = 'echo' OR length(hyp_raw) > 0 THEN md5(hyp_raw) END AS hyp, duration AS duration_sec, latency AS latency_sec FROM ({_KEYS_SQL})")
def record_scan(spark, sf):
    rows = _read(spark, sf)
    hyp = F.when((F.col("engine_key") == "echo") | (F.length("text") > 0), F.md5(F.col("text").cast("binary")))
    return rows.select("engine_key", "track", "lang_key", "file_utt_id", "utt_id", F.md5(F.col("ref_text_raw").cast("binary")).alias("ref"), hyp.alias("hyp"), "duration_sec", "latency_sec")


@query(f"SELECT DISTINCT engine_key AS engine FROM ({_KEYS_SQL})")
def record_engines(spark, sf):
    return raw.engines(_read(spark, sf))


@query(f"SELECT DISTINCT track, lang_key AS lang FROM ({_KEYS_SQL}) WHERE track = 'b'")
def record_partitions(spark, sf):
    return raw.partitions(_read(spark, sf, track="b"))


@query(f"SELECT engine_key, file_utt_id, (row_number() OVER (PARTITION BY engine_key, track, lang_key ORDER BY file_utt_id) - 1)::INTEGER AS ord FROM ({_KEYS_SQL})")
def record_order(spark, sf):
    return raw.in_order(_read(spark, sf)).select("engine_key", "file_utt_id", "ord")


@query(f"""SELECT engine_key AS engine, engine_key AS model_id, lang_key AS lang, utt_id, CASE engine_key WHEN 'next' THEN 1 ELSE 0 END::INTEGER AS retries, NULL::VARCHAR AS error,
'{{"a": {{"k": null, "z": "é"}}, "b": [1, 2], "model": "' || engine_key || '"}}' AS params_json, '2026-07-05T00:00:00Z' AS timestamp_utc FROM ({_KEYS_SQL})""")
def flat_transcriptions(spark, sf):
    return raw.transcriptions(_read(spark, sf)).select("engine", "model_id", "lang", "utt_id", "retries", "error", "params_json", "timestamp_utc")


@query("""SELECT event_id, '{"a": {"b": "é", "y": [1, 2]}, "k": ' || json_extract_string(props, '$.k') || ', "z": "' || event_type || '"}' AS props_json FROM events""")
def canonical_props(spark, sf):
    """Keys in another order, escapes and missing spaces come out in one form."""
    mixed = F.format_string('{"z":"%s","k":%s,"a":{"y":[1,2],"b":"\\u00e9"}}', "event_type", F.get_json_object("props", "$.k"))
    return raw.table(spark, sf, "events").select("event_id", raw.canonical_json(mixed).alias("props_json"))


def _document_cells(spark, sf) -> DataFrame:
    """Cells of documents with every field of a score document; intervals and factors derived from the rate."""
    rate, kinds = F.col("rate"), {}
    for kind, by in (("cer", 1.0), ("wer", 0.5)):
        kinds |= {f"{kind}_corpus": rate * by, f"{kind}_ci95_lo": rate * by / 2, f"{kind}_ci95_hi": rate * by * 1.5, f"{kind}_utterance_mean": rate * by * 0.75}
    tiers = catalog._tier_groups(spark, sf)
    cells = catalog._cell_rates(spark, sf).withColumns(kinds | {
        "n_utterances": F.lit(200), "empty_transcripts": F.lit(3), "rtf_p50": rate * 10, "rtf_p90": rate * 20, "model_ids": F.array(F.concat(F.lit("m "), "engine")), "run_dates": F.array(F.lit("2026-07-05")),
        "price_per_audio_hour_usd": F.when(F.col("engine") != "src1", F.lit(0.36)), "headline_metric": F.when(F.col("lang") == "de", "cer").otherwise("wer"),
    })
    return cells.join(tiers, ["track", "lang"]).join(A.tiers(tiers), ["track", "lang", "engine"])


def _document_path(spark, sf) -> str:
    path = scratch_path(spark, "scores", ".json")
    sinks.write_document(sinks.score_document(_document_cells(spark, sf)), path)
    return path


@query(f"SELECT track, lang, engine, CASE lang WHEN 'de' THEN 'cer' ELSE 'wer' END AS headline_metric, 200::INTEGER AS n_utterances, 3::INTEGER AS empty_transcripts, round(rate, 6) AS cer, round(rate / 4, 6) AS wer_lo, round(rate * 20, 4) AS rtf_p90, 'm ' || engine AS model_ids, CASE WHEN engine <> 'src1' THEN 0.36 END::DOUBLE AS price FROM ({_RATES_SQL})")
def score_document_roundtrip(spark, sf):
    rows = raw.read_scores(spark, _document_path(spark, sf))
    return rows.select(
        "track", "lang", "engine", "headline_metric", "n_utterances", "empty_transcripts", F.col("cer.corpus_rate").alias("cer"), F.col("wer.ci95")[0].alias("wer_lo"),
        "rtf_p90", F.array_join("model_ids", ";").alias("model_ids"), F.col("price_per_audio_hour_usd").alias("price"),
    )


@query(f"SELECT lang, engine, round(rate, 9) AS rate FROM ({_RATES_SQL})")
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "cells")
    sinks.write_parquet(catalog._cell_rates(spark, sf), path, "lang", "engine")
    return spark.read.parquet(path).select("lang", "engine", F.round("rate", 9).alias("rate"))


@query(f"""SELECT name, n, n AS n_read, 'T' AS same_bytes FROM (SELECT 'scores' AS name, count(*) AS n FROM (SELECT DISTINCT lang, engine FROM ({_RATES_SQL})) UNION ALL SELECT 'copy', count(*) FROM (SELECT DISTINCT lang, engine FROM ({_RATES_SQL})))""")
def copied_document(spark, sf):
    """A score document and its copy: the entries read from each, and whether their digests are equal."""
    paths = {"scores": _document_path(spark, sf)}
    paths["copy"] = paths["scores"] + ".copy"
    sinks.copy_file(paths["scores"], paths["copy"])
    same = files.digests(spark, *paths.values()).groupBy("length", "sha256").count().where("count = 2").count() == 1
    rows = None
    for name, path in paths.items():
        each = raw.read_scores(spark, path).groupBy().agg(F.count("*").alias("n"), F.count_distinct("lang", "engine").alias("n_read")).select(F.lit(name).alias("name"), "n", "n_read")
        rows = each if rows is None else rows.union(each)
    return rows.withColumn("same_bytes", F.lit("T" if same else "F"))


@query(f"""SELECT 'a/' || lang || ' (' || CASE lang WHEN 'de' THEN 'CER' ELSE 'WER' END || '): ' || string_agg('T' || tie_group || '[' || members || ']', ' ' ORDER BY tie_group) AS line FROM
(SELECT t.lang, t.tie_group, string_agg(t.engine || '=' || format('{{:.4f}}', round(r.rate * CASE t.lang WHEN 'de' THEN 1 ELSE 0.5 END, 6)), ',' ORDER BY t.engine) AS members FROM ({_TIER_SQL}) t JOIN ({_RATES_SQL}) r USING (engine, lang) GROUP BY ALL) GROUP BY lang""")
def summary_lines(spark, sf):
    lines = sinks.summary(files.read_json(spark, _document_path(spark, sf)))
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query(f"""SELECT t.lang, list_position(['ja','en','zh','ko','vi','id','th','de','fr','es','pt','ru'], t.lang)::BIGINT AS place, t.tie_group AS tier, least(t.tie_group, 4)::INTEGER AS shade, t.engine, upper(t.engine) || '&amp;' AS label,
CASE WHEN t.engine = 'src1' THEN '—' ELSE '$0.360' END AS price, format('{{:.2f}} / {{:.2f}}', r.rate * 10, r.rate * 20) AS rtf, 3::INTEGER AS empty FROM ({_TIER_SQL}) t JOIN ({_RATES_SQL}) r USING (engine, lang)""")
def page_rows(spark, sf):
    names = {f"src{i}": f"SRC{i}&" for i in range(100)}
    return sinks.page_rows(_document_cells(spark, sf), names).select("lang", "place", "tier", "shade", "engine", "label", "price", "rtf", "empty")


_WAVE_SQL = "SELECT vec_id, list_transform(embedding, lambda x: least(greatest(round_even(x::DOUBLE * 32768, 0), -32768), 32767) / 32768) AS x FROM embeddings"


@query(f"SELECT vec_id, 'PCM_16' AS subtype, 16000::INTEGER AS sample_rate, round(p, 9) AS peak, round(CASE WHEN p > 0 THEN 0.5 / p ELSE 1.0 END, 6) AS scale, p > 0 AS passes FROM (SELECT vec_id, coalesce(list_max(list_transform(x, lambda v: abs(v))), 0.0)::DOUBLE AS p FROM ({_WAVE_SQL}))")
def wav_roundtrip(spark, sf):
    """Embeddings as waveforms: written as WAV, read, brought to half of the range, written and checked again."""
    files = raw.table(spark, sf, "embeddings").select("vec_id", audio.wav_bytes(F.col("embedding"), F.lit(16000)).alias("content"))
    first = audio.normalize_wav(files).select("vec_id", "wav", "peak", "scale", "sample_rate", "subtype")
    again = audio.normalize_wav(first.select("vec_id", F.struct("peak", "scale", "sample_rate", "subtype").alias("was"), "wav"), "wav").select("vec_id", "was", F.col("peak").alias("now"), "subtype")
    return again.select("vec_id", "was.subtype", "was.sample_rate", F.round("was.peak", 9).alias("peak"), F.round("was.scale", 6).alias("scale"), audio.passes(F.col("subtype"), F.col("now")).alias("passes"))


@query(f"SELECT vec_id % 3 AS kind, count(*) AS n_files, count(*) FILTER (NOT p BETWEEN 0.45 AND 0.55) AS n_bad FROM (SELECT vec_id, coalesce(list_max(list_transform(x, lambda v: abs(v))), 0.0)::DOUBLE AS p FROM ({_WAVE_SQL})) GROUP BY 1")
def wav_check(spark, sf):
    files = raw.table(spark, sf, "embeddings").select((F.col("vec_id") % 3).alias("kind"), audio.wav_bytes(F.col("embedding"), F.lit(16000)).alias("content"))
    return audio.check_wavs(files, by=("kind",))


@query(f"SELECT engine_key, track, lang_key, sum(errors)::BIGINT AS errors, sum(ref_len)::BIGINT AS ref_len FROM (SELECT u.engine AS engine_key, CASE u.engine WHEN 'next' THEN 'a' ELSE 'b' END AS track, u.lang AS lang_key, u.cer_errors AS errors, u.cer_len AS ref_len FROM ({catalog._UTTERANCES_SQL}) u) GROUP BY ALL")
def stream_rates(spark, sf):
    """Record files read as a stream until there are no more, over normal forms, with totals by cell."""
    root = _written_records(spark, sf)
    out, name = scratch_path(spark, "stream"), f"rates_{uuid.uuid4().hex}"
    rates = incremental.running_rates(incremental.read_stream(spark, root, settle=0), literal=False)
    rates.writeStream.trigger(availableNow=True).format("memory").queryName(name).option("checkpointLocation", out).outputMode("complete").start().awaitTermination()
    return spark.table(name).groupBy("engine_key", "track", "lang_key").agg(F.sum("errors").alias("errors"), F.sum("ref_len").alias("ref_len"))


def _run_changes(spark, root: str, log: str, state: str) -> None:
    with settings(spark, spark__sql__streaming__stateStore__providerClass=incremental.STATE_STORE):
        rows = incremental.changes(incremental.read_stream(spark, root, settle=0))

        def keep(batch: DataFrame, number: int) -> None:  # a batch that is run again writes its own folder again
            batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

        rows.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", state).foreachBatch(keep).start().awaitTermination()


@query(catalog.CELL_FIGURES_SQL)
def stream_corrections(spark, sf):
    """Records that come twice and records that are corrected, over two runs of a stream: the figures of cells are those of the last word."""
    root, log, state = (scratch_path(spark, x) for x in ("fed", "log", "state"))
    rows = catalog.records(spark, sf).withColumn("which", F.crc32(F.col("file_utt_id").cast("binary")) % 3)
    wrong = rows.withColumns({"text": F.when(F.col("which") == 0, "not this").otherwise(F.col("text")), "latency_sec": F.when(F.col("which") == 0, 99.0).otherwise(F.col("latency_sec")), "params": F.when(F.col("which") == 0, '{"model": "old"}').otherwise(F.col("params")), "timestamp_utc": F.when(F.col("which") == 0, "2026-07-04T00:00:00Z").otherwise(F.col("timestamp_utc"))})
    for part in (wrong, rows.where("which < 2")):
        write_records(part.drop("which").withColumn("params", F.parse_json("params")), root, "append")
        _run_changes(spark, root, log, state)
    cells = score.priced(score.figures(incremental.current(spark.read.parquet(log))))
    return catalog.rounded_figures(cells.withColumns({c: F.array_join(c, ";") for c in ("model_ids", "run_dates")}))


@query("SELECT d.source AS engine, d.lang, count(*) AS n_utterances, count(*) AS n_texts, (SELECT count(*) FROM documents) AS n_rows, 'T' AS card FROM documents d GROUP BY ALL")
def checked_package(spark, sf):
    """Documents as transcriptions and their cells, written with all constraints and read again."""
    folder, card = scratch_path(spark, "package"), scratch_path(spark, "card", ".md")
    files.write_text(spark, "# card\n", card)
    docs = raw.table(spark, sf, "documents").select(F.col("source").alias("engine"), "lang", F.col("doc_id").alias("utt_id"), F.coalesce("text", F.lit("")).alias("hypothesis"))
    cells = catalog.document_cells(spark, sf).groupBy("engine", "lang").agg(F.count("*").alias("n_utterances"))
    found = checks.write_package(docs, cells, folder, card)
    copied = "T" if files.exists(spark, f"{folder}/{card.rsplit('/', 1)[-1]}") else "F"
    sizes = spark.read.parquet(f"{folder}/transcriptions").groupBy("engine", "lang").agg(F.count("hypothesis").alias("n_texts"))
    return spark.read.parquet(f"{folder}/cell_scores").join(sizes, ["engine", "lang"]).withColumns({"n_rows": F.lit(found["rows"]).cast("long"), "card": F.lit(copied)})
