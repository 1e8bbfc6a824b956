import io
import json
import tarfile
import uuid
import wave
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgauge.operators import audio, checks
from textgauge.plans import score
from textgauge.plans.session import settings
from textgauge.sources import files, raw, records, sinks
from textgauge.streaming import incremental


def record(text, ref="der dritte Mann", **more):
    base = {"utt_id": "x", "lang": "de", "engine": "vendor", "duration_sec": 2.0, "latency_sec": 1.0, "ref_text_raw": ref, "ref_text_normalized": "?", "text": text, "timestamp_utc": "2026-07-05T10:00:00Z", "params": {"model": "m1", "b": 1, "a": {"z": "é"}}, "error": None, "retries": 0, "raw_response": {"text": text, "n": [1, 2]}}
    return base | more


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("raw")
    for engine in ("one", "two"):
        for i in range(6):
            text = "der 3 Mann" if engine == "one" else [None, "  ", "ein Mann", "der dritte", "x", "der dritte Mann"][i]
            path = top / engine / "a" / "de" / f"de_{i:04d}.json"
            path.parent.mkdir(parents=True, exist_ok=True)
            extra = {"duration_sec": 0} if i == 0 else {"duration_sec": None} if i == 1 else {}
            path.write_text(json.dumps(record(text, **extra), ensure_ascii=False))
    (top / "one" / "a" / "de" / "notes.txt").write_text("no record")
    return str(top)


def test_records(spark, root):
    rows = raw.read_records(spark, root)
    assert rows.count() == 12
    assert [r.engine for r in raw.engines(rows).collect()] == ["one", "two"]
    assert raw.partitions(rows).collect()[0].asDict() == {"track": "a", "lang": "de"}
    assert raw.read_records(spark, root, engine="two").count() == 6
    first = raw.in_order(rows).where("engine_key = 'one' and ord = 0").first()
    assert first.file_utt_id == "de_0000" and first.engine == "vendor"


def test_archives_beside_files_and_what_is_no_record(spark, tmp_path):
    at = tmp_path / "one" / "a" / "de"
    at.mkdir(parents=True)
    (at / "de_0.json").write_text(json.dumps(record("x y")))
    (at / "broken.json").write_text("{no json")
    (at / "list.json").write_text("[1]")
    (at / "_half.json").write_text("{}")
    (tmp_path / "one" / "a" / "empty").mkdir()
    with tarfile.open(at / "more.tar", "w") as archive:
        for i in range(5):
            raw_bytes = json.dumps(record(None if i == 4 else f"text {i}", retries=i, duration_sec=3, error={"k": ["é"]}), ensure_ascii=False).encode()
            entry = tarfile.TarInfo(f"de_{i + 1}.json")
            entry.size = len(raw_bytes)
            archive.addfile(entry, io.BytesIO(raw_bytes))
    rows = {r.file_utt_id: r for r in raw.read_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"broken", "list", *(f"de_{i}" for i in range(6))}
    assert rows["de_3"].retries == 2 and rows["de_3"].duration_sec == 3.0 and rows["de_3"].error == '{"k":["é"]}' and rows["de_5"].text is None and rows["broken"].utt_id is None is rows["list"].text
    assert raw.read_records(spark, str(tmp_path), lang="fr").count() == 0 == raw.read_records(spark, str(tmp_path / "nothing")).count()


def test_filters_choose_folders(spark, root):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = raw.read_records(spark, root).where("engine_key = 'two' and track in ('a', 'b') and length(text) > 2")
        plan = rows._jdf.queryExecution().toString()
        assert "engine_key" in plan.split("PushedFilters")[-1][:200] and rows.count() == 3
        assert {r.engine_key for r in rows.collect()} == {"two"}
        assert raw.read_records(spark, root, engine="one").where("engine_key = 'two'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = records.FilteredReader({"path": root})
    left = list(reader.pushFilters([records.EqualTo(("engine_key",), "two"), records.In(("lang_key",), ("de", "fr")), records.EqualTo(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)] and all(p[0] == "two" for s in reader.partitions() for p in s.parts)


def test_small_files_are_packed(spark, root):
    one, many = (records.RecordReader({"path": root, "splitbytes": n}).partitions() for n in ("100000000", str(3 * (records.OPEN_COST + 1000))))
    assert len(one) == 1 and len(many) == 4 and sorted(n for s in many for p in s.parts for n, _ in p[3]) == sorted(n for s in one for p in s.parts for n, _ in p[3])


def test_written_records_come_back(spark, tmp_path, monkeypatch):
    rows = [(e, "a", lang, f"{lang}_{i:04d}", f"text {i}", None if i % 3 else "é", i) for e in ("one", "two") for lang in ("de", "fr") for i in range(50)]
    df = spark.createDataFrame(rows, "engine_key string, track string, lang_key string, file_utt_id string, text string, ref_text_raw string, retries int").repartition(4)
    root = str(tmp_path / "out")
    records.write_records(df, root)
    back = lambda: sorted(tuple(r) for r in raw.read_records(spark, root).select(*df.columns).collect())
    assert back() == sorted(rows, key=lambda r: r[:4])
    names = [str(p) for p in (tmp_path / "out").rglob("*.tar")]
    assert 4 <= len(names) <= 16 and not list((tmp_path / "out").rglob("_*"))
    records.write_records(df.where("engine_key = 'one'"), root)  # replaces all
    assert back() == sorted((r for r in rows if r[0] == "one"), key=lambda r: r[:4])
    records.write_records(df.where("engine_key = 'two'"), root, "append")
    assert back() == sorted(rows, key=lambda r: r[:4])
    # a write that fails leaves neither data nor halves of it
    bad = df.withColumn("file_utt_id", F.when(F.col("retries") == 30, "a/b").otherwise(F.col("file_utt_id")))
    with pytest.raises(Exception, match="no name for a record"):
        records.write_records(bad, root, "append")
    assert back() == sorted(rows, key=lambda r: r[:4]) and not list((tmp_path / "out").rglob("_*"))


def test_archives_are_cut(tmp_path):
    import pyarrow as pa

    writer = records.RecordWriter({"path": str(tmp_path), "archivebytes": "4000"}, False)
    batch = pa.RecordBatch.from_pydict({"engine_key": ["e"] * 30, "track": ["a"] * 30, "lang_key": ["de"] * 30, "file_utt_id": [f"u{i}" for i in range(30)], "json": ['{"text":"x"}'] * 30})
    message = writer.write(iter([batch]))
    assert len(message.files) >= 3 and not list(tmp_path.rglob("records*"))
    writer.abort([message, None])
    assert not list(tmp_path.rglob("*.tar"))


def test_stream_takes_each_file_once(spark, tmp_path):
    root = tmp_path / "in"

    def add(i):
        at = root / "one" / "a" / "de"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"de_{i}.json").write_text(json.dumps(record(f"t{i}")))

    def run():
        query = incremental.read_stream(spark, str(root), settle=0).select("file_utt_id", "text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.file_utt_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add(1)
    add(2)
    assert run() == ["de_1", "de_2"]
    add(3)
    assert run() == ["de_1", "de_2", "de_3"] == run()


@pytest.fixture
def elsewhere(spark, tmp_path):
    """A scheme that is not that of local files, over a folder."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    (tmp_path / "store").mkdir()
    name = f"x{uuid.uuid4().hex}"  # file systems are kept by name
    conf.set(f"fs.viewfs.mounttable.{name}.link./data", f"file:{tmp_path}/store")
    yield f"viewfs://{name}/data", tmp_path / "store"


def test_writes_on_another_file_system(spark, elsewhere):
    root, folder = elsewhere
    sinks.write_document({"tracks": {"é": 1}}, f"{root}/deep/down/scores.json")
    assert (folder / "deep/down/scores.json").read_text() == '{\n  "tracks": {\n    "é": 1\n  }\n}\n'
    sinks.write_document({"tracks": {}}, f"{root}/deep/down/scores.json")  # replaced in one step
    assert files.read_json(spark, f"{root}/deep/down/scores.json") == {"tracks": {}}
    size = sinks.copy_file(f"{root}/deep/down/scores.json", f"{root}/other/copy.json")
    one, two = files.digests(spark, f"{root}/deep/down/scores.json", f"{root}/other/copy.json").collect()
    assert size == one.length == two.length == len((folder / "other/copy.json").read_bytes()) and one.sha256 == two.sha256
    sinks.write_parquet(spark.range(100), f"{root}/table", "id")
    assert spark.read.parquet(f"{root}/table").count() == 100 and files.exists(spark, f"{root}/table/_ranges.json")
    assert files.delete(spark, f"{root}/deep") and not files.exists(spark, f"{root}/deep/down/scores.json")


def test_a_write_that_fails_leaves_nothing(spark, elsewhere, monkeypatch):
    root, folder = elsewhere
    sinks.write_document({"a": 1}, f"{root}/scores.json")

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(files, "_put", fail)
    with pytest.raises(RuntimeError):
        sinks.write_document({"a": 2}, f"{root}/scores.json")
    with pytest.raises(RuntimeError):
        sinks.copy_file(f"{root}/scores.json", f"{root}/copy.json")
    assert sorted(p.name for p in folder.iterdir() if p.suffix != ".crc") == ["scores.json"] and json.loads((folder / "scores.json").read_text()) == {"a": 1}


def test_parquet_in_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(600_000).select((F.col("id") * 7919 % 600_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_parquet(df, path, "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(p.name for p in (tmp_path / "t").glob("*.parquet"))
    assert len(names) == 4
    rows = [r.k for name in names for r in spark.read.parquet(f"{path}/{name}").select("k", F.monotonically_increasing_id().alias("m")).orderBy("m").collect()]
    assert rows == list(range(600_000))
    ranges = json.loads((tmp_path / "t" / "_ranges.json").read_text())
    assert [r["file"] for r in ranges] == names and sum(r["rows"] for r in ranges) == 600_000
    assert all(a["last"]["k"] < b["first"]["k"] for a, b in zip(ranges, ranges[1:]))
    # pages as the file's own index of them tells: whole ones hold 1 MiB, not 20,000 rows
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.parquet.hadoop
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"{path}/{names[0]}"), conf))
    column = reader.getFooter().getBlocks().get(0).getColumns().get(1)
    index = reader.readOffsetIndex(column)
    firsts = [index.getFirstRowIndex(i) for i in range(index.getPageCount())]
    reader.close()
    assert len(firsts) > 2 and str(column.getCodec()) == "ZSTD" and all(0.9 * 2**20 < (b - a) * 68 < 1.1 * 2**20 for a, b in zip(firsts, firsts[1:]))


def test_transcriptions(spark, root):
    table = raw.transcriptions(raw.read_records(spark, root))
    row = table.where("engine = 'one'").first()
    assert row.params_json == '{"a": {"z": "é"}, "b": 1, "model": "m1"}' and row.model_id == "m1" and row.error is None
    with pytest.raises(checks.CheckFailed):
        checks.require_not_null(table, "hypothesis")
    checks.require_cells(table, 2, 6)
    with pytest.raises(checks.CheckFailed):
        checks.require_cells(table, 2, 200)


def test_evaluation_to_documents(spark, root, tmp_path):
    records = raw.read_records(spark, root)
    cells = score.cell_table(score.score_utterances(records), n=300)
    document = sinks.score_document(cells)
    node = document["tracks"]["a"]["de"]
    assert node["headline_metric"] == "wer" and node["tie_groups"][0] == ["one"]
    one, two = node["engines"]["one"], node["engines"]["two"]
    assert one["cer"]["corpus_rate"] == 0.0 and one["n_utterances"] == 6 and two["empty_transcripts"] == 2
    assert two["wer"]["corpus_rate"] == round((3 + 3 + 2 + 1 + 3 + 0) / 18, 6)
    assert one["rtf_p50"] == 0.5 and one["model_ids"] == ["m1"] and one["run_dates"] == ["2026-07-05"]
    path = str(tmp_path / "out" / "scores.json")
    sinks.write_document(document, path)
    first = open(path, "rb").read()
    sinks.write_document(sinks.score_document(cells), path)
    assert open(path, "rb").read() == first and first.endswith(b"}\n")
    back = raw.read_scores(spark, path)
    assert {r.engine: r.wer.corpus_rate for r in back.collect()} == {e: node["engines"][e]["wer"]["corpus_rate"] for e in ("one", "two")}
    assert sinks.summary(document)[0].startswith("a/de (WER): T1[one=0.0000]")
    assert "<h2>de (WER)</h2>" in sinks.leaderboard_html(document, "a & b")
    flat = score.cell_scores(cells)
    assert [r.engine for r in flat.collect()] == ["one", "two"] and flat.columns[0] == "lang"
    sinks.write_parquet(flat, str(tmp_path / "cells"), "lang", "engine")
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 2
    assert score.both_whitespace_modes(records).count() == 4


def test_pairing(spark):
    df = spark.createDataFrame([("a", "de", "one", "u1"), ("a", "de", "one", "u2"), ("a", "de", "two", "u1")], "track string, lang string, engine string, utt_id string")
    with pytest.raises(checks.CheckFailed):
        checks.paired(df)
    assert checks.paired(df, "intersect").count() == 2
    assert checks.paired(df.where("utt_id = 'u1'")).count() == 2
    assert checks.without_failed(df, df.where("engine = 'two'")).select("utt_id").collect()[0][0] == "u2"
    share = checks.failed_share(df, df.where("engine = 'two'")).first()
    assert (share.n_utterances, share.n_failed, share.flagged) == (2, 1, True)
    with pytest.raises(checks.CheckFailed):
        checks.require_same_keys(df.where("engine = 'one'"), df.where("engine = 'two'"), ["utt_id"])


def test_strings(spark, tmp_path):
    (tmp_path / "en.json").write_text('{"title": "{repo}: {k} engines"}')
    en = raw.read_strings(str(tmp_path), "en")
    assert raw.read_strings(str(tmp_path), "xx") == {}
    assert raw.template({}, en, "title", repo="r", k="3") == "r: 3 engines"


def test_audio(spark, tmp_path):
    quiet = audio.write_wav(np.array([[0.25], [-0.1], [0.0]]), 8000)
    (tmp_path / "a.wav").write_bytes(quiet)
    (tmp_path / "b.wav").write_bytes(audio.write_wav(np.zeros((4, 1)), 8000))
    rows = audio.normalize_wav(raw.read_wavs(spark, str(tmp_path))).orderBy("path").collect()
    assert abs(rows[0].scale - 2.0) < 1e-3 and rows[1].scale == 1.0
    with wave.open(io.BytesIO(rows[0].wav)) as f:
        assert f.getsampwidth() == 2 and f.getframerate() == 8000
    assert 0.45 <= np.abs(audio.read_wav(rows[0].wav)[0]).max() <= 0.55
    df = spark.createDataFrame([([0.25, -0.1],), ([0.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(audio.scale(F.col("x"))).collect()] == [2.0, 1.0, 1.0, 1.0]


def test_stream(spark, root):
    query = incremental.running_rates(incremental.read_stream(spark, root, settle=0)).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = {r.engine_key: r for r in spark.sql("SELECT * FROM rates").collect()}
    assert rows["one"].ref_len == 6 * 15 and rows["two"].errors > rows["one"].errors > 0


def test_stream_of_records_without_a_readable_timestamp(spark, tmp_path):
    folder = tmp_path / "one" / "a" / "x y"
    folder.mkdir(parents=True)
    (folder / "u1.json").write_text(json.dumps(record("abc", ref="abd", timestamp_utc=None)))
    (folder / "u2.json").write_text(json.dumps(record("abc", ref="abd", timestamp_utc="soon")))
    (folder / "u3.txt").write_text("no record")
    query = incremental.running_rates(incremental.read_stream(spark, str(tmp_path), settle=0), literal=True).writeStream.format("memory").queryName("late").outputMode("complete").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.sql("SELECT * FROM late").collect()
    assert [(r.lang_key, r.errors, r.ref_len) for r in rows] == [("x y", 2, 6)]


def wav(tag, depth, data, rate=8000):
    import struct

    form = struct.pack("<HHIIHH", tag, 1, rate, rate * depth // 8, depth // 8, depth)
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_kinds(spark):
    x = np.array([0.25, -0.5, 0.125])
    files = {"FLOAT": wav(3, 32, x.astype("<f4").tobytes()), "DOUBLE": wav(3, 64, x.astype("<f8").tobytes()), "PCM_16": wav(1, 16, (x * 32768).astype("<i2").tobytes()), "PCM_32": wav(1, 32, (x * 2**31).astype("<i4").tobytes()), "PCM_U8": wav(1, 8, (x * 128 + 128).astype(np.uint8).tobytes())}
    for subtype, raw_bytes in files.items():
        assert audio.probe_wav(raw_bytes)[0] == subtype and np.allclose(audio.read_wav(raw_bytes)[0][:, 0], x)
    with pytest.raises(ValueError):
        audio.read_wav(b"RIFF")
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("none", None)], "name string, content binary")
    assert audio.check_wavs(df).first().asDict() == {"n_files": 6, "n_bad": 5}
    again = audio.normalize_wav(df).select("name", F.col("wav").alias("content"))
    assert audio.check_wavs(again).first().asDict() == {"n_files": 6, "n_bad": 1}


def test_pages(spark, tmp_path):
    rates = {"corpus_rate": 0.125, "ci95": [0.1, 0.15], "utterance_mean": 0.2}
    engine = {"n_utterances": 3, "empty_transcripts": 1, "cer": rates, "wer": None, "rtf_p50": 0.5, "rtf_p90": 1.0, "model_ids": ["m<1>"], "run_dates": ["2026-07-05"], "price_per_audio_hour_usd": 0.36}
    document = {"tracks": {"a": {"th": {"headline_metric": "cer", "tie_groups": [["b"], ["a"]], "engines": {"a": engine, "b": engine}}, "ja": {"headline_metric": "cer", "tie_groups": [["b"]], "engines": {"b": engine | {"rtf_p50": None, "price_per_audio_hour_usd": None}}}}}}
    with pytest.raises(FileNotFoundError):
        sinks.write_pages(document, "t", str(tmp_path), ["en"], str(tmp_path / "out"))
    (tmp_path / "en.json").write_text('{"engine": "Engine", "own_engine": "ours", "utterances": "clips"}')
    (tmp_path / "fr.json").write_text('{"engine": "Moteur"}')
    en, fr = (open(p, encoding="utf-8").read() for p in sinks.write_pages(document, "t", str(tmp_path), ["en", "fr"], str(tmp_path / "out"), names={"a": "A & Co"}, own=("b",)))
    assert en.index("<h2>ja") < en.index("<h2>th") and "<th>Engine<th>ja<th>th<th>#T1" in en and "<th>Moteur<th>ja" in fr and "3 clips" in fr
    assert en.index("<tr><th>b <em>ours</em>") < en.index("<tr><th>A &amp; Co<td>n/a") and "$0.360" in en and "0.50 / 1.00" in en and "m&lt;1&gt;" in en and "12.50 (10.00–15.00)" in en


def test_package(spark, tmp_path):
    folder, card = str(tmp_path / "out"), str(tmp_path / "card.md")
    rows = [(e, "de", f"u{i}", f"text {i}") for e in ("one", "two") for i in range(5)]
    texts = spark.createDataFrame(rows, "engine string, lang string, utt_id string, hypothesis string").repartition(3)
    cells = spark.createDataFrame([("one", "de", 5), ("two", "de", 5)], "engine string, lang string, n_utterances int")
    with pytest.raises(checks.CheckFailed, match="no card"):
        checks.write_package(texts, cells, folder, card)
    (tmp_path / "card.md").write_text("# card")
    assert checks.write_package(texts, cells, folder, card, rows=10, n_cells=2, each=5) == {"rows": 10, "cells": 2}
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/transcriptions").collect()] == sorted(rows) and (tmp_path / "out" / "card.md").read_text() == "# card"
    null = texts.withColumn("hypothesis", F.when(F.col("utt_id") != "u3", F.col("hypothesis")))
    other = spark.createDataFrame([("one", "de", 5), ("three", "de", 5)], cells.schema)
    uneven = spark.createDataFrame([("one", "de", 4), ("two", "de", 6)], cells.schema)
    for a, b, how, told in ((null, cells, {}, "null hypothesis: 2 rows, such as .*one.*u3"), (texts, other, {}, "three"), (texts, uneven, {}, "one"), (texts, uneven, {"each": 5}, "without 5"), (texts, cells, {"rows": 9}, "10 rows"), (texts, cells, {"n_cells": 3}, "2 cells")):
        with pytest.raises(checks.CheckFailed, match=told):
            checks.write_package(a, b, folder, card, **how)
        assert spark.read.parquet(f"{folder}/transcriptions").where("hypothesis is null").count() == 0 and not list((tmp_path / "out").glob("_staged*"))


def test_checks_need_one_job(spark):
    rules = [checks.Rule("odd", F.col("id") % 2 == 1, ("id",)), checks.Rule("large", F.col("id") > 100, ("id",))]
    rows, watch = checks.observed(spark.range(10), rules, total=F.sum("id"))
    rows.write.format("noop").mode("overwrite").save()
    with pytest.raises(checks.CheckFailed, match='odd: 5 rows, such as {"id":1}$'):
        checks.settle(watch, rules)
    assert watch.get["rows"] == 10 and watch.get["total"] == 45 and watch.get["n large"] == 0
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2), (None, 3)], [(None, 3), ("b", 2), ("a", 1)]))
    assert a.agg(*checks.key_digest(["k", "v"])).collect() == b.agg(*checks.key_digest(["k", "v"])).collect() != a.limit(2).agg(*checks.key_digest(["k", "v"])).collect()


def test_stream_of_corrections(spark, tmp_path):
    root, at = tmp_path / "in", tmp_path / "in" / "one" / "a" / "de"
    at.mkdir(parents=True)
    log = []

    def run():
        def keep(batch, _):
            log.extend(batch.collect())

        with settings(spark, spark__sql__streaming__stateStore__providerClass=incremental.STATE_STORE):
            rows = incremental.changes(incremental.read_stream(spark, str(root), settle=0))
            rows.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
        now = incremental.current(spark.createDataFrame(log, rows.schema))
        return {r.utt_id: (r.cer_errors, r.empty, r.timestamp_utc) for r in now.collect()}

    (at / "u1.json").write_text(json.dumps(record("der dritte Mann")))
    (at / "u2.json").write_text(json.dumps(record(None)))
    first = run()
    assert first["u1"][0] == 0 and first["u2"][1] and len(log) == 2
    (at / "again.json").write_text("{}")
    (at / "u1.json").write_text(json.dumps(record("der dritte Mann")))  # the same once more
    (at / "u2.json").write_text(json.dumps(record("der 3 Mann", timestamp_utc="2026-07-06T10:00:00Z")))
    second = run()
    assert second["u2"] == (0, False, "2026-07-06T10:00:00Z") and second["u1"] == first["u1"] and second["again"][1]
    assert sorted(r.sign for r in log) == [-1, 1, 1, 1, 1]


def test_texts_of_one_archive_are_compared_by_many_tasks(spark):
    row = [("e", "a", "en", "u", "two words", "two", 1.0, 1.0, "2026-07-05T00:00:00Z", "{}", None)]
    kind = "engine_key string, track string, lang_key string, file_utt_id string, ref_text_raw string, text string, latency_sec double, duration_sec double, timestamp_utc string, params string, file_time timestamp"
    rows = spark.createDataFrame(row, kind).coalesce(1)
    assert incremental.contributions(rows).rdd.getNumPartitions() >= 4
    plan = incremental.running_rates(rows, literal=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition " in plan


def test_corrections_in_any_order_are_netted_by_built_in_state(spark, tmp_path):
    kind = "engine_key string, track string, lang_key string, file_utt_id string, ref_text_raw string, text string, latency_sec double, duration_sec double, timestamp_utc string, params string, file_time timestamp"
    log = []

    def feed(*rows):
        made = [("e", "a", "de", None, "eins zwei drei", text, 1.0, None, "2026-07-05T00:00:00Z", None, datetime(2026, 7, day)) for day, text in rows]
        spark.createDataFrame(made, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changed = incremental.changes(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        assert "TransformWithState" not in changed._jdf.queryExecution().analyzed().toString()
        got = []
        with settings(spark, spark__sql__streaming__stateStore__providerClass=incremental.STATE_STORE):
            changed.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda batch, _: got.extend(batch.collect())).start().awaitTermination()
        log.extend(got)
        now = [r.empty for r in incremental.current(spark.createDataFrame(log, changed.schema)).collect()]
        return sorted((r.sign, r.empty) for r in got), now

    assert feed((2, ""), (3, "eins zwei drei")) == ([(1, False)], [False])
    assert feed((1, "")) == ([], [False])  # an older one that comes late
    assert feed((4, "eins zwei drei")) == ([], [False])  # newer and the same
    assert feed((6, ""), (5, "eins")) == ([(-1, False), (1, True)], [True])
    assert feed((7, "eins zwei drei")) == ([(-1, True), (1, False)], [False])
