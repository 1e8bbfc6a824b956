"""Transcription records as a data source of its own: `spark.read.format("records")`, its stream and its sink.

Records lie under {root}/{engine}/{track}/{lang}, each as a file {utterance}.json, or many of them as members of that
name in an archive, {any}.tar; both kinds may stand side by side. Keys come from the path, never from the record. Folders are
listed by the driver, only those that the pushed filters and options leave; small files are packed into splits by bytes, so that the number of
tasks follows the size of the data and not the number of records. The sink writes archives.

Paths are opened through Arrow's file systems, in the executors' Python workers: local or mounted folders, and what Arrow knows
by URI (hdfs, s3, gs). Names that begin with a dot or an underscore are not data.
"""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, WriterCommitMessage

KEYS = ("engine_key", "track", "lang_key")
#: Top-level fields of a record as text; nested ones stay JSON, as their shapes differ by engine.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("utt_id", "lang", "engine", "ref_text_raw", "ref_text_normalized", "text", "timestamp_utc", "params", "error", "raw_response")]
    + [T.StructField(n, T.DoubleType()) for n in ("duration_sec", "latency_sec")]
    + [T.StructField("retries", T.IntegerType())]
)
SCHEMA = T.StructType([*RECORD, *(T.StructField(n, T.StringType()) for n in (*KEYS, "file_utt_id")), T.StructField("file_time", T.TimestampType())])
#: Bytes of a split, and what opening a file counts for; records of a batch; bytes after which the sink begins another archive.
SPLIT_BYTES, OPEN_COST, BATCH_ROWS, ARCHIVE_BYTES = 64 << 20, 64 << 10, 2000, 256 << 20


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def _list(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((f for f in found if f.base_name[:1] not in "._"), key=lambda f: f.base_name)


def cells(fs: pafs.FileSystem, base: str, wanted: dict[str, set[str] | None]) -> Iterator[tuple[str, str, str]]:
    """(engine, track, lang) of the folders that the wanted values leave, in order; a level whose values are all wanted by name is not listed."""

    def below(path: str, key: str) -> list[str]:
        names = wanted.get(key)
        if names is not None:
            infos = fs.get_file_info([posixpath.join(path, n) for n in sorted(names)])
            return [f.base_name for f in infos if f.type == pafs.FileType.Directory]
        return [f.base_name for f in _list(fs, path) if f.type == pafs.FileType.Directory]

    for engine in below(base, "engine_key"):
        for track in below(posixpath.join(base, engine), "track"):
            for lang in below(posixpath.join(base, engine, track), "lang_key"):
                yield engine, track, lang


@dataclass
class Split(InputPartition):
    """Files of some cells: (engine, track, lang, [(name, modification time in ns)])."""

    parts: list[tuple[str, str, str, list[tuple[str, int]]]] = field(default_factory=list)


def splits(files: Iterator[tuple[tuple[str, str, str], pafs.FileInfo]], most: int) -> list[Split]:
    """Files in order, packed up to `most` bytes."""
    out, held = [], most
    for cell, f in files:
        cost = (f.size or 0) + OPEN_COST
        if held + cost > most and (held or not out):
            out.append(Split())
            held = 0
        held += cost
        parts = out[-1].parts
        if not parts or parts[-1][:3] != cell:
            parts.append((*cell, []))
        parts[-1][3].append((f.base_name, f.mtime_ns or 0))
    return out


def _files(fs: pafs.FileSystem, base: str, wanted: dict) -> Iterator[tuple[tuple[str, str, str], pafs.FileInfo]]:
    for cell in cells(fs, base, wanted):
        for f in _list(fs, posixpath.join(base, *cell)):
            if f.type == pafs.FileType.File and f.base_name.endswith((".json", ".tar")):
                yield cell, f


def _value(x, kind: T.DataType):
    if x is None:
        return None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    return (float(x) if isinstance(kind, T.DoubleType) else int(x)) if number else None


def parsed(raw: bytes) -> list:
    """The fields of a record; all null for what is no JSON object."""
    try:
        found = json.loads(raw)
    except ValueError:
        found = None
    return [_value(found.get(f.name), f.dataType) if isinstance(found, dict) else None for f in RECORD]


def _records(fs: pafs.FileSystem, path: str, name: str) -> Iterator[tuple[str, bytes]]:
    """(utterance, content) of a file: itself, or the members of an archive, which is read from front to back."""
    if name.endswith(".json"):
        with fs.open_input_stream(path) as f:
            yield name.removesuffix(".json"), f.read()
        return
    with fs.open_input_stream(path) as f, tarfile.open(fileobj=f, mode="r|") as archive:
        for member in archive:
            if member.isfile() and member.name.endswith(".json"):
                yield posixpath.basename(member.name).removesuffix(".json"), archive.extractfile(member).read()


_ARROW = pa.schema([(f.name, pa.timestamp("us", "UTC") if isinstance(f.dataType, T.TimestampType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in SCHEMA])


def read_split(root: str, split: Split) -> Iterator[pa.RecordBatch]:
    fs, base = _open(root)
    rows: list[list] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for engine, track, lang, files in split.parts:
        for name, changed in files:
            for utterance, raw in _records(fs, posixpath.join(base, engine, track, lang, name), name):
                rows.append([*parsed(raw), engine, track, lang, utterance, changed // 1000])
                if len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()


def _wanted(options: dict) -> dict[str, set[str] | None]:
    return {k: {options[k]} if options.get(k, "*") != "*" else None for k in KEYS}


class RecordReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.wanted, self.most = options["path"], _wanted(options), int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        fs, base = _open(self.root)
        return splits(_files(fs, base, self.wanted), self.most) or [Split()]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return read_split(self.root, partition)


class FilteredReader(RecordReader):
    """For sessions that push filters down; others refuse a reader that could take them."""

    def pushFilters(self, filters):
        """Equality and membership of the keys choose folders; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                key, values = f.attribute[0], {v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
                self.wanted[key] = values if self.wanted[key] is None else self.wanted[key] & values
            else:
                yield f


class RecordStreamReader(DataSourceStreamReader):
    """New files in the order of their modification times. A file counts once it is `settle` seconds old, so that none that is
    written while folders are listed is passed over; the offset is the time up to which all files have been read."""

    def __init__(self, options: dict) -> None:
        self.root, self.wanted, self.most = options["path"], _wanted(options), int(options.get("splitbytes", SPLIT_BYTES))
        self.settle = float(options.get("settle", 2))

    def initialOffset(self) -> dict:
        return {"until": "0"}

    def latestOffset(self) -> dict:
        fs, base = _open(self.root)
        until = time.time_ns() - int(self.settle * 1e9)
        seen = [f.mtime_ns for _, f in _files(fs, base, self.wanted) if (f.mtime_ns or 0) <= until]
        return {"until": str(max(seen, default=0))}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        fs, base = _open(self.root)
        low, high = int(start["until"]), int(end["until"])
        return splits(((c, f) for c, f in _files(fs, base, self.wanted) if low < (f.mtime_ns or 0) <= high), self.most)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return read_split(self.root, partition)


@dataclass
class Written(WriterCommitMessage):
    """(name until commit, name after it) of the archives of a task."""

    files: list[tuple[str, str]]


class RecordWriter(DataSourceArrowWriter):
    """Archives under names that are no data until the job commits; rows are keys, file_utt_id and json, those of a cell together."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite = options["path"], overwrite
        self.most = int(options.get("archivebytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _open(self.root)
        files: list[tuple[str, str]] = []
        now, archive, out = None, None, None
        try:
            for batch in iterator:
                for *cell, utterance, content in zip(*(batch.column(n).to_pylist() for n in (*KEYS, "file_utt_id", "json")), strict=True):
                    if any(not x or x[0] in "._" or "/" in x for x in (*cell, utterance)):
                        raise ValueError(f"no name for a record: {(*cell, utterance)}")
                    if cell != now or out.tell() > self.most:
                        if archive is not None:
                            archive.close()
                            out.close()
                        folder, name = posixpath.join(base, *cell), f"records-{uuid.uuid4().hex}.tar"
                        fs.create_dir(folder, recursive=True)
                        files.append((f"{folder}/_{name}", f"{folder}/{name}"))
                        out = fs.open_output_stream(files[-1][0])
                        archive, now = tarfile.open(fileobj=out, mode="w|"), cell
                    raw = content.encode("utf-8", "surrogatepass")
                    entry = tarfile.TarInfo(f"{utterance}.json")
                    entry.size = len(raw)
                    archive.addfile(entry, io.BytesIO(raw))
            if archive is not None:
                archive.close()
                out.close()
        except BaseException:
            for temporary, _ in files:  # a task that fails takes its files with it
                fs.delete_file(temporary)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.root)
        old = [posixpath.join(base, *cell, f.base_name) for cell, f in _files(fs, base, {})] if self.overwrite else []
        for m in messages:
            for temporary, final in m.files if m else ():
                fs.move(temporary, final)
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _open(self.root)
        for m in messages:
            for temporary, _ in m.files if m else ():
                fs.delete_file(temporary)


class RecordSource(DataSource):
    """Options: path; engine_key, track, lang_key (a fixed value, or *); pushed (true: takes filters on these, where the session
    pushes them); splitBytes, archiveBytes; settle (seconds, stream)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> RecordReader:
        options = dict(self.options)
        return (FilteredReader if options.get("pushed") == "true" else RecordReader)(options)

    def streamReader(self, schema: T.StructType) -> RecordStreamReader:
        return RecordStreamReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format `records` known to a session."""
    spark.dataSource.register(RecordSource)


def write_records(records: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Records as archives by engine_key, track, lang_key; the other columns but file_utt_id are the fields, nulls left out.

    Rows of a cell are brought together, a large cell to several tasks. An archive has a name of no data until the job
    commits; with `overwrite` the files there were go after that.
    """
    register(records.sparkSession)
    fields = [c for c in records.columns if c not in (*KEYS, "file_utt_id")]
    rows = records.select(*KEYS, "file_utt_id", F.to_json(F.struct(*fields)).alias("json"))
    dealt = rows.hint("rebalance", *KEYS).sortWithinPartitions(*KEYS, "file_utt_id")
    dealt.write.format("records").mode(mode).save(root)
