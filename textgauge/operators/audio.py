"""Peak normalization of waveforms: of sample arrays by built-in expressions, of WAV files by an Arrow function."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: The peak aimed at, and the range that passes the check. Fixed values.
PEAK = 0.5
PASSES = (0.45, 0.55)


def peak(samples: Column) -> Column:
    """The greatest magnitude; 0 for no samples."""
    return F.coalesce(F.array_max(F.transform(samples, lambda v: F.abs(v))).cast("double"), F.lit(0.0))


def scale(samples: Column) -> Column:
    """What brings the peak to one half; 1 for silence."""
    p = peak(samples)
    return F.when(p > 0, F.lit(PEAK) / F.when(p > 0, p)).otherwise(F.lit(1.0))


def peak_normalized(samples: Column) -> Column:
    s = scale(samples)
    return F.transform(samples, lambda v: v.cast("double") * s)


def passes(subtype: Column, level: Column) -> Column:
    return (subtype == "PCM_16") & level.between(*PASSES)


def probe_wav(raw: bytes) -> tuple[str, int, int, bytes]:
    """Subtype (PCM_U8, PCM_16, PCM_24, PCM_32, FLOAT, DOUBLE), rate, channels and the bytes of the samples, from the chunks of a RIFF file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(raw) and data is None:
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            tag, channels, rate, _, _, depth = struct.unpack("<HHIIHH", body[:16])
            form = (int.from_bytes(body[24:26], "little") if tag == 0xFFFE else tag, channels, rate, depth)
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("the WAV file has no format or no data")
    tag, channels, rate, depth = form
    subtype = {(1, 8): "PCM_U8", (1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (3, 32): "FLOAT", (3, 64): "DOUBLE"}.get((tag, depth))
    if subtype is None:
        raise ValueError(f"WAV format {tag} of {depth} bits is not read")
    return subtype, rate, channels, data


def read_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1..1 (frames, channels) and the rate of integer or floating-point WAV."""
    subtype, rate, channels, data = probe_wav(raw)
    if subtype in ("FLOAT", "DOUBLE"):
        values = np.frombuffer(data, "<f4" if subtype == "FLOAT" else "<f8").astype(np.float64)
    else:
        width = {"PCM_U8": 1, "PCM_16": 2, "PCM_24": 3, "PCM_32": 4}[subtype]
        each = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, width)
        if width == 1:
            values = (each[:, 0].astype(np.int64) - 128) / 128
        else:
            wide = np.zeros((len(each), 4), np.uint8)
            wide[:, 4 - width :] = each
            values = wide.view("<i4")[:, 0] / 2**31
    return values[: len(values) // channels * channels].reshape(-1, channels), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of the same rate and channels."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(samples.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.rint(samples * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


_NORMALIZED = "struct<wav:binary,peak:double,scale:double,sample_rate:int,subtype:string>"


def _normalized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("wav", pa.binary()), ("peak", pa.float64()), ("scale", pa.float64()), ("sample_rate", pa.int32()), ("subtype", pa.string())])
    for files in batches:
        out = []
        for raw in files.to_pylist():
            if raw is None:
                out.append(None)
                continue
            samples, rate = read_wav(raw)
            top = float(np.abs(samples).max(initial=0))
            by = PEAK / top if top else 1.0
            out.append({"wav": write_wav(samples * by, rate), "peak": top, "scale": by, "sample_rate": rate, "subtype": probe_wav(raw)[0]})
        yield pa.array(out, kind)


def normalize_wav(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` (as the binaryFile source gives them) with wav, peak, scale, sample_rate and subtype (peak and subtype of what was read)."""
    made = files.withColumn("__n", arrow_udf(_normalized, _NORMALIZED)(F.col(content)))
    return made.select("*", "__n.*").drop("__n")


def _written(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for waves, rates in batches:
        yield pa.array([None if w is None else write_wav(np.array(w, np.float64).reshape(-1, 1), r) for w, r in zip(waves.to_pylist(), rates.to_pylist(), strict=True)], pa.binary())


def wav_bytes(samples: Column, rate: Column) -> Column:
    """A mono 16-bit WAV file of an array of samples; null for null."""
    return arrow_udf(_written, "binary")(samples, rate)


def check_wavs(files: DataFrame, content: str = "content", by: tuple[str, ...] = ()) -> DataFrame:
    """by, n_files and n_bad: files that are not 16-bit PCM or whose peak is out of range."""
    rows = normalize_wav(files, content)
    return rows.groupBy(*by).agg(F.count("*").alias("n_files"), F.count_if(~F.coalesce(passes(F.col("subtype"), F.col("peak")), F.lit(False))).alias("n_bad"))
