"""FLAC streams as a media column: encode, verify and decode, with seekable sample offsets.

The decoder reads any mono or stereo FLAC stream of up to 24 bits: constant, verbatim, fixed and
linear-predictor subframes, both Rice coding methods and escape codes, wasted bits, stereo
decorrelation; it checks the CRC-8 of each header, the CRC-16 of each frame and the MD5 of the
samples. Streams of fixed mono 8-bit frames, as the encoder here writes them, take a path that
decodes many frames at a time: all frames advance together, one sample a step.

The encoder writes mono 8-bit frames of 576 samples, each with the fixed predictor (order 0 to 4)
and Rice parameter that give the fewest bits, or verbatim where that is shorter, and a seek table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import sliced, text_udf

BLOCK = 576
RATE = 8000
#: A seek point for every so many frames; fixed here, so that a stream's size follows its length.
SEEK_EVERY = 64
#: Frames encoded or decoded together.
TOGETHER = 4096


class FlacError(ValueError):
    """A stream that is no FLAC, is cut short or fails a checksum."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, full, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & full
        out.append(crc)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def crc16_many(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of `flat`, all spans advancing together."""
    order = np.argsort(-sizes, kind="stable")
    at, left, crc = starts[order].copy(), sizes[order], np.zeros(len(starts), np.uint16)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")  # spans longer than each step
    for n in live.tolist():
        c = crc[:n]
        crc[:n] = (c << 8) ^ CRC16[(c >> 8) ^ flat[at[:n]]]
        at[:n] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def utf8_number(n: int) -> bytes:
    """The variable-length code of frame numbers (UTF-8 carried on to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(0xFE & ~(2 * room + 1)) & 0xFF | n, *reversed(tail)])


_headers: dict[int, bytes] = {}


def frame_header(number: int) -> bytes:
    """Fixed block size of 576 (code 2), rate from STREAMINFO, mono, 8 bits; with its CRC-8."""
    if (known := _headers.get(number)) is None:
        head = b"\xff\xf8\x20\x02" + utf8_number(number)
        known = head + bytes([crc8(head)])
        if number < 65536:
            _headers[number] = known
    return known


def _encode_frames(samples: np.ndarray) -> list[bytes]:
    """The subframes (with padding, without header and CRC-16) of rows of 576 samples."""
    n = len(samples)
    diffs = [samples]
    for _ in range(4):
        diffs.append(np.diff(diffs[-1], axis=1))
    best = np.full(n, 8 + 8 * BLOCK)  # verbatim
    order, param = np.full(n, -1), np.zeros(n, np.int64)
    constant = (samples == samples[:, :1]).all(axis=1)
    folded = []
    for o, r in enumerate(diffs):
        z = ((r << 1) ^ (r >> 15)).astype(np.uint16)
        folded.append(z)
        highest = z.max(axis=1)
        for k in range(9):
            bits = 8 + 8 * o + 6 + 4 + (z >> k).sum(axis=1, dtype=np.int64) + (k + 1) * z.shape[1]
            better = (bits < best) & (highest >> k < 16)  # short unary runs, for the decoder's sake
            best[better], order[better], param[better] = bits[better], o, k
    out: list[bytes] = [b""] * n
    for i in np.flatnonzero(constant):
        out[i] = bytes([0, samples[i, 0] & 0xFF])
    order[constant] = -2
    for i in np.flatnonzero(order == -1):
        out[i] = b"\x02" + (samples[i] & 0xFF).astype(np.uint8).tobytes()
    for o in range(5):
        for k in np.unique(param[order == o]):
            rows = np.flatnonzero((order == o) & (param == k))
            z = folded[o][rows].astype(np.int64)
            head = 8 + 8 * o + 10
            ends = np.cumsum((z >> k) + 1, axis=1) + k * np.arange(1, z.shape[1] + 1)
            size = (head + ends[:, -1] + 7) >> 3
            base = np.concatenate(([0], np.cumsum(size)[:-1])) * 8
            bits = np.zeros(int(size.sum()) * 8, np.uint8)
            bits[base[:, None] + np.arange(8)] = [int(b) for b in f"{0x10 | o << 1:08b}"]  # fixed predictor of this order
            for w in range(o):
                bits[base[:, None] + 8 + 8 * w + np.arange(8)] = np.unpackbits((samples[rows, w] & 0xFF).astype(np.uint8)[:, None], axis=1)
            bits[base[:, None] + 8 + 8 * o + np.arange(10)] = [int(b) for b in f"{int(k):010b}"]  # method 0, one partition, parameter
            at = (base[:, None] + head + ends).ravel()  # one past each code
            bits[at - 1 - k] = 1
            flat = z.ravel()
            for j in range(int(k)):
                bits[at - 1 - j] = (flat >> j) & 1
            packed = np.packbits(bits).tobytes()
            for i, b, s in zip(rows.tolist(), (base // 8).tolist(), size.tolist(), strict=True):
                out[i] = packed[b : b + s]
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes are unsigned 8-bit samples (stored less 128).

    Each length must be a positive multiple of 576.
    """
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError("a payload must hold whole blocks")
    counts = [len(p) // BLOCK for p in payloads]
    flat = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    bodies: list[bytes] = []
    for at in range(0, len(flat), TOGETHER):
        bodies += _encode_frames(flat[at : at + TOGETHER])
    frames = [frame_header(i) + body for i, body in zip((i for n in counts for i in range(n)), bodies, strict=True)]
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    crcs = crc16_many(np.frombuffer(b"".join(frames), np.uint8), np.cumsum(sizes) - sizes, sizes)
    out, at = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        whole = [f + struct.pack(">H", c) for f, c in zip(frames[at : at + n], crcs[at : at + n].tolist(), strict=True)]
        at += n
        lengths = list(map(len, whole))
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offsets = np.cumsum([0, *lengths[:-1]]).tolist()
        seek = b"".join(struct.pack(">QQH", i * BLOCK, offsets[i], BLOCK) for i in range(0, n, SEEK_EVERY))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(whole))
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise FlacError("the stream is cut short")
        word = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _subframe(bits: _Bits, size: int, depth: int) -> list[int]:
    """One channel's samples, from any kind of subframe."""
    if bits.take(1):
        raise FlacError("a subframe's padding bit is set")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            coefs, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        else:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise FlacError("a linear predictor is out of range")
            coefs = [bits.signed(precision) for _ in range(order)]
        method = bits.take(2)
        if method > 1:
            raise FlacError("a residual coding method is unknown")
        parts = bits.take(4)
        if size % (1 << parts) or (size >> parts) < order:
            raise FlacError("a partition order does not fit its block")
        for part in range(1 << parts):
            width = 5 if method else 4
            k, n = bits.take(width), (size >> parts) - (order if not part else 0)
            raw = bits.take(5) if k == (1 << width) - 1 else None
            for _ in range(n):
                if raw is not None:
                    r = bits.signed(raw)
                else:
                    z = bits.unary() << k | (bits.take(k) if k else 0)
                    r = (z >> 1) ^ -(z & 1)
                out.append(r + (sum(c * out[-1 - i] for i, c in enumerate(coefs)) >> shift))
    else:
        raise FlacError("a subframe type is reserved")
    return [x << wasted for x in out] if wasted else out


def _metadata(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO and seek points, and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, info = 4, False, {"seek": []}
    while not last:
        if at + 4 > len(stream):
            raise FlacError("the metadata are cut short")
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("the metadata are cut short")
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            info |= {"block": struct.unpack(">HH", body[:4]), "rate": x >> 44, "channels": (x >> 41 & 7) + 1, "depth": (x >> 36 & 31) + 1, "total": x & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            info["seek"] = [p[:2] for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    if "rate" not in info:
        raise FlacError("there is no STREAMINFO")
    return info, at


def _any_frame(stream: bytes, at: int, info: dict) -> tuple[np.ndarray, int]:
    """One frame of any kind: samples (size, channels) and where the next begins."""
    bits = _Bits(stream, at)
    if bits.take(15) != 0x7FFC:
        raise FlacError("a frame's sync code is missing")
    bits.take(1)
    size_code, rate_code, channels, depth_code, _ = (bits.take(n) for n in (4, 4, 4, 3, 1))
    first = bits.take(8)
    while first & 0xC0 == 0xC0:  # as many more bytes as the first has leading ones, less one
        bits.take(8)
        first = first << 1 & 0xFF
    if size_code in (6, 7):
        size = bits.take(8 * (size_code - 5)) + 1
    else:
        size = {0: 0, 1: 192}.get(size_code, 576 << (size_code - 2) if size_code <= 5 else 256 << (size_code - 8))
    if rate_code in (12, 13, 14):
        bits.take(8 if rate_code == 12 else 16)
    head = stream[at : bits.at // 8]
    if crc8(head) != bits.take(8):
        raise FlacError("a frame header fails its checksum")
    depth = [info["depth"], 8, 12, 0, 16, 20, 24, 32][depth_code]
    if channels < 8:
        out = [_subframe(bits, size, depth) for _ in range(channels + 1)]
    else:
        wide = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(channels)
        if wide is None:
            raise FlacError("a channel assignment is reserved")
        a, b = (np.array(_subframe(bits, size, depth + w), np.int64) for w in wide)
        if channels == 8:
            out = [a, a - b]
        elif channels == 9:
            out = [a + b, b]
        else:
            mid = (a << 1) | (b & 1)
            out = [(mid + b) >> 1, (mid - b) >> 1]
    end = (bits.at + 7) // 8
    if end + 2 > len(stream):
        raise FlacError("the stream is cut short")
    crc = int(crc16_many(np.frombuffer(stream, np.uint8), np.array([at]), np.array([end - at]))[0])
    if crc != int.from_bytes(stream[end : end + 2], "big"):
        raise FlacError("a frame fails its checksum")
    return np.array(out, np.int64).T, end + 2


def decode_any(stream: bytes, start_sample: int = 0) -> tuple[dict, np.ndarray]:
    """Metadata and samples (n, channels) from the frame that holds `start_sample` on, by the seek table where it helps.

    A read from sample 0 also checks the MD5 of all samples, where the stream has one.
    """
    info, base = _metadata(stream)
    at, sample, out = base, 0, []
    for point, offset in info["seek"]:
        if point <= start_sample:
            at, sample = base + offset, point
    while at < len(stream):
        block, at = _any_frame(stream, at, info)
        if sample + len(block) > start_sample:
            out.append(block[max(0, start_sample - sample) :])
        sample += len(block)
    if info["total"] and sample != info["total"]:
        raise FlacError("the stream does not have the samples it declares")
    samples = np.concatenate(out) if out else np.zeros((0, info["channels"]), np.int64)
    if not start_sample and any(info["md5"]):
        width = (info["depth"] + 7) // 8
        raw = samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
        if hashlib.md5(raw).digest() != info["md5"]:
            raise FlacError("the samples fail their MD5")
    return info, samples


_LEADING = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


def _decode_frames(flat: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 576 samples of 8-bit mono frames whose subframes begin at starts + heads, and where each ends.

    Rows that this fast path cannot read (unknown kinds, very long unary runs) have end -1.
    """
    n = len(starts)
    samples, ends = np.zeros((n, BLOCK), np.int64), np.full(n, -1, np.int64)
    at = starts + heads
    kind = flat[at].astype(np.int64)
    constant, verbatim = kind == 0, kind == 2
    samples[constant] = flat[at[constant] + 1].astype(np.int8).astype(np.int64)[:, None]
    ends[constant] = at[constant] + 2
    if verbatim.any():
        samples[verbatim] = flat[at[verbatim][:, None] + 1 + np.arange(BLOCK)].astype(np.int8)
        ends[verbatim] = at[verbatim] + 1 + BLOCK
    for order in range(5):
        rows = np.flatnonzero(kind == 0x10 | order << 1)
        if not len(rows):
            continue
        pos = at[rows] + 1
        warm = flat[pos[:, None] + np.arange(order)].astype(np.int8).astype(np.int64)
        pos = (pos + order) * 8
        byte = pos >> 3
        head = (flat[byte].astype(np.int64) << 8 | flat[byte + 1]) >> 6
        fine = (head >> 8 == 0) & ((head >> 4) & 15 == 0) & (head & 15 != 15)
        rows, pos, warm, k = rows[fine], pos[fine] + 10, warm[fine], (head & 15)[fine]
        if not len(rows):
            continue
        low, high = int(starts[rows].min()), int(starts[rows].max()) + 4 * BLOCK + 64
        part = np.zeros(high - low + 8, np.int64)
        have = flat[low : high + 8]
        part[: len(have)] = have
        words = part[:-4] << 32 | part[1:-3] << 24 | part[2:-2] << 16 | part[3:-1] << 8 | part[4:]  # 40 bits from each byte
        pos = pos - low * 8
        z = np.empty((BLOCK - order, len(rows)), np.int64)
        bad, limit = np.zeros(len(rows), bool), len(words) - 1
        for i in range(BLOCK - order):
            word = words[pos >> 3] << (pos & 7) & 0xFFFFFFFFFF
            q = _LEADING[word >> 24]
            bad |= q == 16
            z[i] = q << k | (word << (q + 1) & 0xFFFFFFFFFF) >> (40 - k)
            pos += q + 1 + k
            np.minimum(pos, limit * 8, out=pos)
        r = ((z >> 1) ^ -(z & 1)).T
        state = r
        for j in range(order):  # undo one difference after the other, from the highest
            first = warm.copy()
            for _ in range(order - 1 - j):
                first = np.diff(first, axis=1)
            first = first[:, :1] if first.shape[1] == j + 1 else first[:, j : j + 1]
            state = np.cumsum(np.concatenate((first, state), axis=1), axis=1)
        samples[rows] = state
        ends[rows] = np.where(bad, -1, ((pos + 7) >> 3) + low)
    return samples, ends


def decode_bytes(streams: list[bytes]) -> list[bytes]:
    """The unsigned 8-bit samples of mono 8-bit streams; every checksum is verified."""
    infos = [_metadata(s) for s in streams]
    slots, rest = [], {}
    for i, (stream, (info, base)) in enumerate(zip(streams, infos, strict=True)):
        if info["channels"] != 1 or info["depth"] != 8:
            raise FlacError("not a mono 8-bit stream")
        if info["block"] != (BLOCK, BLOCK) or not info["total"] or info["total"] % BLOCK:
            rest[i] = _slow(stream)
    flat = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    offsets = np.cumsum([0, *map(len, streams)])
    slots = [i for i in range(len(streams)) if i not in rest]
    found = {i: _frame_starts(streams[i], infos[i][1], infos[i][0]["total"] // BLOCK) for i in slots}
    for i in [i for i in slots if found[i] is None]:
        rest[i] = _slow(streams[i])
        slots.remove(i)
    if slots:
        starts = np.concatenate([found[i] + offsets[i] for i in slots])
        counts = [len(found[i]) for i in slots]
        heads = np.concatenate([np.fromiter((len(frame_header(k)) for k in range(n)), np.int64, n) for n in counts])
        stops = np.concatenate([np.append(found[i][1:], len(streams[i])) + offsets[i] for i in slots])
        rows, ends = [], []
        for at in range(0, len(starts), TOGETHER):
            a, b = _decode_frames(flat, starts[at : at + TOGETHER], heads[at : at + TOGETHER])
            rows.append(a.astype(np.int16))
            ends.append(b)
        samples, ends = np.concatenate(rows), np.concatenate(ends)
        crcs = crc16_many(flat, starts, stops - 2 - starts)
        stored = flat[stops - 2].astype(np.int64) << 8 | flat[stops - 1]
        fine = (ends == stops - 2) & (crcs == stored)
        at = 0
        for i, n in zip(slots, counts, strict=True):
            if fine[at : at + n].all():
                raw = samples[at : at + n].astype(np.int8)
                if hashlib.md5(raw.tobytes()).digest() != infos[i][0]["md5"]:
                    raise FlacError("the samples fail their MD5")
                rest[i] = (raw.view(np.uint8) ^ 0x80).tobytes()
            else:
                rest[i] = _slow(streams[i])
            at += n
    return [rest[i] for i in range(len(streams))]


def _slow(stream: bytes) -> bytes:
    return (decode_any(stream)[1][:, 0] + 128).astype(np.uint8).tobytes()


def _frame_starts(stream: bytes, base: int, n: int) -> np.ndarray | None:
    """Where the frames of a stream by `encode` begin; None if its headers are not found in order.

    A header (sync, codes, running number, CRC-8) is looked for behind the last one; one that data
    happen to imitate is noticed later, as the frame then fails its checksum and is read slowly.
    """
    out, at = [], base
    for number in range(n):
        at = stream.find(frame_header(number), at)
        if at < 0 or (not number and at != base):
            return None
        out.append(at)
        at += 6
    return np.array(out, np.int64)


def pad(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with 255 appended up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def _stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in sliced(batches):
        sizes, payloads = zip(*(pad(t.as_py()) for t in texts)) if len(texts) else ((), ())
        yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(_by_size(encode, payloads), pa.binary())], names=["n_bytes", "media"])


def _by_size(work, items, room: int = 4 << 20) -> list[bytes]:
    """work() over runs of items of about `room` bytes, so that memory does not follow the batch."""
    out, run, held = [], [], 0
    for item in items:
        run.append(item)
        held += len(item)
        if held >= room:
            out += work(run)
            run, held = [], 0
    return out + (work(run) if run else [])


def last_blocks(streams: list[bytes]) -> list[tuple[int, bytes]]:
    """Sample offset and samples of the last block of each stream by `encode`, found from its last seek point on and decoded by itself."""
    places = []
    for stream in streams:
        info, base = _metadata(stream)
        last = info["total"] // BLOCK - 1
        point, offset = max((p for p in info["seek"] if p[0] <= last * BLOCK), default=(0, 0))
        at = base + offset
        for number in range(point // BLOCK, last + 1):
            at = stream.find(frame_header(number), at if number == point // BLOCK else at + 6)
            if at < 0:
                raise FlacError("a frame is missing behind its seek point")
        places.append((last, at))
    offsets = np.cumsum([0, *map(len, streams)])[:-1]
    flat = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    starts = np.array([at for _, at in places], np.int64) + offsets
    heads = np.array([len(frame_header(n)) for n, _ in places], np.int64)
    samples, _ = _decode_frames(flat, starts, heads)
    return [(n * BLOCK, (row.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()) for (n, _), row in zip(places, samples, strict=True)]


def _read_back(streams: list[bytes]) -> list[tuple[bytes, int] | str]:
    """Payload and offset of the last block of each stream, or what is wrong with it."""
    try:
        whole, ends = decode_bytes(streams), last_blocks(streams)
    except FlacError as e:
        return [x for s in streams for x in _read_back([s])] if len(streams) > 1 else [str(e)]
    return [(p, at) if p[at:] == end else "the block at the last seek point is not that of the whole" for p, (at, end) in zip(whole, ends, strict=True)]


_FEATURES = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string(), "n_blocks": pa.int64(), "last_offset": pa.int64(), "media_error": pa.string()}


def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for media in sliced(batches):
        streams, rows = [m.as_py() for m in media], []
        found = iter(_by_size(_read_back, [m for m in streams if m is not None]))
        for stream in streams:
            got = None if stream is None else next(found)
            if not isinstance(got, tuple):
                rows.append((*[None] * 6, got))
                continue
            payload, at = got
            s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
            blocks = s.reshape(-1, BLOCK)
            energy = (blocks * blocks).sum(axis=1)
            text = f"n={len(s)};sum={int(s.sum())};energy={int(energy.sum())};peak={int(np.abs(s).max())};loudest={int(energy.argmax())};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), text, len(blocks), at, None))
        columns = list(zip(*rows)) if rows else [[]] * len(_FEATURES)
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _FEATURES.values(), strict=True)], names=list(_FEATURES))


def _blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The blocks of a medium as slices of its one payload, so that no object is made for each."""
    for media in sliced(batches, 64):
        for medium in media:
            payload = b"" if medium.as_py() is None else decode_bytes([medium.as_py()])[0]
            at = np.arange(0, len(payload), BLOCK, dtype=np.int64)
            ends = np.append(at, len(payload)).astype(np.int32)
            pcm = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(payload)])
            rows = pa.StructArray.from_arrays([pa.array(at), pa.array(np.diff(ends), pa.int32()), pcm], names=["sample_offset", "n_samples", "pcm"])
            yield pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), rows)


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_bytes (UTF-8, unpadded) and media, the FLAC stream of the padded text.

    A null text is stored like an empty one, as one block of padding; equal texts give equal streams.
    Columns of these names are replaced.
    """
    return docs.withColumn("__stored", text_udf(_stored, "struct<n_bytes:bigint,media:binary>")(F.col(text))).withColumns({"n_bytes": F.col("__stored.n_bytes"), "media": F.col("__stored.media")}).drop("__stored")


def media_features(stored: DataFrame, media: str = "media") -> DataFrame:
    """`stored` with what is computed from the samples read back: sizes, digests, a feature string, how many PCM blocks there
    are and the sample offset of the last, which is also sought and read by itself.

    A stream that is no FLAC or fails a checksum has nulls for these and says why in media_error, which
    is null for sound ones; a null medium has nulls throughout. Columns of these names are replaced.
    """
    made = stored.withColumn("__read", text_udf(_features, "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string,n_blocks:bigint,last_offset:bigint,media_error:string>")(F.col(media)))
    made = made.withColumns({name: F.col(f"__read.{name}") for name in _FEATURES})
    digest = {"media_bytes": F.octet_length(media).cast("bigint"), "media_sha256": F.sha2(media, 256)}
    return made.withColumns(digest).drop("__read")


def pcm_blocks(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per block: key, block_no, sample_offset, n_samples, pcm (unsigned 8-bit); null media give none, a damaged one stops the job."""
    rows = stored.select(F.col(key).alias(key), F.posexplode(text_udf(_blocks, "array<struct<sample_offset:bigint,n_samples:int,pcm:binary>>")(F.col(media))).alias("block_no", "b"))
    return rows.select(key, F.col("block_no").cast("bigint").alias("block_no"), "b.sample_offset", "b.n_samples", "b.pcm")
