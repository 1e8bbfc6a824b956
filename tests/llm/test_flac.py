import hashlib
import zlib

import numpy as np
import pytest
from helpers import clashing, empty, odd, odd_rows

from textgauge.llm import flac


def payloads():
    rng = np.random.default_rng(1)
    wave = (128 + 100 * np.sin(np.arange(576 * 200) / 40)).astype(np.uint8)
    return [flac.pad(t)[1] for t in (None, "", "hello world " * 500, "é" * 1000)] + [rng.integers(0, 256, 1728, dtype=np.uint8).tobytes(), bytes([7]) * 1152, ((np.arange(576 * 70) // 3) % 256).astype(np.uint8).tobytes(), wave.tobytes(), (rng.integers(0, 2, 1152, dtype=np.uint8) * 255).tobytes()]


def test_round_trip_by_both_readers():
    data = payloads()
    streams = flac.encode(data)
    assert flac.decode_bytes(streams) == data
    for raw, stream in zip(data, streams, strict=True):
        info, samples = flac.decode_any(stream)
        assert (samples[:, 0] + 128).astype(np.uint8).tobytes() == raw and info["rate"] == flac.RATE and info["total"] == len(raw)
    assert all(len(s) < 2 * len(d) for s, d in zip(streams, data, strict=True)) and len(streams[7]) < len(data[7]) / 2


def test_seeking():
    stream, raw = flac.encode([payloads()[7]])[0], payloads()[7]
    for at in (0, 1, 575, 576, 36_864, 70_000, len(raw) - 1):
        assert (flac.decode_any(stream, at)[1][:, 0] + 128).astype(np.uint8).tobytes() == raw[at:]


@pytest.mark.parametrize("where", [30, 90, 200, -30, -1])
def test_damage_is_noticed(where):
    stream = bytearray(flac.encode([payloads()[2]])[0])
    stream[where] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode_bytes([bytes(stream)])


def test_cut_short():
    stream = flac.encode([payloads()[2]])[0]
    for n in (3, 20, 100, len(stream) - 5):
        with pytest.raises(flac.FlacError):
            flac.decode_bytes([stream[:n]])


class Writer:
    """Bits of a stream, written by hand."""

    def __init__(self):
        self.bits = ""

    def put(self, n, width):
        self.bits += f"{n & ((1 << width) - 1):0{width}b}" if width else ""

    def rice(self, r, k):
        z = (r << 1) ^ (r >> 63)
        self.bits += "0" * (z >> k) + "1"
        self.put(z, k)

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def frame(size, channels, subframes, depth_code=4):
    head = Writer()
    for n, width in ((0x3FFE, 14), (0, 1), (0, 1), (7, 4), (0, 4), (channels, 4), (depth_code, 3), (0, 1), (0, 8), (size - 1, 16)):
        head.put(n, width)
    raw = head.bytes()
    raw += bytes([flac.crc8(raw)])
    body = Writer()
    for write in subframes:
        write(body)
    raw += body.bytes()
    crc = int(flac.crc16_many(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])
    return raw + crc.to_bytes(2, "big")


def stream_of(frames, channels, depth, total):
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def test_linear_predictor_partitions_and_escape():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.integers(-50, 50, 16)).tolist()
    coefs, shift = [3, -1], 1
    res = [x[i] - ((coefs[0] * x[i - 1] + coefs[1] * x[i - 2]) >> shift) for i in range(2, 16)]

    def lpc(w):
        w.put(0, 1), w.put(32 + 1, 6), w.put(0, 1)
        for v in x[:2]:
            w.put(v, 16)
        w.put(4, 4), w.put(shift, 5)
        for c in coefs:
            w.put(c, 5)
        w.put(1, 2), w.put(1, 4)  # five-bit parameters, two partitions
        w.put(3, 5)
        for r in res[:6]:
            w.rice(r, 3)
        w.put(31, 5), w.put(12, 5)  # escape: plain 12-bit numbers
        for r in res[6:]:
            w.put(r, 12)

    _, got = flac.decode_any(stream_of([frame(16, 0, [lpc])], 1, 16, 16))
    assert got[:, 0].tolist() == x


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
def test_stereo_and_wasted_bits(assignment):
    rng = np.random.default_rng(assignment)
    left, right = (rng.integers(-2000, 2000, 16) * 4 for _ in range(2))
    first, second = {1: (left, right), 8: (left, left - right), 9: (left - right, right), 10: ((left + right) >> 1, left - right)}[assignment]

    def verbatim(values, depth, wasted):
        def write(w):
            w.put(0, 1), w.put(1, 6), w.put(int(wasted > 0), 1)
            if wasted:
                w.put(1, wasted)
            for v in values.tolist():
                w.put(v >> wasted, depth - wasted)

        return write

    depths = {1: (16, 16), 8: (16, 17), 9: (17, 16), 10: (16, 17)}[assignment]
    _, got = flac.decode_any(stream_of([frame(16, assignment, [verbatim(first, depths[0], 0), verbatim(second, depths[1], 2)])], 2, 16, 16))
    assert got[:, 0].tolist() == left.tolist() and got[:, 1].tolist() == right.tolist()


def test_columns(spark):
    df = clashing(odd(spark))
    stored = flac.store_media(df)
    rows = flac.media_features(stored).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        n, raw = flac.pad(r.text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and r.payload_bytes % 576 == 0
    same = [tuple(r)[-7:] for r in rows if r.doc_id in (1, 3)]
    assert same[0] == same[1]
    blocks = flac.pcm_blocks(stored).where("doc_id = 7").orderBy("block_no").collect()
    assert b"".join(b.pcm for b in blocks) == flac.pad(odd_rows()[6][1])[1] and [b.sample_offset for b in blocks] == [576 * i for i in range(len(blocks))]
    assert flac.media_features(flac.store_media(empty(spark))).count() == 0


def test_null_and_damaged_media(spark):
    good, other = flac.encode([flac.pad("some text " * 300)[1], flac.pad("")[1]])
    bad = good[:-20] + bytes([good[-20] ^ 1]) + good[-19:]
    rows = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(bad)), (4, bytearray(b"no stream")), (5, bytearray(other)), (5, bytearray(other))], "doc_id long, media binary").coalesce(1)
    got = {r.doc_id: r for r in flac.media_features(rows).collect()}
    assert got[1].media_error is None and got[1].n_blocks == -(-3000 // 576) and got[1].last_offset == (got[1].n_blocks - 1) * 576
    assert got[5].n_blocks == 1 and got[5].last_offset == 0
    assert got[2].media_error is None and got[2].payload_bytes is None and got[2].media_bytes is None
    assert all(got[k].media_error and got[k].payload_sha256 is None and got[k].media_bytes for k in (3, 4))
    assert [(r.block_no, r.sample_offset, r.n_samples) for r in flac.pcm_blocks(rows.where("doc_id = 1")).orderBy("block_no").collect()] == [(i, 576 * i, 576) for i in range(got[1].n_blocks)]


def test_feature_against_a_loop(spark):
    text = "Noise and words, ünï, 12345! " * 90
    row = flac.media_features(flac.store_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    samples = [b - 128 for b in flac.pad(text)[1]]
    energies = [sum(x * x for x in samples[i : i + 576]) for i in range(0, len(samples), 576)]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
    assert row.feature == f"n={len(samples)};sum={sum(samples)};energy={sum(energies)};peak={max(map(abs, samples))};loudest={energies.index(max(energies))};crossings={crossings}"


def test_last_block_is_that_of_the_whole():
    streams = flac.encode([flac.pad("x" * n)[1] for n in (0, 576, 40_000)] + [flac.pad("".join(chr(33 + i * i % 90) for i in range(90_000)))[1]])
    for whole, (at, block) in zip(flac.decode_bytes(streams), flac.last_blocks(streams)):
        assert at == len(whole) - 576 and block == whole[at:]
