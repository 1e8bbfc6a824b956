"""The published index stream, drawn in segments that know nothing of each other.

The stated generator is PCG64: its state can be advanced to any place in constant time. Bounded integers come from its
output like this: each 64-bit number gives two 32-bit ones, the low half first; u is mapped to u * size >> 32, and
thrown away where u * size mod 2^32 is less than 2^32 mod size. So the k-th index that is kept has no fixed place in the stream,
but a first pass that only counts what each segment keeps, and running totals of these counts, tell where every
segment's indexes belong. Sizes are below 2^32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Numbers of the generator handled at once; bounds memory.
_AT_ONCE = 1 << 20
#: Of these, numbers that are made, multiplied and sifted while they are in a core's cache.
_IN_CACHE = 1 << 15
#: A segment holds this many numbers at least, and so many for each utterance, so that sending utterances to segments costs less than drawing.
LEAST_NUMBERS, NUMBERS_EACH = 1 << 23, 128


def rejected(size: int) -> int:
    """Of 2^32 halves, how many are thrown away."""
    return (1 << 32) % size


def segment_numbers(size: int) -> int:
    """Numbers of the generator in a segment: a power of two."""
    return 1 << (max(LEAST_NUMBERS, NUMBERS_EACH * size) - 1).bit_length()


def segments(draws: int, size: int, numbers: int) -> int:
    """Segments of so many numbers that certainly hold `draws` indexes but for a chance beyond twelve deviations; the last one goes on as long as it must."""
    if size == 1:
        return 1
    lost = rejected(size) / 2**32
    halves = draws / (1 - lost) + 12 * (draws * lost) ** 0.5 / (1 - lost) + 64
    return max(1, -(-int(halves) // (2 * numbers)))


def _generator(seed: int, start: int) -> np.random.PCG64:
    return np.random.PCG64(seed).advance(start)


def _halves(bits: np.random.PCG64, numbers: int) -> Iterator[np.ndarray]:
    """The 32-bit halves of the next `numbers` of the generator, in parts."""
    for at in range(0, numbers, _IN_CACHE):
        yield bits.random_raw(min(_IN_CACHE, numbers - at)).astype("<u8", copy=False).view("<u4")


def _good(halves: np.ndarray, size: int) -> np.ndarray:
    """Which halves give an index. Products of 32-bit numbers are what remains modulo 2^32."""
    return halves * np.uint32(size) >= np.uint32(rejected(size))


def _kept(bits: np.random.PCG64, numbers: int, size: int) -> np.ndarray:
    """Indexes from the next `numbers` of the generator."""
    out, n, all_good = np.empty(2 * numbers, np.int64), 0, not rejected(size)
    for halves in _halves(bits, numbers):
        found = np.multiply(halves, np.uint64(size), dtype=np.uint64) >> np.uint64(32)
        if not all_good:
            found = found[_good(halves, size)]
        out[n : n + len(found)] = found
        n += len(found)
    return out[:n]


def count_kept(seed: int, size: int, segment: int, numbers: int) -> int:
    """How many indexes a segment gives; none of them is made."""
    if not rejected(size):
        return 2 * numbers
    return sum(int(np.count_nonzero(_good(halves, size))) for halves in _halves(_generator(seed, segment * numbers), numbers))


def draw(seed: int, size: int, segment: int, numbers: int, last: bool, left: int) -> Iterator[np.ndarray]:
    """The indexes of a segment, in parts, at most `left` of them; the last segment goes on until it has given all of them."""
    if size == 1:  # the generator is not asked
        for at in range(0, left, _AT_ONCE):
            yield np.zeros(min(_AT_ONCE, left - at), np.int64)
        return
    bits, at = _generator(seed, segment * numbers), 0
    while left > 0 and (last or at < numbers):
        step = min(_AT_ONCE, left // 2 + 1) if last else min(_AT_ONCE, numbers - at)
        out = _kept(bits, step, size)[:left]
        at, left = at + step, left - len(out)
        yield out
