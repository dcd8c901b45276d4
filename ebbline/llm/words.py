"""Hashes of the words of many texts at once, from Arrow's own buffers.

A batch is cut into runs of whole documents of about ``RUN_BYTES``; one run's words are hashed
by array operations over its bytes. A document larger than that is a run of its own, so no
text is ever cut.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ebbline.llm.sharing import kept_in_worker

RUN_BYTES = 1 << 19

# White space, as byte codes.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of a splittable generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    """A random 64-bit code per byte; A-Z share those of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


CODES = _byte_codes()

# Words between white space.
SPACED = np.ones(256, bool)
SPACED[list(SPACES)] = False

# Words of letters and digits: ASCII ones, and every byte of a longer code point.
LETTERED = np.zeros(256, bool)
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    LETTERED[ord(_low) : ord(_high) + 1] = True
LETTERED[0x80:] = True


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    # Not a global of this module: those are sent along with every function that uses it.
    powers = kept_in_worker("powers", dict)
    if len(powers.get(name, ())) < n:
        steps = np.full(max(n, 2 * RUN_BYTES), base, np.uint64)
        steps[0] = 1
        powers[name] = np.multiply.accumulate(steps)
    return powers[name][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive documents ``first .. last`` (exclusive) of about ``size`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and, per document, where its words start (``len(offsets)`` bounds).

    A-Z hash like a-z. ``kind`` marks the bytes that belong to words.
    """
    base = offsets[0]
    part = data[base : offsets[-1]]
    if len(part) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = kind[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1] - base
    cuts = cuts[cuts < len(part)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    ends = np.flatnonzero(last) + 1
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(CODES[part] * _power("up", _ODD, len(part)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("back", _BACK, len(part))[starts])
    return hashes, np.searchsorted(starts, offsets - base)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, at its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(width):
        total += words[j : j + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(total)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a whole short sequence, apart from those of runs."""
    return mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
