"""Patched frame-of-reference blocks of token ids, as bytes.

A segment holds whole documents' ids, one after another, in blocks of ``BLOCK`` values. A block
stores its minimum; the differences at a width that a percentile of them fits in; and the
outliers' high bits in an exception list of positions and values. A table of block starts lets a
reader open any block alone. All integers are little-endian.

    magic 4s | values u64 | blocks u32 | block starts u32 x (blocks + 1) | blocks
    block: minimum u32 | values u16 | exceptions u16 | width u8 | packed words u64 ... |
           positions u16 x exceptions | high bits u32 x exceptions
"""

import struct

import numpy as np

MAGIC = b"PFR1"
BLOCK = 1024
LANE = 64
PERCENTILE = 90
_HEAD = "<IHHB"
_HEAD_SIZE = struct.calcsize(_HEAD)


def _widths(deltas: np.ndarray) -> np.ndarray:
    """Bits of the chosen percentile of each block's differences (rows are blocks)."""
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    chosen = np.partition(deltas, at, axis=1)[:, at].astype(np.float64)
    return np.where(chosen > 0, np.floor(np.log2(np.maximum(chosen, 1))) + 1, 0).astype(np.int64)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values of ``width`` bits as rows of 64-bit words, lane by lane."""
    lanes = np.ascontiguousarray(low.reshape(-1, LANE).T)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(LANE):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(low), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of packed words as rows of BLOCK values."""
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((LANE, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(LANE):
        word, shift = divmod(i * width, 64)
        value = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (lanes[word + 1] << np.uint64(64 - shift))
        out[i] = value & mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK)


def encode(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit ids; no ids give a segment without blocks."""
    n = len(ids)
    count = -(-n // BLOCK)
    padded = np.zeros(count * BLOCK, np.uint64)
    padded[:n] = ids
    if n:
        padded[n:] = padded[n - 1]
    rows = padded.reshape(count, BLOCK)
    low = rows.min(axis=1) if count else np.zeros(0, np.uint64)
    deltas = rows - low[:, None]
    widths = _widths(deltas) if count else np.zeros(0, np.int64)
    outlying = (deltas >> widths[:, None].astype(np.uint64)) > 0
    packed = {}
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        masked = deltas[at] & np.uint64((1 << int(width)) - 1)
        words = _pack(masked, int(width)) if width else np.zeros((len(at), 0), np.uint64)
        packed.update(zip(at.tolist(), words))
    pieces, starts = [], [0]
    for i in range(count):
        where = np.flatnonzero(outlying[i])
        high = (deltas[i, where] >> np.uint64(widths[i])).astype("<u4")
        size = min(BLOCK, n - i * BLOCK)
        head = struct.pack(_HEAD, int(low[i]), size, len(where), int(widths[i]))
        pieces.append(head + packed[i].astype("<u8").tobytes() + where.astype("<u2").tobytes() + high.tobytes())
        starts.append(starts[-1] + len(pieces[-1]))
    top = MAGIC + struct.pack("<QI", n, count) + np.array(starts, "<u4").tobytes()
    return top + b"".join(pieces)


def decode(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first .. last`` (exclusive; default all) of a segment."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of token blocks")
    _, count = struct.unpack_from("<QI", segment, 4)
    starts = np.frombuffer(segment, "<u4", count + 1, 16)
    body = 16 + 4 * (count + 1)
    last = count if last is None else min(last, count)
    heads = [struct.unpack_from(_HEAD, segment, body + int(starts[i])) for i in range(first, last)]
    if not heads:
        return np.zeros(0, np.uint32)
    widths = np.array([h[3] for h in heads])
    out = np.zeros((len(heads), BLOCK), np.uint64)
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == width)
        words = BLOCK // 64 * int(width)
        rows = [np.frombuffer(segment, "<u8", words, body + int(starts[first + i]) + _HEAD_SIZE) for i in at]
        out[at] = _unpack(np.stack(rows).astype(np.uint64), int(width))
    for i, (low, _, exceptions, width) in enumerate(heads):
        if exceptions:
            after = body + int(starts[first + i]) + _HEAD_SIZE + BLOCK // 8 * width
            where = np.frombuffer(segment, "<u2", exceptions, after)
            high = np.frombuffer(segment, "<u4", exceptions, after + 2 * exceptions)
            out[i, where] |= high.astype(np.uint64) << np.uint64(width)
        out[i] += np.uint64(low)
    return np.concatenate([row[: h[1]] for row, h in zip(out, heads)]).astype(np.uint32)
