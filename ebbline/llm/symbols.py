"""Texts as sequences of small numbers, and codes of the n-grams among them.

``BYTES`` takes a text's UTF-8 as it is: nothing is folded, and five bytes are told apart exactly
within 64 bits. ``FOLDED`` has 64 symbols, so that a table over four of them has a fixed size: a-z,
one symbol for A-Z, one for digits, space, line end and other controls, full stop and comma have
symbols of their own; other ASCII marks share 15 and all further code points share 16 by code. An
edge, which no text in ``BYTES`` holds, stands before and after a text.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Of the folded alphabet.
BITS = 6
SIZE = 1 << BITS
EDGE = 30
ORDER = 4


def _table() -> np.ndarray:
    table = np.empty(0x110000, np.uint8)
    codes = np.arange(0x110000)
    table[:] = 48 + codes % 16
    table[:128] = 33 + codes[:128] % 15
    table[:32] = 29
    table[127] = 29
    table[ord("a") : ord("z") + 1] = np.arange(26)
    table[ord("A") : ord("Z") + 1] = 26
    table[ord("0") : ord("9") + 1] = 27
    table[ord(" ")] = 28
    table[ord(".")] = 31
    table[ord(",")] = 32
    return table


_tables: dict[str, np.ndarray] = {}


def _folded(text: pa.Scalar) -> np.ndarray:
    if "all" not in _tables:
        _tables["all"] = _table()
    codes = np.frombuffer((text.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4")
    return _tables["all"][codes]


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer() or b"", np.uint8)


class Alphabet(NamedTuple):
    bits: int
    order: int
    edge: int
    symbols: Callable[[pa.Scalar], np.ndarray]

    @property
    def size(self) -> int:
        return 1 << self.bits


FOLDED = Alphabet(BITS, ORDER, EDGE, _folded)
BYTES = Alphabet(8, 5, 0xFF, _bytes)


def runs(column: pa.Array, alphabet: Alphabet = FOLDED, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of consecutive whole texts and their bounds; each text starts with ``order - 1``
    edges and ends with one. Null is empty."""
    edges = np.full(alphabet.order - 1, alphabet.edge, np.uint8)
    pieces, lengths, held = [], [], 0
    for text in column:
        own = alphabet.symbols(text)
        pieces += [edges, own, edges[:1]]
        lengths.append(len(own) + alphabet.order)
        held += lengths[-1]
        if held >= size:
            yield np.concatenate(pieces), np.concatenate([[0], np.cumsum(lengths)])
            pieces, lengths, held = [], [], 0
    if lengths:
        yield np.concatenate(pieces), np.concatenate([[0], np.cumsum(lengths)])


def grams(symbols: np.ndarray, order: int = ORDER, bits: int = BITS) -> np.ndarray:
    """Code of the ``order`` symbols that end at each place, from place ``order - 1`` on."""
    n = len(symbols) - order + 1
    out = np.zeros(max(n, 0), np.int32 if order * bits < 32 else np.int64)
    for i in range(order):
        out = (out << bits) | symbols[i : i + n]
    return out


def inner_grams(column: pa.Array, alphabet: Alphabet) -> Iterator[np.ndarray]:
    """Codes of n-grams, run by run; none reaches across two texts."""
    for symbols, bounds in runs(column, alphabet):
        found = grams(symbols, alphabet.order, alphabet.bits)
        inside = np.ones(len(found), bool)
        for i in range(1, alphabet.order):
            inside[bounds[1:-1] - i] = False
        yield found[inside]
