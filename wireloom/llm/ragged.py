"""Words and hashes of many texts at once, as numpy arrays over the bytes of an Arrow string column.

Bytes from 0x80 on are word bytes in every word rule used here, so cutting bytes and cutting code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes worked on at a time
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_POWER = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def blank_words() -> np.ndarray:
    """Word bytes: all but space, tab, line feed, vertical tab, form feed and carriage return."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def alnum_words() -> np.ndarray:
    """Word bytes: letters, digits and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = True
    table[128:] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte bounds of each row) of runs of rows with about ``limit`` bytes; null is empty.

    A longer text is a run of its own.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every text (and the end) the index of its first word."""
    inside = table[data]
    return runs(inside, inside[:-1] & inside[1:], bounds)


def runs(inside: np.ndarray, joined: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for any marking: ``inside`` for bytes of words, ``joined`` for bytes that belong to the word of the byte after."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    edge = bounds[:-1][bounds[:-1] < len(inside)]
    first[edge] = inside[edge]
    edge = bounds[1:][bounds[1:] > 0] - 1
    last[edge] = inside[edge]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, bounds)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER["up"]) < n:
        for name, step in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, step, np.uint64)
            x[0] = 1
            _POWER[name] = np.multiply.accumulate(x)
    return _POWER["up"], _POWER["down"]


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word with A-Z lower-cased: the same bytes hash alike wherever they stand."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = int(np.searchsorted(start, start[a] + SEGMENT))
        seg = data[start[a]:end[b - 1]]
        up, down = _powers(max(len(seg), SEGMENT))
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTE[seg] * up[:len(seg)], out=total[1:])
        s, e = start[a:b] - start[a], end[a:b] - start[a]
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def hash_word(word: str) -> int:
    """``hash_words`` of one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(data)]))[0])


_STEP = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def hash_windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive hashes; the last ``size - 1`` places have none."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _STEP[0]
    for k in range(1, size):
        out += h[k:n + k] * _STEP[k]
    return mix(out + np.uint64(size))
