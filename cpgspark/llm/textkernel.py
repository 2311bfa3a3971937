"""Vectorised kernels over the UTF-8 bytes of texts.

Every kernel works on plain NumPy arrays, so that one Arrow column of texts is
processed without a Python object per word.  Words are runs of bytes that are
not in a separator class; since all separators are ASCII, splitting the bytes
equals splitting the characters.

Hashes are 64-bit.  A word's hash is a polynomial over random byte values, made
independent of the word's place with the inverse power (the base is odd, hence
invertible modulo 2**64), then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def give_back() -> None:
    """Returns memory that a finished task no longer uses: workers stay alive for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: White space of the word rule: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        up = np.full(_CHUNK, _U(_BASE), dtype=np.uint64)
        down = np.full(_CHUNK, _U(pow(_BASE, -1, 1 << 64)), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def row_blocks(offsets: np.ndarray, limit: int):
    """Consecutive row ranges of at most `limit` bytes, or of one longer row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def word_hashes(raw: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word and its 64-bit hash, A-Z read as a-z."""
    up, down = _tables()
    starts, hashes = [], []
    at = 0
    carry = None  # (start, hash so far, length) of a word longer than the chunk
    while at < len(raw):
        piece = raw[at : at + _CHUNK]
        sep = separators[piece]
        if at + len(piece) < len(raw) and not sep[-1]:
            cut = np.flatnonzero(sep)
            if len(cut):
                piece, sep = piece[: cut[-1] + 1], sep[: cut[-1] + 1]
            else:  # one word fills the chunk
                stop = at + len(piece)
                while stop < len(raw) and not separators[raw[stop]]:
                    stop += 1
                value, n = 0, stop - at
                for k in range(at, stop, _CHUNK):
                    part = _BYTE[_LOWER[raw[k : min(k + _CHUNK, stop)]]]
                    value = (value * pow(_BASE, -_CHUNK, 1 << 64) + int((part * up[: len(part)]).sum(dtype=np.uint64))) & _M64
                starts.append(np.array([at]))
                hashes.append(mix(np.array([value ^ n], dtype=np.uint64)))
                at = stop
                continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
        begin, end = edge[::2], edge[1::2]
        if len(begin):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[piece]] * up[: len(piece)], dtype=np.uint64)))
            value = (total[end] - total[begin]) * down[begin]
            hashes.append(mix(value ^ (end - begin).astype(np.uint64)))
            starts.append(begin + at)
        at += len(piece)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def words_by_row(offsets: np.ndarray, raw: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(word bounds by row, word hashes); a word never crosses two rows."""
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(raw))]
    glued = inner[~separators[raw[inner]] & ~separators[raw[inner - 1]]] if len(inner) else inner
    if len(glued):  # a separator goes between texts that touch
        wide = np.insert(raw, glued, 0x20)
        starts, hashes = word_hashes(wide, separators)
        starts = starts - np.searchsorted(glued + np.arange(len(glued)), starts, side="right")
    else:
        starts, hashes = word_hashes(raw, separators)
    return np.searchsorted(starts, offsets), hashes


_STEP = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; fewer words, but not none, give one hash."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    value = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        value += words[j : n - width + 1 + j] * _STEP[j % 64]
        if j % 64 == 63:
            value = mix(value)
    return mix(value ^ _U(width))


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, k: int):
    """For each row the sorted distinct shingle hashes of its whole text."""
    bounds, words = words_by_row(offsets, raw)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(shingle_hashes(words[a:b], k)) if b > a else words[:0]
