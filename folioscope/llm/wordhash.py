"""Vectorised word and window hashing over Arrow string columns.

A chunk of texts is handled as one UTF-8 byte buffer, so no Python code runs per word.  Separators are
bytes below 0x80, which never occur inside a multi-byte character, so byte-wise splitting equals splitting
the text by the same ASCII separators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = _accumulated(int(_BASE) | 1, n)
    return _POWERS


def _inverses(n: int) -> np.ndarray:
    """Inverses of the powers, modulo 2 ** 64."""
    global _INVERSES
    if len(_INVERSES) < n:
        _INVERSES = _accumulated(pow(int(_BASE) | 1, -1, 1 << 64), n)
    return _INVERSES


def _accumulated(factor: int, n: int) -> np.ndarray:
    out = np.full(1 << (n - 1).bit_length(), factor, U64)
    out[0] = U64(1)
    return np.multiply.accumulate(out)


_POWERS = _INVERSES = np.ones(1, U64)


def spans(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from ``start`` to ``end``: alike wherever the same values stand."""
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(value * _powers(len(value))[: len(value)], out=total[1:])
    return mix((total[end] - total[start]) * _inverses(len(value) + 1)[start])


@dataclass
class Words:
    """Words of several texts: byte spans, 64-bit hashes, and the words' range for each text."""

    data: np.ndarray  # uint8, the texts one after another
    base: np.ndarray  # byte offset of each text in data, and the end
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each text, and the end

    @property
    def doc(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def rest(self) -> np.ndarray:
        """Words from each word to its text's end, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))


def chunks(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges with at most ``limit`` bytes of text, or one row that has more."""
    ends = _offsets(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize)


def _translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` of bytes, by a table of 256 bytes or booleans."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def split(texts: pa.Array, lower: bool = False, separator: np.ndarray = SPACE) -> Words:
    """Words of each text (null: none), A-Z lower-cased first if ``lower``."""
    if texts.null_count:
        texts = texts.fill_null("")
    ends = _offsets(texts).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    base = ends - ends[0]
    if lower:
        data = _translated(data, LOWER)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, base, none, none, np.zeros(0, U64), np.zeros(len(base), np.int64))
    gap = _translated(data, separator)
    opens = ~gap
    before = np.empty(len(gap), bool)
    before[0] = True
    before[1:] = gap[:-1]
    cut = base[1:-1]
    before[cut[cut < len(data)]] = True  # a text's first byte begins a word, whatever the last text ends with
    start = np.flatnonzero(opens & before)
    after = np.empty(len(gap), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[cut[(cut > 0)] - 1] = True
    end = np.flatnonzero(opens & after) + 1
    if not len(start):
        return Words(data, base, start, end, np.zeros(0, U64), np.zeros(len(base), np.int64))
    hashed = spans(_BYTES.take(data, mode="clip"), start, end)  # clipping nothing, it is faster than looking for what lies outside
    return Words(data, base, start, end, hashed, np.searchsorted(start, base))


def windows(hashed: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of the ``length`` words from each word; entries within ``length`` of the end are meaningless."""
    out = np.zeros(len(hashed), U64)
    factor = U64((seed * 0xD1342543DE82EF95 | 1) & (2**64 - 1))
    for k in range(length):
        out *= factor
        if k < len(hashed):
            out[: len(hashed) - k] += hashed[k:]
    return mix(out)


def extend(hashed: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hashes of windows twice as long, from the hashes of windows of ``length`` words."""
    out = hashed * U64((seed * 0xA24BAED4963EE407 | 1) & (2**64 - 1))
    out[: max(0, len(out) - length)] += hashed[length:]
    return mix(out)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over values[i : i + width], cut at the end; log2(width) passes."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: max(0, len(out) - step)] = pick(out[: max(0, len(out) - step)], out[step:])
        have += step
    return out


def minimizers(hashed: np.ndarray, rest: np.ndarray, length: int, whole: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of ``length``-word windows that have the least hash within some ``whole``-word window.

    Only whole windows in ``wanted`` count (default: all within one text).  The choice depends on the window's words
    alone, so equal whole windows choose equal positions.
    """
    width = whole - length + 1
    ok = rest >= whole
    if wanted is not None:
        ok &= wanted
    least = np.where(ok, sliding(hashed, width, np.minimum), U64(0))
    # position p is chosen if a wanted whole window at p - width + 1 .. p has its least hash there
    best = sliding(least[::-1], width, np.maximum)[::-1]
    return np.flatnonzero((best == hashed) & (best != 0))
