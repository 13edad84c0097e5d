"""Vectorised word tables over Arrow text columns.

A word is ``[^\\x20\\x09-\\x0D]+``: a maximal run of bytes other than space and
the five ASCII control blanks.  UTF-8 never uses those bytes inside another
character, so words can be cut on bytes.  Everything here works on whole
columns: no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANKS = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step holds in arrays; a longer document is a step of its own.
STEP_BYTES = 1 << 20

_SOLID = np.ones(256, bool)
_SOLID[list(BLANKS)] = False
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[list(BLANKS)] = 0
_BYTE_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_2[list(BLANKS)] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEQ = np.uint64(0xD6E8FEB86659FD93)
_SEQ_INV = np.uint64(pow(int(_SEQ), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept while it is small."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents; word w of document d is ``first[d] <= w < first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, again: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; again gives another one, independent of the first."""
        values, base, inverse = (_BYTE_2, _SEQ, _SEQ_INV) if again else (_BYTE, _BASE, _BASE_INV)
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            low = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, low + (1 << 19))))
            n = int(self.end[to - 1]) - low
            x = values[self.data[low : low + n]] * powers(base, n)
            s = self.start[at:to] - low
            out[at:to] = np.add.reduceat(x, s) * powers(inverse, n)[s]
            at = to
        return mix(out + (self.end - self.start).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours in h (across documents: the caller masks those)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_SEQ, len(h)), out=c[1:])
    return mix((c[n:] - c[:-n]) * powers(_SEQ_INV, len(h))[: len(h) - n + 1])


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the runs of n neighbours lie within one document."""
    ok = np.ones(max(0, total - n + 1), bool)
    for back in range(1, n):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes, or of one longer document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def runs_of(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes of one kind other than 0, cut at the ends of documents."""
    begins, stops = kind != 0, kind != 0
    if len(data):
        change = kind[1:] != kind[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins[1:] &= change | edge[1:-1]
        stops[:-1] &= change | edge[1:-1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(stops) + 1, np.searchsorted(start, offsets), offsets)


def cut(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of documents that lie one after another in data."""
    return runs_of(data, _SOLID[data].view(np.uint8), offsets)


def tables(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for ranges of rows of a text column."""
    data, offsets = text_buffers(column)
    for a, b in steps(offsets, limit):
        low = offsets[a]
        yield a, b, cut(data[low : offsets[b]], offsets[a : b + 1] - low)


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, byte plane by byte plane and compressed, after their length."""
    planes = b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True) if planes else bytes(8)


def expanded(payload: bytes, columns: int) -> np.ndarray:
    """(columns, n) of what squeezed was given."""
    n = int.from_bytes(payload[:8], "little")
    planes = pa.decompress(payload[8:], 8 * n * columns, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(columns, 8, n).swapaxes(1, 2)).view("<i8")[:, :, 0]
