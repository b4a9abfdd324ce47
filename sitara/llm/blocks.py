"""Words and their 64-bit hashes for whole Arrow batches, in numpy.

A batch's texts lie in one byte buffer; word borders, hashes and counts are
computed over that buffer at once, so tasks spend no time in per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; bounds the temporary arrays, not the texts.
CHUNK = 1 << 18
#: Texts are grouped up to so many bytes; what a block needs beside them is about 40 times as much.
BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, dtype=np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= CHUNK:
        if CHUNK not in _tables:
            _tables[CHUNK] = (_powers(_BASE, CHUNK), _powers(_INVERSE, CHUNK))
        up, down = _tables[CHUNK]
        return up[:n], down[:n]
    return _powers(_BASE, n), _powers(_INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap and are in ascending order.

    A polynomial over random byte values, by differences of running sums
    that wrap at 2**64; only the bytes of one chunk are expanded at a time.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(max(1, hi - lo))
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        empty = s == e
        h = (sums[e] - sums[s]) * down[np.where(empty, 0, s)]
        out[i:j] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        i = j
    return out


@dataclass
class Block:
    """Some texts of a batch: ``data`` their bytes, ``offs`` the borders of texts in it,
    ``starts``/``ends`` of words, ``first`` the borders of texts in the words."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Number of bytes that a flag marks, by text."""
        out, full = np.zeros(self.n, dtype=np.int64), np.flatnonzero(self.offs[1:] > self.offs[:-1])
        if len(full):
            out[full] = np.add.reduceat(flags.view(np.uint8), self.offs[:-1][full], dtype=np.int64)
        return out

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word, by text."""
        sums = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
        return sums[self.first[1:]] - sums[self.first[:-1]]


def text_blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of consecutive texts of about ``size`` bytes each; a null text is empty.

    A text beyond that is a block of its own and stays whole.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, buf = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    all_bytes = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        data = all_bytes[offs[lo] : offs[hi]]
        if lower:
            data = _LOWER[data]
        yield _block(lo, hi, data, offs[lo : hi + 1] - offs[lo])
        lo = hi


def _block(lo: int, hi: int, data: np.ndarray, offs: np.ndarray) -> Block:
    space = _SPACE[data]
    begin, end = ~space, ~space
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    borders = offs[(offs > 0) & (offs < len(data))]
    begin[borders] = ~space[borders]
    end[borders - 1] = ~space[borders - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Block(lo, hi, data, offs, starts, ends, np.searchsorted(starts, offs))
