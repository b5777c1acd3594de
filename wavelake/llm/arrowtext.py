"""Vectorised word handling on Arrow text columns.

The heavy text operators read whole texts in ``mapInArrow`` tasks.  A Python
loop over words would dominate their cost, so words are located and hashed with
numpy on the column's byte buffer: a prefix sum of ``byte * P**position`` gives
the polynomial hash of any word (or of any word window) by one subtraction.  Such hashes
modulo 2**64 are weak for long, regular ranges of bytes, so words beyond
``LONG_WORD`` bytes are hashed one by one with BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG_WORD = 64
#: Bytes of text that are hashed at once; a longer text is one slice of its own.
SLICE_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD6E8FEB86659FD93 | 1)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, kept per process."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            one = np.ones(size, np.uint64)
            one[1:] = self.base
            self.up = np.multiply.accumulate(one)
            one[1:] = self.inverse
            self.down = np.multiply.accumulate(one)
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(_P)
_WORD_POWERS = _Powers(_Q)
_CHECK_POWERS = _Powers(np.uint64(0xA24BAED4963EE407))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes of text; no text is cut."""
    if not batch.num_rows:
        return
    _, offs = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of a run of texts.

    ``offs[d]:offs[d + 1]`` are the words of text ``d``; ``starts`` and ``ends``
    are byte positions in ``data``; ``hashes`` are 64-bit fingerprints.
    ``letters=False`` cuts at ASCII white space only (words
    ``[^\\x20\\x09-\\x0D]+``), ``letters=True`` at every ASCII byte that is no
    letter or digit, ``cuts`` at the bytes that it marks.
    """

    def __init__(self, column: pa.Array, lower: bool = False, letters: bool = False, cuts: np.ndarray | None = None):
        self.raw, self.bounds = buffers(column)
        self.data = _LOWER[self.raw] if lower else self.raw
        inside = ~cuts[self.raw] if cuts is not None else _LETTER[self.raw] if letters else ~_SPACE[self.raw]
        size = len(self.raw)
        first, last = inside.copy(), inside.copy()
        if size:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = self.bounds[(self.bounds > 0) & (self.bounds < size)]
            first[edge] = inside[edge]
            last[edge - 1] = inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offs = np.searchsorted(self.starts, self.bounds)
        self._sums: np.ndarray | None = None
        self._hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def bytes_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of byte ranges."""
        up, down = _BYTE_POWERS.upto(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * down[starts]
        h = mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            h[k] = int.from_bytes(hashlib.blake2b(self.data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        return h

    @property
    def checks(self) -> np.ndarray:
        """Fingerprints of the words that don't depend on ``hashes``."""
        up, down = _CHECK_POWERS.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.bytes_hash(self.starts, self.ends)
        return self._hashes


def window_starts(offs: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` successive words of one text start."""
    counts = np.diff(offs)
    n = int(offs[-1])
    ends = np.repeat(offs[1:], counts)
    at = np.arange(n)
    return at[at + size <= ends]


def range_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprints of ranges of a sequence of 64-bit symbols."""
    up, down = _WORD_POWERS.upto(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    if seed:
        symbols = mix(symbols + np.uint64(seed))
    np.cumsum(symbols * up[:-1], out=sums[1:])
    return mix(((sums[ends] - sums[starts]) * down[starts]) + (ends - starts).astype(np.uint64))


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle fingerprints.

    A text with fewer than ``size`` words has one shingle, its whole sequence;
    a text without words has none.
    """
    at = window_starts(words.offs, size)
    hashes = range_hash(words.hashes, at, at + size)
    cut = np.searchsorted(at, words.offs)
    out = []
    for d, n in enumerate(words.counts):
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < size:
            a, b = words.offs[d : d + 1], words.offs[d + 1 : d + 2]
            out.append(range_hash(words.hashes, a, b))
        else:
            out.append(np.unique(hashes[cut[d] : cut[d + 1]]))
    return out
