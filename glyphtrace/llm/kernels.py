"""Vectorised text kernels shared by the corpus operators: words, shingles and window minima over Arrow batches.

Every kernel works on a whole Arrow string column at once through its UTF-8 buffer, so a batch costs a few numpy
passes and no Python loop per word. Null texts behave as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Roller:
    """Polynomial hashes of all slices of a sequence, modulo 2**64, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def slices(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) <= n:
            self.up, self.down = _powers(self.base, n + 1), _powers(self.inverse, n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * self.up[:n], out=sums[1:])
        return (sums[end] - sums[start]) * self.down[start]


_BYTES, _WORDS = _Roller(0xD1342543DE82EF95), _Roller(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads a polynomial hash over all 64 bits."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * _ODD
    return x ^ (x >> U64(32))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of every text: 64-bit hashes, byte spans, and the range of words of each text."""

    def __init__(self, column, lower: bool = False):
        raw, offsets = utf8(column)
        self.original, self.raw = raw, _LOWER[raw] if lower else raw
        self.offsets = offsets
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_SEPARATOR[raw]
        head = inside[1:-1] & ~inside[:-2]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        head[cuts] |= inside[1:-1][cuts]
        tail = inside[1:-1] & ~inside[2:]
        tail[cuts - 1] |= inside[1:-1][cuts - 1]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)  # text i has words first[i]:first[i + 1]
        self.hash = mix(_BYTES.slices(_BYTE[self.raw], self.start, self.end)) if len(raw) else np.zeros(0, np.uint64)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the n words from each word on; valid where all n lie in one text."""
        total = len(self.hash)
        end = np.repeat(self.first[1:], self.count)
        at = np.arange(total)
        valid = at + n <= end
        return mix(_WORDS.slices(self.hash, at, np.minimum(at + n, total))), valid

    def whole(self) -> np.ndarray:
        """A hash of each text's whole sequence of words."""
        if not len(self.hash):
            return np.zeros(len(self.first) - 1, np.uint64)
        return mix(_WORDS.slices(self.hash, self.first[:-1], self.first[1:]) + self.count.astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for each i (of what there is, at the end)."""
    out, done = values.copy(), 1
    while done < width and done < len(values):
        step = min(done, width - done)
        moved = out.copy()
        moved[:-step] = np.minimum(out[:-step], out[step:])
        out, done = moved, done + step
    return out


def minimizers(grams: np.ndarray, valid: np.ndarray, width: int, whole: np.ndarray) -> np.ndarray:
    """Positions of grams that are smallest of some `width` consecutive ones; whole: where such a window may start.

    Two texts that share width consecutive grams share the smallest of them, so equal passages always meet.
    """
    if not whole.any():
        return np.zeros(0, np.int64)
    values = np.where(valid, grams, U64(0xFFFFFFFFFFFFFFFF))
    least = sliding_min(values, width)
    least_of = np.where(whole, least, U64(0))
    # a minimum never exceeds a gram that its window covers, so a gram is some window's minimum if it equals the largest
    return np.flatnonzero((_sliding_max_back(least_of, width) == values) & valid)


def _sliding_max_back(values: np.ndarray, width: int) -> np.ndarray:
    """Maximum of values[i - width + 1 : i + 1] for each i."""
    out, done = values.copy(), 1
    while done < width and done < len(values):
        step = min(done, width - done)
        moved = out.copy()
        moved[step:] = np.maximum(out[step:], out[:-step])
        out, done = moved, done + step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns], names=names)


def ragged(values: np.ndarray, lengths: np.ndarray, kind=None) -> pa.ListArray:
    """A list column out of values laid end to end."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
