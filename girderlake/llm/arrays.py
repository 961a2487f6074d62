"""Whole Arrow batches as numpy arrays: text bytes, word bounds, span hashes, window minima.

The helpers know nothing of Spark. They let a task handle a few megabytes of text at a time with
array operations, so a task's memory follows ``max_bytes`` (or its longest single text), not its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task turns into arrays at once.
SLICE_BYTES = 1 << 19

#: Bytes 0x20 and 0x09 to 0x0D separate words; every other byte belongs to one.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Powers of a hash are held in steps of so many.
POWERS = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``max_bytes`` of text (one row at least), with their bytes and offsets."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, stop - at), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A non-null integer column as int64."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.int64()).to_numpy(zero_copy_only=False)


def runs(mask: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the offsets ``edges``."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = edges[(edges > 0) & (edges < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and n + 1 offsets of documents into them."""
    starts, ends = runs(IN_WORD[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: The modulus of span hashes, a prime: unlike a power of two, no base is weak for it (texts of the Thue-Morse kind).
P = _U((1 << 61) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Of values below 2**64, the rest modulo P."""
    x = (x & P) + (x >> _U(61))
    x -= P * (x >= P)
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo P of values below P, from halves of 30 and 31 bits."""
    low, some = _U((1 << 31) - 1), _U((1 << 30) - 1)
    ah, al, bh, bl = a >> _U(31), a & low, b >> _U(31), b & low
    mid = ah * bl + al * bh
    out = al * bl
    out += (ah * bh) << _U(1)
    out += mid >> _U(30)
    out += (mid & some) << _U(31)
    return _reduced(out)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo P, n of them at least."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(1, pow(base, len(out), int(P)), np.uint64))])
    return out


class SpanHash:
    """Hashes of any spans of an array from one pass of prefix sums modulo the prime P, spread over 64 bits.

    Two different spans of n values get the same hash by a chance of about n / 2**61 over the choice of the base. Sums of
    bytes stay in two halves that can't overflow within a segment, so that only the spans asked for are reduced.
    """

    def __init__(self, seed: int):
        self.base = int(np.random.default_rng(seed).integers(1 << 40, int(P)))
        self._up = self._down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self._up) <= n:
            n = (n // POWERS + 1) * POWERS + 1
            self._up, self._down = _powers(self.base, n), _powers(pow(self.base, -1, int(P)), n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of uint64 values; of bytes, a row for the high and one for the low halves."""
        n = len(values)
        self._reach(n)
        up = self._up[:n]
        if values.dtype == np.uint8:
            out = np.zeros((2, n + 1), np.uint64)
            codes = values.astype(np.uint64) + _U(1)
            for row, half in zip(out, (up >> _U(31), up & _U((1 << 31) - 1))):
                np.multiply(codes, half, out=row[1:])
                for a in range(0, n, SEGMENT):
                    b = min(n, a + SEGMENT)
                    if a:
                        row[a + 1] += _reduced(row[a : a + 1])[0]
                    np.cumsum(row[a + 1 : b + 1], out=row[a + 1 : b + 1])
            return out if n <= SEGMENT else _joined(out)
        terms = times(_reduced(values), up)
        out = np.zeros(n + 1, np.uint64)
        out[1:] = _joined(np.stack([np.cumsum(terms >> _U(31), dtype=np.uint64), np.cumsum(terms & _U((1 << 31) - 1), dtype=np.uint64)]))
        return out

    def _between(self, high: np.ndarray, low: np.ndarray, starts) -> np.ndarray:
        d = high - low if high.ndim == 2 else _reduced(high + (P - low))
        return mix(times(_joined(d) if d.ndim == 2 else d, self._down[starts]))

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._between(sums[..., ends], sums[..., starts], starts)

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Of every k consecutive values."""
        n = max(0, sums.shape[-1] - k)
        return self._between(sums[..., k : k + n], sums[..., :n], slice(0, n))


#: Bytes whose half sums fit in 64 bits, with what comes before them reduced.
SEGMENT = 1 << 22


def _joined(halves: np.ndarray) -> np.ndarray:
    """high * 2**31 + low modulo P."""
    high, low = _reduced(halves[0]), _reduced(halves[1])
    return _reduced((high >> _U(30)) + ((high & _U((1 << 30) - 1)) << _U(31)) + low)


class DealHash:
    """Hashes modulo 2**64, several times as fast, that only deal text to tasks: those of some different spans are equal."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.codes = rng.integers(0, 1 << 64, 256, np.uint64)
        self._up = self._down = np.ones(1, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self._up) <= n:
            for name, b in (("_up", self.base), ("_down", pow(self.base, -1, 1 << 64))):
                p = np.full((n // POWERS + 1) * POWERS + 1, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        values = self.codes[values] if values.dtype == np.uint8 else values
        out = np.zeros(n + 1, np.uint64)
        np.multiply(values, self._up[:n], out=out[1:])
        np.cumsum(out[1:], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self._down[starts])

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Of every k consecutive values."""
        n = max(0, len(sums) - k)
        return mix((sums[k : k + n] - sums[:n]) * self._down[:n])


BYTES, WORDS, CHECK, DEAL = SpanHash(1), SpanHash(2), SpanHash(3), DealHash(4)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, by: SpanHash = BYTES) -> np.ndarray:
    return by.spans(by.sums(data), starts, ends)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive uint64 values: minima from both ends of blocks of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each of ``a`` and from each of ``b`` are the same."""
    at = np.repeat(np.arange(len(size)), size)
    step = of_each(size)
    differs = data[a[at] + step] != data[b[at] + step]
    return np.bincount(at[differs], minlength=len(size)) == 0


def of_each(counts: np.ndarray) -> np.ndarray:
    """0, 1, ..., count - 1 for each count in turn."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
