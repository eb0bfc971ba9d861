"""Words and shingles of whole Arrow batches as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The ASCII white space that parts words.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser) after adding a salt."""
    z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def byte_values(lower: bool = True) -> np.ndarray:
    values = _BYTE.copy()
    if lower:
        values[65:91] = values[97:123]
    values[list(SPACES)] = 0
    return values


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Words:
    """Words of a run of texts: hash, first byte and end of each, and the number of words of each text."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, lower: bool = True):
        """data: the bytes of all texts; ends: where each ends."""
        self.data = data
        n = len(data)
        is_word = np.ones(256, bool)
        is_word[list(SPACES)] = False
        inside = is_word[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cuts = ends[:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            before[cuts] = False
            after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.hash = self._hashes(byte_values(lower))
        self.upto = np.searchsorted(self.start, ends)  # words before each text's end
        self.count = np.diff(self.upto, prepend=0)

    def _hashes(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        first = 0
        while first < len(self.start):
            stop = max(first + 1, int(np.searchsorted(self.end, self.start[first] + BLOCK, side="right")))
            a, z = int(self.start[first]), int(self.end[stop - 1])
            starts = self.start[first:stop] - a
            place = np.arange(z - a) - np.repeat(starts, np.diff(starts, append=z - a))
            out[first:stop] = np.add.reduceat(values[self.data[a:z]] * powers(int(place.max()) + 1)[place], starts)
            first = stop
        return mix64(out)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def runs_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of k words, in text order, and the number of shingles of each text. Shorter texts are one shingle."""
    h, n = words.hash, len(words.hash)
    rolled = mix64(h, 1)
    for j in range(1, k):
        step = np.zeros(n, np.uint64)
        step[: max(0, n - j)] = h[j:]
        rolled = mix64(rolled * np.uint64(0xD6E8FEB86659FD93) + step, 1)
    count = words.count
    full = np.maximum(count - k + 1, 0)
    first = words.upto - count
    short = np.flatnonzero((count > 0) & (count < k))
    number = np.where((count > 0) & (count < k), 1, full)
    out = np.empty(int(number.sum()), np.uint64)
    at = np.cumsum(number) - number
    keep = np.zeros(n, bool)
    index = np.arange(n)
    text = np.repeat(np.arange(len(count)), count)
    keep = index < (first + full)[text]
    is_full = np.ones(len(out), bool)
    is_full[at[short]] = False
    out[is_full] = rolled[keep]
    for i in short:
        value = np.array([0xA0761D6478BD642F + int(count[i])], np.uint64)
        for j in range(first[i], first[i] + count[i]):
            value = mix64(value * np.uint64(0xD6E8FEB86659FD93) + h[j : j + 1], 1)
        out[at[i]] = value[0]
    return out, number


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch by bytes of text: (rows, bytes of their texts, end of each text). Nulls are empty; a text stays whole."""
    array = batch.column(batch.schema.get_field_index(column))
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    lengths = pc.binary_length(array.fill_null(b"")).to_numpy(zero_copy_only=False).astype(np.int64)
    total, first = np.cumsum(lengths), 0
    while first < len(array):
        base = total[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(total, base + most, side="right")))
        part = array.slice(first, stop - first).fill_null(b"")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if part.buffers()[2] and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        yield batch.slice(first, stop - first), data, offsets[1:] - offsets[0]
        first = stop
