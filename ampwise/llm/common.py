"""Bytes, words and hashes of Arrow string columns as numpy arrays, for the Arrow functions of this package."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers of the two span hashes


def map_texts(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` for rows with texts. Spark bounds its batches by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``,
    64 MB unless set), so whole documents of any size travel in bounded batches, but for one that is larger by itself;
    functions go through them in ``slices``."""
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of ``column`` each; a longer text is a run of its own."""
    values = batch.column(column).cast(pa.large_string())
    if not len(values):
        return
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    first = 0
    while first < len(values):
        after = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield batch.slice(first, after - first)
        first = after


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column end to end, and each row's start in them with the end of all; null: empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = [mixed(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * np.uint64(BASES[k])) for k in (0, 1)]


class SpanHashes:
    """64-bit hashes of byte spans: a polynomial over 2^64 from running sums, so that each span costs two look-ups."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = np.uint64(BASES[which])
        powers = np.full(len(data) + 1, base, np.uint64)
        powers[0] = 1
        self.back = np.full(len(data) + 1, np.uint64(pow(BASES[which], -1, 1 << 64)), np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[which][data] * powers[:-1], out=self.sums[1:])

    def of(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return mixed((self.sums[after] - self.sums[first]) * self.back[first] + (after - first).astype(np.uint64))


PRIME = np.uint64((1 << 61) - 1)
WORD_BASE = 0x1A2B3C4D5E6F7081  # of the polynomial over PRIME; below it
LONG_WORD = 1 << 16


def _power_halves(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Low 31 and high 30 bits of the first powers of the base."""
    powers, last = [1], 1
    for _ in range(count - 1):
        last = last * WORD_BASE % int(PRIME)
        powers.append(last)
    powers = np.array(powers, np.uint64)
    return powers & np.uint64((1 << 31) - 1), powers >> np.uint64(31)


POWER_LOW, POWER_HIGH = _power_halves(LONG_WORD)


def word_hashes(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these spans, a polynomial of their bytes over a prime, mixed with their length.

    Unlike a polynomial over 2^64, where structured words of a thousand bytes collide under any base, two words of n bytes
    collide for at most n of the 2^61 bases. Words of ``LONG_WORD`` bytes or more are hashed one by one.
    """
    out = np.zeros(len(first), np.uint64)
    length = after - first
    short = np.flatnonzero(length < LONG_WORD)
    if len(short):
        size = length[short]
        begin = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(begin, size)
        letters = data[np.repeat(first[short], size) + inside].astype(np.uint64) + np.uint64(1)
        low = np.add.reduceat(letters * POWER_LOW[inside], begin)  # below 2^39 each, 2^16 of them at most
        high = np.add.reduceat(letters * POWER_HIGH[inside], begin)
        high = (high & PRIME) + (high >> np.uint64(61))
        turned = ((high << np.uint64(31)) & PRIME) + (high >> np.uint64(30))
        value = (low & PRIME) + (low >> np.uint64(61)) + turned
        value = (value & PRIME) + (value >> np.uint64(61))
        value = np.where(value >= PRIME, value - PRIME, value)
        out[short] = mixed(mixed(value + np.uint64(1)) + size.astype(np.uint64))
    for k in np.flatnonzero(length >= LONG_WORD).tolist():
        digest = hashlib.blake2b(data[first[k] : after[k]].tobytes(), digest_size=8).digest()
        out[k] = np.frombuffer(digest, np.uint64)[0]
    return out


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte whether it is in one of the ranges, both ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACES = byte_table((0x20, 0x20), (0x09, 0x0D))


def spans_of_words(data: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every maximal run of letters; no run crosses rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = letters[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = starts[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


class RangeLeast:
    """The place of the first least value in any range of an array."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.levels = [np.arange(len(values))]
        width = 1
        while 2 * width <= min(longest, len(values)):
            last = self.levels[-1]
            left, right = last[:-width], last[width:]
            self.levels.append(np.where(values[left] <= values[right], left, right))
            width *= 2

    def at(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For ranges with both ends included and at least one value."""
        out = np.zeros(len(first), np.int64)
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            table = self.levels[k]
            left, right = table[first[own]], table[last[own] + 1 - (1 << int(k))]
            out[own] = np.where(self.values[left] <= self.values[right], left, right)
        return out
