"""Draws of a seeded Mersenne Twister, by number: row i gets draw i of the sequential stream, whichever task it is in.

The generator's words follow a linear recurrence over bits, so the state ``n`` words on is a polynomial in the step applied
to the state: the remainder of ``t**n`` by the characteristic polynomial (degree 19937), found by squaring. Applied to a
state, it is the exclusive or of as many windows of the word sequence as it has terms. A task so jumps to its first draw
in a fraction of a second, however far, and goes on from there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The Python functions of this module travel with their tasks, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of the state, the recurrence's offset, its matrix, and the degree of its polynomial.
WORDS, OFFSET, MATRIX, DEGREE = 624, 397, 0x9908B0DF, 19937
BLOCK_DRAWS = 1 << 16
NAME = "MT19937"

State = tuple[np.ndarray, int]  # words, and how many of them are used


def seeded(seed: int) -> State:
    _, words, used, *_ = np.random.RandomState(seed).get_state()
    return words, used


def sequence(words: np.ndarray, count: int) -> np.ndarray:
    """``count`` words of the sequence that begins with a state's words."""
    out = np.zeros(count, np.uint32)
    out[:WORDS] = words
    for first in range(WORDS, count, WORDS - OFFSET):
        after = min(first + WORDS - OFFSET, count)
        old, following = out[first - WORDS : after - WORDS], out[first - WORDS + 1 : after - WORDS + 1]
        mixed = (old & np.uint32(0x80000000)) | (following & np.uint32(0x7FFFFFFF))
        out[first:after] = out[first - WORDS + OFFSET : after - WORDS + OFFSET] ^ (mixed >> np.uint32(1))
        out[first:after] ^= np.where(mixed & np.uint32(1), np.uint32(MATRIX), np.uint32(0))
    return out


@lru_cache(maxsize=1)
def characteristic() -> int:
    """The recurrence's polynomial over bits, the coefficient of ``t**k`` in bit ``k``: the shortest recurrence that one bit
    of the words obeys, by Berlekamp and Massey."""
    bits = (sequence(seeded(1)[0], 2 * DEGREE + 2 * WORDS)[WORDS:] & np.uint32(1)).tolist()
    current, before, length, gap, seen = 1, 1, 0, 1, 0
    for k, bit in enumerate(bits):
        seen = (seen << 1) | bit  # bit i holds the bit i steps back
        if (current & seen).bit_count() & 1:
            changed = current ^ (before << gap)
            if 2 * length <= k:
                length, before, gap = k + 1 - length, current, 0
            current = changed
        gap += 1
    # Coefficients count back from the newest bit; turned round, they count powers.
    return int(f"{current:0{length + 1}b}"[::-1], 2)


@lru_cache(maxsize=1)
def _spread() -> np.ndarray:
    return np.array([int("".join(f"0{b}" for b in f"{k:08b}"), 2) for k in range(256)], np.uint16)


def _squared(value: int) -> int:
    """The square of a polynomial over bits: a zero between any two bits."""
    raw = np.frombuffer(value.to_bytes((value.bit_length() + 7) // 8 or 1, "little"), np.uint8)
    return int.from_bytes(_spread()[raw].astype("<u2").tobytes(), "little")


def _reduced(value: int) -> int:
    """The remainder by the characteristic polynomial, which has few terms."""
    low = characteristic() ^ (1 << DEGREE)
    terms = [k for k in range(low.bit_length()) if low >> k & 1]
    while (high := value >> DEGREE) > 0:
        value ^= high << DEGREE
        for k in terms:
            value ^= high << k
    return value


@lru_cache(maxsize=64)
def _power(steps: int) -> int:
    value = 1
    for bit in f"{steps:b}":
        value = _reduced(_squared(value))
        if bit == "1":
            value = _reduced(value << 1)
    return value


def jumped(state: State, steps: int) -> State:
    """The state ``steps`` words on."""
    words, used = state
    whole, used = divmod(used + steps, WORDS)
    if whole == 0:
        return words, used
    bits = bin(_power(whole * WORDS))[:1:-1]
    places = np.flatnonzero(np.frombuffer(bits.encode(), np.uint8) == ord("1"))
    windows = np.lib.stride_tricks.sliding_window_view(sequence(words, DEGREE + WORDS), WORDS)
    out = np.zeros(WORDS, np.uint32)
    for first in range(0, len(places), 1024):
        out ^= np.bitwise_xor.reduce(windows[places[first : first + 1024]], axis=0)
    return out, used


def generator(state: State) -> np.random.RandomState:
    made = np.random.RandomState()
    made.set_state((NAME, state[0], state[1], 0, 0.0))
    return made


def _drawing(state: State):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, at = None, None
        for batch in batches:
            places = batch.column("draw").to_numpy()
            for first in range(0, len(places), BLOCK_DRAWS):
                part = places[first : first + BLOCK_DRAWS]
                if at != part[0]:
                    source = generator(jumped(state, 2 * int(part[0])))  # a draw takes two words
                at = int(part[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(source.random_sample(len(part)))], names=["draw", "u"])

    return run


def draws(spark: SparkSession, count: int, seed: int | State) -> DataFrame:
    """``(draw, u)``: the first ``count`` uniform draws in [0, 1) after seeding, numbered from 0.

    Partitions are runs of numbers, so each task jumps once.
    """
    state = seeded(seed) if isinstance(seed, int) else seed
    return spark.range(count).select(F.col("id").alias("draw")).mapInArrow(_drawing(state), "draw bigint, u double")


def permutation(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """``(place, item)``: the seeded random order of 0 .. count - 1.

    Every step of the shuffle depends on all before, so it runs in one piece, on numbers alone: eight bytes an item. It is
    meant for things, not for samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            items = np.random.RandomState(seed).permutation(count).astype(np.int64)
            for first in range(0, count, BLOCK_DRAWS):
                part = items[first : first + BLOCK_DRAWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(part))), pa.array(part)], names=["place", "item"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "place bigint, item bigint")


def after_permutation(spark: SparkSession, count: int, seed: int) -> State:
    """The generator's state once it has drawn the order of ``count`` items; the shuffle runs in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = np.random.RandomState(seed)
            made.permutation(count)
            _, words, used, *_ = made.get_state()
            yield pa.RecordBatch.from_arrays([pa.array([words.astype(np.int64)]), pa.array([used], pa.int64())], names=["words", "used"])

    row = spark.range(0, 1, 1, 1).mapInArrow(run, "words array<bigint>, used bigint").first()
    return np.array(row["words"], np.uint32), row["used"]
