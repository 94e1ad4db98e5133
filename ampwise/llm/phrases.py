"""Document fingerprints from Lempel-Ziv phrases, for a likeness close to that of joint compression.

A document is parsed into dictionary phrases: each is the shortest run of code points, from where the last one ended, that
is no phrase yet. Texts that would compress well together share many phrases. The phrase set is hashed and sketched by
minimum hashes: in round after round every phrase falls into a coordinate by its hash, later rounds counting as greater,
until every coordinate holds a least value. Two fingerprints agree in as many coordinates, on average, as their phrase
sets share of their union.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampwise.functions.numeric import bind

# The Python functions of this module travel with their tasks, so executors need numpy, pyarrow and xxhash but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COORDINATES = 128
DIGITS = 4  # hex digits that a fingerprint keeps of each coordinate
EMPTY = ""  # the fingerprint of a text without phrases
RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def parse(text: str, first: int = 0, known: set[str] | None = None) -> tuple[list[str], list[int]]:
    """The phrases of ``text`` from ``first`` on that are not ``known``, in order, and where each ends.

    Every start of a phrase is a phrase or empty, so the length is sought from the last one's, up or down.
    """
    known = set() if known is None else known
    phrases, ends, size, guess = [], [], len(text), 1
    while first < size:
        after = min(first + guess, size)
        phrase = text[first:after]
        if phrase in known:
            while phrase in known and after <= size:
                after += 1
                phrase = text[first:after]
            if after > size:
                break  # the rest is a phrase that is known
        else:
            while after - first > 1 and text[first : after - 1] not in known:
                after -= 1
            phrase = text[first:after]
        known.add(phrase)
        phrases.append(phrase)
        ends.append(after)
        guess, first = after - first, after
    return phrases, ends


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray | None:
    """The least (round, hash) in each coordinate over a set of 64-bit hashes; None for an empty set.

    After as many rounds as coordinates, every later round offers all hashes to one coordinate, so all get filled. A
    coordinate's value does not depend on how soon the others are filled.
    """
    if not len(hashes):
        return None
    nothing = np.uint64((1 << 64) - 1)
    least = np.full(coordinates, nothing, np.uint64)
    low = np.uint64((1 << 55) - 1)
    for turn in range(2 * coordinates):
        drawn = _mixed(hashes + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        values = (drawn & low) | np.uint64(turn << 55)
        if turn < coordinates:
            np.minimum.at(least, ((drawn >> np.uint64(55)) % np.uint64(coordinates)).astype(np.int64), values)
        else:
            least[turn - coordinates] = min(least[turn - coordinates], values.min())
        if (least != nothing).all():
            break
    return least


def hashed(phrases: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, phrases), np.uint64, len(phrases))


def printed(least: np.ndarray | None) -> str:
    """The last hex digits of all coordinates end to end; ``EMPTY`` without any."""
    if least is None:
        return EMPTY
    return least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def likeness(left: str, right: str) -> float:
    """The share of coordinates in which two fingerprints agree; texts without phrases are like each other alone."""
    if not left or not right:
        return float(left == right)
    a, b = (np.frombuffer(bytes.fromhex(x), f">u{DIGITS // 2}") for x in (left, right))
    return float((a == b).mean())


class Parsed:
    """A text with its phrases' ends, hashes and fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.phrases, self.ends = parse(text)
        self.hashes = hashed(self.phrases)
        self.print = printed(sketch(self.hashes))

    def edited(self, other: str) -> tuple[str, str]:
        """This text with its last third replaced by the first code points of ``other``, and that text's fingerprint.

        What both texts begin with is parsed once: phrases that end there are kept.
        """
        kept = len(self.text) - len(self.text) // 3
        text = self.text[:kept] + other[: len(self.text) // 3]
        shared = int(np.searchsorted(self.ends, kept, "right"))
        first = self.ends[shared - 1] if shared else 0
        phrases, _ = parse(text, first, set(self.phrases[:shared]))
        return text, printed(sketch(np.concatenate([self.hashes[:shared], hashed(phrases)])))


def _fingerprint_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(run, ahead, doc_id, text)`` sorted; the last row of a run, ``ahead``, only follows the one before it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        out = []
        for run, ahead, doc_id, text in zip(*[batch.column(c) for c in ("run", "ahead", "doc_id", "text")]):
            run, found = run.as_py(), Parsed(text.as_py() or "")
            if held is not None and held[0] == run:
                _, of, before = held
                text, print_ = before.edited(found.text)
                digest = hashlib.sha256(text.encode()).hexdigest()
                near = likeness(before.print, print_), likeness(before.print, found.print)
                out.append((of, len(before.text), digest, before.print, print_, *near))
            held = None if ahead.as_py() else (run, doc_id.as_py(), found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _searched(sorted_keys: Column, count: int, key: Column) -> Column:
    """How many of ``count`` sorted keys are at most ``key``, by halving."""

    def further(step: int):
        return lambda at: at + F.when(F.get(sorted_keys, at + (step - 1)) <= key, step).otherwise(0)

    found, step = F.lit(0), 1 << max(count.bit_length() - 1, 0)
    while step:
        found, step = bind(found, further(step)), step >> 1
    return found


def fingerprints(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like it is to that text and to the next document.

    Next is the document of the next smaller ``doc_id``; the first follows the last. Null ids come last, rows of equal id
    stand by a hash of their text. The edited text ends in the first code points of the next one, as many as a third of
    the document. Null text counts as empty: an empty text has an empty fingerprint, which is like itself (1) and unlike
    any other (0). Repeated rows stay, an only row is next to itself, an empty table gives no row; other columns don't
    matter, whatever their names.

    Whole texts are shuffled once, by ranges of the order; the first row of each run goes to the run before as well, so
    every task sees each document beside its next one and holds two at a time. The runs' first keys, one per run, are all
    that the driver sees. ``runs`` defaults to the number of shuffle partitions.
    """
    spark = docs.sparkSession
    runs = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.bitwise_not(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).alias("down"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", place.alias("place"))
    dealt = rows.select("place").repartitionByRange(runs, "place")
    firsts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("place").alias("place")).orderBy("place")
    firsts = [r["place"] for r in firsts.collect()]
    if not firsts:
        return spark.createDataFrame([], RESULT)
    keys = F.array(
        *[F.struct(F.lit(k["none"]).alias("none"), F.lit(k["down"]).cast("bigint").alias("down"), F.lit(k["tie"]).cast("bigint").alias("tie")) for k in firsts]
    )
    placed = rows.withColumn("run", _searched(keys, len(firsts), F.col("place")) - 1)
    opens = F.get(keys, F.col("run")) == F.col("place")
    before = F.pmod(F.col("run") - 1, F.lit(len(firsts)))
    own = F.struct("run", F.lit(False).alias("ahead"))
    copies = F.when(opens, F.array(own, F.struct(before.alias("run"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    spread = placed.select("doc_id", "text", "place", F.inline(copies))
    sorted_runs = spread.repartitionById(len(firsts), "run").sortWithinPartitions("run", "ahead", "place")
    return sorted_runs.select("run", "ahead", "doc_id", "text").mapInArrow(_fingerprint_runs, RESULT)
