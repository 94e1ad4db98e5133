"""Quality rules: word and line counts, and bands of zstandard ratios.

Text that compresses far better than prose of its length repeats itself; text that hardly compresses is noise. Whole
documents are held against limits for their length, and so are fixed chunks, which show a spoilt part of a long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ampwise.llm.common import SPACES, byte_table, map_texts, mixed, slices, spans_of_words, text_bytes, word_hashes

LEVEL = 3
CHUNK_BYTES = 2048
#: Below so many bytes: least ratio of prose, greatest of text laden with symbols, greatest of prose. Ratios of clean prose
#: grow with length until the packer's window of 2 MB is full. Real prose reaches 2.8 at 8 KB, 3.0 at 16 KB and 3.9 at 1 MB;
#: text that repeats itself starts at 3.2 at 512 bytes, 4.5 at 2 KB and 6 at 4 KB.
BANDS = [
    (256, 0.50, 2.00, 2.20),
    (512, 1.10, 1.85, 2.50),
    (1024, 1.15, 2.08, 3.00),
    (2048, 1.25, 2.22, 3.30),
    (4096, 1.38, 2.32, 3.50),
    (8192, 1.38, 2.42, 3.70),
    (16384, 1.38, 2.50, 3.90),
    (32768, 1.38, 2.62, 4.10),
    *((32768 << k, 1.38, 2.80 + k / 10, 4.10 + k / 5) for k in range(1, 7)),
    (float("inf"), 1.38, 3.50, 5.50),
]
LADEN = 0.3  # symbols a word; symbols set between or behind words pack well and hide in the limits of prose
BAD_SHARE = 1 / 3  # of the bytes, in chunks outside their band
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
SYMBOL_BYTES = b"#*$%&|<>"
SYMBOLS = byte_table(*((c, c) for c in SYMBOL_BYTES))
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, bad_share double"
)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of a value per byte over the rows."""
    return np.diff(np.append(0, np.cumsum(values))[starts])


def repeated_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and those of them in a three-word window that the row has at least twice."""
    first, after = spans_of_words(data, starts, ~SPACES)
    row = np.searchsorted(starts, first, "right") - 1
    words = np.bincount(row, minlength=len(starts) - 1)
    covered = np.zeros(len(first), bool)
    if len(first) > 2:
        value = word_hashes(data, first, after)
        window = mixed(value[:-2] * np.uint64(3) + mixed(value[1:-1]) * np.uint64(5) + mixed(value[2:] + np.uint64(7)))
        own = np.flatnonzero(row[:-2] == row[2:])
        order = own[np.lexsort((window[own], row[own]))]
        equal = (window[order[1:]] == window[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        twice = np.concatenate([order[1:][equal], order[:-1][equal]])
        for k in range(3):
            covered[twice + k] = True
    return words, np.bincount(row[covered], minlength=len(starts) - 1)


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def in_band(raw: bytes, packed: int) -> bool:
    size = len(raw)
    least, laden, greatest = next(limits for below, *limits in BANDS if size < below)
    if least * packed <= size <= greatest * packed:
        return size <= laden * packed or size - len(raw.translate(None, SYMBOL_BYTES)) < LADEN * len(raw.split())
    return False


def compression(packer: zstandard.ZstdCompressor, raw: bytes) -> tuple[float, bool, float]:
    """Ratio of the whole text, whether it is in its band, and the share of bytes in chunks outside theirs."""
    if not raw:
        return 0.0, True, 0.0
    packed = len(packer.compress(raw))
    bad = 0
    if len(raw) > CHUNK_BYTES:
        for at in range(0, len(raw), CHUNK_BYTES):
            chunk = raw[at : at + CHUNK_BYTES]
            bad += 0 if in_band(chunk, len(packer.compress(chunk))) else len(chunk)
    return len(raw) / packed, in_band(raw, packed), bad / len(raw)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    for batch in batches:
        for part in slices(batch, "text"):
            data, starts = text_bytes(part.column("text"))
            words, repeated = repeated_words(data, starts)
            failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words)
            raw = [data[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            packed = [compression(packer, x) for x in raw]
            ratio, fits, bad = (np.array([p[k] for p in packed]) for k in range(3))
            kept = ~failed & fits.astype(bool) & (bad <= BAD_SHARE)
            columns = [
                part.column("doc_id"),
                *(
                    pa.array(x.astype(np.int64))
                    for x in (
                        words,
                        sums(~SPACES[data] & (data & 0xC0 != 0x80), starts),
                        sums(SYMBOLS[data], starts),
                        np.array([duplicate_lines(x) for x in raw]),
                        repeated,
                    )
                ),
                pa.array(failed),
                pa.array(kept),
                pa.array(ratio.astype(float)),
                pa.array(bad.astype(float)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def judge(docs: DataFrame) -> DataFrame:
    """Counts, compression and verdict of each row of ``docs``, see ``SCHEMA``; ``kept`` is the verdict of all rules.

    A null or empty text has no words and fails. Words are runs of bytes other than space and 9 to 13; characters are
    code points. Repeated rows are judged alike; only doc_id and text are read; an empty table gives no rows.
    """
    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), _batches, SCHEMA)


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        named = pa.RecordBatch.from_arrays(
            [pa.nulls(len(batch), pa.int64()), batch.column(batch.schema.get_all_field_indices("text")[0])], ["doc_id", "text"]
        )
        kept = [k for part in _batches(iter([named])) for k in part.column("kept").to_pylist()]
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all columns."""
    return map_texts(docs, _kept_batches, docs.schema)
