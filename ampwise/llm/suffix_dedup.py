"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash over 16 bytes sets triggers; the bytes between triggers are phrases. Each window of ``width`` bytes
has an *anchor*: the least-hashed run of three phrases inside it, or else the least-hashed phrase. Equal windows have equal anchors at the same
place, so neighbouring windows of one anchor travel together as a *fragment* and meet their equals in one group; a
window without whole phrases, as in periodic text, is a fragment of its own with all its places in the document. An
anchor seen once holds nothing repeated, and equal fragments settle each other without their bytes. For the other
groups, the phrases of the fragments make a dictionary and a parse; their suffix arrays combine into corpus order, in
which windows are repeated that share ``width`` bytes with a neighbour.

Groups of more than ``GROUP_ROWS`` occurrences would load single tasks: their windows are counted by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampwise.llm.common import RangeLeast, SpanHashes, map_texts, slices, text_bytes
from ampwise.session import stage

WIDTH = 400
TRIGGER_BYTES = 16
TRIGGER_SHIFT = 60  # one trigger in 16 bytes
PHRASES = (3, 1)  # adjacent phrases of an anchor; the later number where a window has no such run
GROUP_ROWS = 128
BATCH_BYTES = 1 << 20

FRAGMENTS = "doc_id long, text_key long, anchor long, f1 long, f2 long, first int, n int, places array<int>"
FOUND = "anchor long, f1 long, f2 long, starts array<int>"
WINDOWS = "h1 long, h2 long, anchor long, f1 long, f2 long, start int, copies long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def triggers(data: np.ndarray) -> np.ndarray:
    """Ends of the 16-byte windows whose hash is a trigger."""
    if len(data) < TRIGGER_BYTES:
        return np.zeros(0, np.int64)
    held = np.ascontiguousarray(data)
    words = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    hashed = words[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    hashed = (hashed ^ hashed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero(hashed >> np.uint64(TRIGGER_SHIFT) == 0) + TRIGGER_BYTES


def _cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigger ends whose window lies in one row, and their rows."""
    ends = triggers(data)
    row = np.searchsorted(starts, ends - TRIGGER_BYTES, "right") - 1
    inside = ends <= starts[row + 1]
    return ends[inside], row[inside]


def fragments(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, first and last window start of each fragment, the hashes, and offsets and values of ``places``.

    Windows without whole phrases stand alone, equal ones of a row together; ``places`` are their starts from the first.
    """
    cuts, row = _cuts(data, starts)
    hashes = SpanHashes(data)
    runs = [np.flatnonzero(row[:-n] == row[n:]) for n in PHRASES]
    opens = [cuts[own] - TRIGGER_BYTES for own in runs]
    closes = [cuts[own + n] if len(own) else cuts[:0] for own, n in zip(runs, PHRASES)]
    value = np.concatenate([hashes.of(a, b) for a, b in zip(opens, closes)])
    rows = np.flatnonzero(np.diff(starts) >= width)
    events = [starts[rows], starts[rows + 1] - width + 1]
    events = np.unique(np.concatenate([*events, *(a + 1 for a in opens), *(b - width for b in closes)]))
    at = np.clip(np.searchsorted(starts, events, "right") - 1, 0, len(starts) - 2)
    valid = (events >= starts[at]) & (events + width <= starts[at + 1])
    after = np.append(events[1:], 0)[valid]
    events, at = events[valid], at[valid]
    anchor, offset = np.full(len(events), -1), 0
    for a, b in zip(opens, closes):
        low = np.searchsorted(a, events, "left")
        high = np.searchsorted(b, events + width, "right") - 1
        some = np.flatnonzero((low <= high) & (anchor < 0))
        if len(some):
            longest = int((high[some] - low[some]).max()) + 1
            anchor[some] = offset + RangeLeast(value[offset : offset + len(a)], longest).at(low[some], high[some])
        offset += len(a)
    fresh = np.ones(len(events), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1])
    head = np.flatnonzero(fresh)
    last = after[np.append(head[1:], len(events)) - 1] - 1 if len(head) else after[:0]
    head_row, head_first, head_anchor = at[head], events[head], anchor[head]
    alone = head_anchor < 0
    lengths = np.where(alone, last - head_first + 1, 0)
    spread = np.repeat(head_first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    spread_row, spread_value = np.repeat(head_row, lengths), hashes.of(spread, spread + width)
    order = np.lexsort((spread, spread_value, spread_row))
    spread, spread_row, spread_value = spread[order], spread_row[order], spread_value[order]
    lead = np.ones(len(spread), bool)
    lead[1:] = (spread_row[1:] != spread_row[:-1]) | (spread_value[1:] != spread_value[:-1])
    lead = np.flatnonzero(lead)
    places = spread - np.repeat(spread[lead], np.diff(np.append(lead, len(spread))))
    named = ~alone
    return (
        np.concatenate([head_row[named], spread_row[lead]]),
        np.concatenate([value[head_anchor[named]], spread_value[lead]]),
        np.concatenate([head_first[named], spread[lead]]),
        np.concatenate([last[named], spread[lead]]),
        hashes,
        np.concatenate([np.zeros(int(named.sum()), np.int64), lead, [len(spread)]]),
        places,
    )


def _fragment_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts = text_bytes(part.column("text"))
                row, anchor, first, last, one, offsets, places = fragments(data, starts, width)
                bare = np.append(np.diff(offsets) == 0, False)
                two = SpanHashes(data, 1)
                after = last + width
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        part.column("text_key").take(pa.array(row)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(one.of(first, after).view(np.int64)),
                        pa.array(two.of(first, after).view(np.int64)),
                        pa.array((first - starts[row]).astype(np.int32)),
                        pa.array((after - first).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=bare), pa.array(places.astype(np.int32))),
                    ],
                    ["doc_id", "text_key", "anchor", "f1", "f2", "first", "n", "places"],
                )

    return run


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def dictionary_ranks(data: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Suffix array of the dictionary as ranks: the order of each phrase suffix, cut at ``width`` bytes, equal ones tied.

    ``left`` holds the bytes left in the phrase at each place. Doubling starts from eight bytes at once.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)
    short = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
    rank = _ranked(key >> short << short).astype(np.int64)
    count = np.bincount(rank)
    rank = (np.cumsum(count) - count)[rank]  # the place of the first equal one, so that refined groups stay within theirs
    depth = 8
    while depth < width:
        step = min(depth, width - depth)
        tied = np.flatnonzero(np.bincount(rank)[rank] > 1)
        if not len(tied) or not (left[tied] > depth).any():
            break
        follows = np.where(left[tied] > step, rank[np.minimum(tied + step, len(rank) - 1)] + 1, 0)
        both = rank[tied] << 32 | follows
        order = np.argsort(both, kind="stable")
        old, both = rank[tied][order], both[order]
        at = np.arange(len(order))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        same = np.maximum.accumulate(np.where(np.append(True, both[1:] != both[:-1]), at, 0))
        refined = rank.copy()
        refined[tied[order]] = old + same - group
        rank = refined
        depth += step
    return rank


def repeated_windows(parts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each part the starts of windows that also start elsewhere in the parts, from suffix arrays of the parse."""
    data = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)  # 0xff is in no UTF-8 text
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    ends = np.union1d(_cuts(data, starts)[0], starts[1:])
    row = np.searchsorted(starts, ends - 1, "right") - 1
    fresh = np.append(True, row[1:] != row[:-1])
    begins = np.where(fresh, starts[row], np.append(0, ends[:-1]) - TRIGGER_BYTES)
    raw, ids, phrases = data.tobytes(), np.zeros(len(ends), np.int64), {}
    for k, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
        ids[k] = phrases.setdefault(raw[a:b], len(phrases))
    dictionary = np.frombuffer(b"".join(phrases), np.uint8)
    size = np.fromiter(map(len, phrases), np.int64, len(phrases))
    home = np.cumsum(size) - size
    rank = dictionary_ranks(dictionary, np.repeat(home + size, size) - np.arange(len(dictionary)), width)

    # order of the parse: ranks of phrases, doubled; a phrase that closes its part has none behind
    symbol = _ranked(rank[home][ids]) + np.uint64(1)
    step = 1
    while step < width:
        behind = np.zeros(len(ends), np.uint64)
        if step < len(ends):
            behind[:-step] = np.where(row[step:] == row[:-step], symbol[step:], np.uint64(0))
        doubled = _ranked(symbol << np.uint64(32) | behind) + np.uint64(1)
        done = doubled.max() == symbol.max()
        symbol, step = doubled, 2 * step
        if done:
            break
    order = np.argsort(symbol, kind="stable")
    place = np.empty(len(ends), np.int64)
    place[order] = np.arange(len(ends))
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    common = np.full(len(ends), width, np.int64)  # shared bytes of each parse suffix with the one before it
    for a in range(1, len(order), 4096):
        rows = order[a - 1 : a + 4096]
        text = np.lib.stride_tricks.sliding_window_view(padded, width)[begins[rows]]
        differ = text[1:] != text[:-1]
        common[a : a + len(rows) - 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)

    # corpus order of the windows: rank of the phrase suffix, then of the parse behind it
    long_enough = np.diff(starts) - 1 >= width
    window = np.concatenate([np.arange(s, e - width) for s, e, ok in zip(starts, starts[1:], long_enough) if ok] or [[]])
    window = window.astype(np.int64)
    own = np.searchsorted(ends, window + TRIGGER_BYTES, "right")
    left = ends[own] - window
    suffix = rank[home[ids[own]] + window - begins[own]]
    follows = place[np.minimum(own + 1, len(ends) - 1)]
    follows = np.where(left >= width, 0, follows)
    corpus = np.argsort(suffix << 32 | follows, kind="stable")
    one, two = corpus[:-1], corpus[1:]
    near = np.flatnonzero(suffix[one] == suffix[two])
    one, two = one[near], two[near]
    low, high = follows[one] + 1, follows[two]
    shared = np.full(len(near), width, np.int64)
    some = np.flatnonzero(low <= high)
    if len(some):
        least = RangeLeast(common, int((high[some] - low[some]).max()) + 1).at(low[some], high[some])
        shared[some] = common[least]
    reach = np.where(left[one] >= width, width, left[one] - TRIGGER_BYTES + shared)
    hit = np.zeros(len(window), bool)
    hit[one[reach >= width]] = True
    hit[two[reach >= width]] = True
    found = window[hit]
    bounds = np.searchsorted(found, starts)
    return [found[a:b] - s for a, b, s in zip(bounds, bounds[1:], starts)]


def _distinct_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted fragments, one for each fragment."""
    before = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "f1", "f2", "copies", "content"))):
            if row[:3] != before:
                before = row[:3]
                yield row


def _found_batch(keys: list[tuple], starts: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0] + [len(s) for s in starts]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *starts]).astype(np.int32)
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
    return pa.RecordBatch.from_arrays(columns, ["anchor", "f1", "f2", "starts"])


def _suffix_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, size = [], [], 0
        for anchor, f1, f2, _, content in _distinct_rows(batches):
            if size > BATCH_BYTES and anchor != keys[-1][0]:
                yield _found_batch(keys, repeated_windows(parts, width))
                keys, parts, size = [], [], 0
            keys.append((anchor, f1, f2))
            parts.append(content)
            size += len(content)
        if keys:
            yield _found_batch(keys, repeated_windows(parts, width))

    return run


def _window_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, f1, f2, copies, content in _distinct_rows(batches):
            data = np.frombuffer(content, np.uint8)
            first = np.arange(len(data) - width + 1)
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(SpanHashes(data, k).of(first, first + width).view(np.int64)) for k in (0, 1)]
                + [pa.array(np.full(n, x, np.int64)) for x in (anchor, f1, f2)]
                + [pa.array(first.astype(np.int32)), pa.array(np.full(n, copies, np.int64))],
                ["h1", "h2", "anchor", "f1", "f2", "start", "copies"],
            )

    return run


def removed_bytes(size: int, starts: np.ndarray, spans: pa.ListArray, width: int) -> np.ndarray:
    """Which of ``size`` bytes the rows' spans cover; a span (first, n, starts) without starts covers all of its bytes."""
    marks = np.zeros(size + 1, np.int64)
    rows = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
    own = spans.flatten()
    base = starts[rows] + own.field("first").to_numpy()
    windows = own.field("starts")
    whole = windows.is_null().to_numpy(zero_copy_only=False)
    np.add.at(marks, base[whole], 1)
    np.add.at(marks, (base + own.field("n").to_numpy())[whole], -1)
    at = np.repeat(base, windows.value_lengths().fill_null(0).to_numpy()) + windows.flatten().to_numpy()
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return np.cumsum(marks[:-1]) > 0


def _cut_batches(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts = text_bytes(part.column("text"))
                gone = removed_bytes(len(data), starts, part.column("spans"), width)
                fresh = gone.copy()
                fresh[1:] &= ~gone[:-1]
                edges = starts[:-1][np.diff(starts) > 0]
                fresh[edges] = gone[edges]
                removed, runs = (np.append(0, np.cumsum(x)) for x in (gone, fresh))
                removed, runs = np.diff(removed[starts]), np.diff(runs[starts])
                kept = [
                    data[a:b][~gone[a:b]].tobytes() if n else data[a:b].tobytes()
                    for a, b, n in zip(starts[:-1].tolist(), starts[1:].tolist(), removed.tolist())
                ]
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(starts)),
                    pa.array(removed),
                    pa.array(runs),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeats(docs: DataFrame, width: int = WIDTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, text_key, spans): where windows of ``width`` bytes start that also start elsewhere.

    A span (first, n, starts) stands for the windows at first + starts, or without starts for all in [first, first + n).
    Rows are keyed by doc_id and a hash of the text, so null and repeated ids are safe; texts without spans have no row.
    """
    source = _keyed(docs)
    times = F.coalesce(F.when(F.col("places").isNotNull(), F.size("places")), F.lit(1))
    every = stage(map_texts(source, _fragment_batches(width), FRAGMENTS))
    seen = stage(
        every.groupBy("anchor")
        .agg(
            F.sum(times).alias("total"),
            ((F.min("f1") != F.max("f1")) | (F.min("f2") != F.max("f2"))).alias("differ"),
        )
        .where("total > 1")
    )
    hits = stage(every.join(seen, "anchor"))
    key = ["anchor", "f1", "f2"]
    unequal = stage(
        hits.where("differ")
        .groupBy(key)
        .agg(F.sum(times).alias("copies"), F.max("total").alias("total"), F.min(F.struct("doc_id", "text_key", "first", "n")).alias("at"))
    )
    wanted = unequal.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(
        F.collect_list(F.struct(*key, "copies", "total", F.col("at.first").alias("first"), F.col("at.n").alias("n"))).alias("wanted")
    )
    content = (
        _joined(source, wanted, "inner")
        .select(
            F.explode(
                F.transform(
                    "wanted",
                    lambda w: F.struct(
                        *(w[c].alias(c) for c in [*key, "copies", "total"]),
                        F.substring(F.col("text").cast("binary"), w["first"] + 1, w["n"]).alias("content"),
                    ),
                )
            ).alias("w")
        )
        .select("w.*")
    )
    content = stage(content)
    columns = [*key, "copies", "content"]
    small = content.where(F.col("total") <= group_rows).select(columns)
    small = small.repartition("anchor").sortWithinPartitions(key).mapInArrow(_suffix_batches(width), FOUND)
    large = content.where(F.col("total") > group_rows).select(columns)
    large = large.repartition(*key).sortWithinPartitions(key)
    windows = stage(large.mapInArrow(_window_batches(width), WINDOWS))
    twice = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("copies")).where("copies > 1").drop("copies")
    large = windows.drop("copies").join(twice, ["h1", "h2"]).groupBy(key).agg(F.collect_list("start").alias("starts"))
    whole = unequal.where("copies > 1").select(*key, F.lit(None).cast("array<int>").alias("starts"))
    found = whole.unionByName(small.where(F.size("starts") > 0)).unionByName(large)
    # a fragment that occurs twice is repeated as a whole; what was found in it besides adds nothing
    settled = hits.where(~F.col("differ")).withColumn("starts", F.lit(None).cast("array<int>"))
    span = ["doc_id", "text_key", "first", "n", F.coalesce("places", "starts").alias("starts")]
    spans = settled.select(span).unionByName(hits.where("differ").join(found, key).select(span))
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "n", "starts")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _joined(source: DataFrame, other: DataFrame, how: str) -> DataFrame:
    renamed = other.withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"})
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_key") == F.col("other_key"))
    return source.join(renamed, same, how)


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, and the SHA-256 of the bytes that stay; ``kept`` on demand.

    A null text counts as empty. Texts under ``width`` bytes lose nothing. Repeated rows are occurrences like any other,
    so a repeated text of ``width`` bytes or more goes as a whole. Only ``doc_id`` and ``text`` are read; an empty table
    gives no rows. ``kept`` is binary: what stays may end inside a character.
    """
    spans = repeats(docs, width, group_rows)
    schema = RESULT + (", kept binary" if keep_text else "")
    joined = _joined(_keyed(docs), spans, "left").select("doc_id", "text", "spans")
    return map_texts(joined, _cut_batches(width, keep_text), schema)
