"""Near duplicates by fast similarity sketching, banding, exact verification and connected components.

A text's set is its distinct word shingles. Sketching hashes the set in rounds: in each of the first ``SKETCH`` rounds
every element falls into a random bin, in the later ones all elements go to one bin each, so every coordinate fills;
a coordinate keeps the least (round, hash). Texts with equal sets are one node. Runs of ``ROWS`` coordinates are bands;
nodes that share a band meet in its bucket.

A bucket's members are compared with its centre, a member chosen by hash, not with each other; links hold after the full
sets are compared. Where a bucket still holds several components, the member with most links is a second centre. What is still apart in a shared bucket after that is compared with the members of other components there,
unless elements that hardly anybody else has rule the link out. So no pair within a component is needed, and no link that joins
two components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampwise.llm.common import SPACES, lower_ascii, map_texts, mixed, slices, spans_of_words, text_bytes, word_hashes
from ampwise.session import stage

WORDS = 5
SIMILARITY = 80  # percent
BANDS, ROWS = 30, 5  # a pair at 0.8 shares no band with probability 7e-6
SKETCH = BANDS * ROWS
RARE = 8
ORDERS = 6  # of centres; more of them link graded groups in fewer searches, fewer move less
FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, sorted by both; fewer words than a shingle's make one shingle."""
    data = lower_ascii(data)
    first, after = spans_of_words(data, starts, ~SPACES)
    row = np.searchsorted(starts, first, "right") - 1
    value = word_hashes(data, first, after)
    count = np.bincount(row, minlength=len(starts) - 1)
    begin = np.cumsum(count) - count
    rows, hashes = [], []
    full = np.flatnonzero(np.arange(len(first)) + words <= (begin + count)[row])
    if len(full):
        total = np.zeros(len(full), np.uint64)
        for k in range(words):
            total += value[full + k] * FACTORS[k]
        rows.append(row[full])
        hashes.append(mixed(total))
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        if len(short):
            total = np.full(len(short), n, np.uint64)
            for k in range(n):
                total += value[begin[short] + k] * FACTORS[k]
            rows.append(short)
            hashes.append(mixed(total))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def sketches(row: np.ndarray, value: np.ndarray, n: int, size: int = SKETCH) -> np.ndarray:
    """For each of ``n`` rows the ``size`` coordinates of its set; rows without elements keep empty ones."""
    table = np.full(n * size, NOTHING, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for turn in range(2 * size):
        if not len(row):
            break
        hashed = mixed(value + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = (hashed >> np.uint64(32)) % np.uint64(size) if turn < size else np.uint64(turn - size)
        np.minimum.at(table, row * size + bins.astype(np.int64), np.uint64(turn) << np.uint64(32) | hashed & low)
        open_rows = (table.reshape(n, size) == NOTHING).any(axis=1)
        left = open_rows[row]
        row, value = row[left], value[left]
    return table.reshape(n, size)


def _sketch_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts = text_bytes(part.column("text"))
                n = len(starts) - 1
                row, value = shingles(data, starts, words)
                bounds = np.searchsorted(row, np.arange(n + 1))
                table = sketches(row, value, n).reshape(n, BANDS, ROWS)
                keys = np.zeros((n, BANDS), np.uint64)
                for k in range(ROWS):
                    keys = mixed(keys + table[:, :, k] * FACTORS[k])
                keys = mixed(keys + np.arange(BANDS, dtype=np.uint64) * FACTORS[ROWS])
                nodes = [
                    hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                full = np.diff(bounds) > 0
                offsets = np.append(0, np.cumsum(full * BANDS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array(np.diff(bounds)),
                        pa.array(nodes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel().view(np.int64))),
                    ],
                    ["doc_id", "text_key", "n_shingles", "node", "bands"],
                )

    return run


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts = text_bytes(part.column("text"))
                row, value = shingles(data, starts, words)
                bounds = np.searchsorted(row, np.arange(len(starts))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], ["node", "elements"])

    return run


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def possible(n: Column, other: Column, percent: int) -> Column:
    """Whether sets of so many elements can have 100 * intersection >= percent * union."""
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union; sizes are known to allow it."""
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    small, large = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .where(100 * shared >= percent * (small + large - shared))
        .select("a", "b")
    )


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, label) for every node of the links (a, b): the least node reachable, by alternating stars.

    A large star links the greater neighbours of a node to its least one, a small star the others; both keep components
    and end in stars. Links are staged after each round; only their number reaches the driver.
    """

    def star(edges: DataFrame, greater: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if greater else edges.select(
            F.col("b").alias("a"), F.col("a").alias("b")
        )
        least = stage(both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "at")))
        near = both.join(least, F.col("a") == F.col("at"))
        if greater:
            near = near.where("b > a").select(F.col("m").alias("a"), "b")
        else:
            near = near.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("at").alias("b")))
        return near.where("a < b").distinct()

    edges, before = stage(links.select(*_pair(F.col("a"), F.col("b"))).where("a < b").distinct()), None
    for _ in range(most_rounds):
        edges = stage(star(stage(star(edges, True)), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
            )
        before = now
    raise RuntimeError(f"components still changed after {most_rounds} rounds")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(l_node, label) with the labels that links join made one."""
    one = labels.select(F.col("l_node").alias("a"), F.col("label").alias("label_a"))
    two = labels.select(F.col("l_node").alias("b"), F.col("label").alias("label_b"))
    joined = links.join(one, "a").join(two, "b").where("label_a != label_b")
    found = components(joined.select(*_pair(F.col("label_a"), F.col("label_b"))).distinct())
    found = found.select(F.col("node").alias("old"), F.col("label").alias("new"))
    return stage(labels.join(found, F.col("label") == F.col("old"), "left").select("l_node", F.coalesce("new", "label").alias("label")))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, label, most): members of the buckets that hold several labels, with the label that most of them have.

    Buckets of two are left out: their only pair has been compared.
    """
    held = stage(members.join(labels, F.col("node") == F.col("l_node")).select("band", "node", "n", "label"))
    counts = held.groupBy("band", "label").agg(F.count("*").alias("times"))
    counts = counts.groupBy("band").agg(
        F.count("*").alias("labels"), F.sum("times").alias("times"), F.max(F.struct("times", "label")).alias("most")
    )
    counts = stage(counts.where("labels > 1 and times > 2").select("band", F.col("most.label").alias("most")))
    return stage(held.join(counts, "band"))


def _rare_elements(sets: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(u_node, common) and (a, b), for nodes (node, n, label).

    An element is rare if at most ``RARE`` of the nodes have it. The pairs are all those of different labels, and of sizes
    that allow a link, that share a rare element. Other pairs share no more than the smaller of their numbers of
    ``common`` elements, so many of them need no comparison.
    """
    held = sets.join(nodes, "node").select("node", "n", "label", F.explode("elements").alias("element"))
    rare = stage(held.groupBy("element").agg(F.count("*").alias("times")).where(f"times <= {RARE}").select("element"))
    rare = stage(held.join(rare, "element"))
    other = rare.select("element", F.col("node").alias("o_node"), F.col("n").alias("o_n"), F.col("label").alias("o_label"))
    alike = rare.join(other, "element").where("node < o_node and label != o_label").where(possible(F.col("n"), F.col("o_n"), percent))
    alike = alike.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()
    alone = rare.groupBy(F.col("node").alias("r_node")).agg(F.count("*").alias("alone"))
    common = F.col("n") - F.coalesce(F.col("alone"), F.lit(0))
    counted = nodes.join(alone, F.col("node") == F.col("r_node"), "left")
    return counted.select(F.col("node").alias("u_node"), common.alias("common")), alike


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) per row of ``docs``.

    Rows are linked when their sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more; a
    component's id is the least doc_id in it. A text without words has an empty set and is linked with nothing. Equal
    texts are linked, repeated rows included; rows with the component's id are all kept. A null id is never the least:
    such a row is kept only if its component has no other id. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    schema = "doc_id long, text_key long, n_shingles long, node binary, bands array<long>"
    rows = stage(map_texts(source, _sketch_batches(words), schema))
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("at")
    )
    nodes = stage(nodes)
    banded = nodes.select("node", "n", F.posexplode("bands").alias("place", "band"))
    shared = stage(banded.groupBy("band").agg(F.count("*").alias("times")).where("times > 1").select("band"))
    members = stage(banded.join(shared, "band"))
    # A few orders of centres for all bands: a group that shares many buckets has few centres, so its sets move few times.
    drawn = F.struct(F.xxhash64("node", F.col("place") % ORDERS).alias("h"), "node", "n")
    centre = members.groupBy("band").agg(F.min(drawn).alias("c"))
    centre = stage(centre.select("band", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")))
    pairs = members.join(centre, "band").where("node != centre").where(possible(F.col("n"), F.col("centre_n"), percent))
    pairs = stage(pairs.select(*_pair(F.col("node"), F.col("centre"))).distinct())

    wanted = members.select("node").distinct().join(nodes.select("node", "at"), "node")
    wanted = wanted.select("node", F.col("at.doc_id").alias("at_id"), F.col("at.text_key").alias("at_key"))
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key"))
    texts = source.join(wanted, same).select("node", "text")
    sets = stage(map_texts(texts, _set_batches(words), "node binary, elements array<long>"))
    if sets.count() > sets.select("node").distinct().count():  # rows repeated in id and text
        sets = stage(sets.dropDuplicates(["node"]))

    links = stage(verified(pairs, sets, percent))
    start = members.select(F.col("node").alias("l_node"), F.col("node").alias("label")).distinct()
    labels = _relabelled(start, links)

    # second centre: the member with most links, against what is still apart from it
    apart = _apart(members, labels)
    linked = links.select(F.col("a").alias("d_node")).unionByName(links.select(F.col("b").alias("d_node")))
    linked = linked.groupBy("d_node").agg(F.count("*").alias("degree"))
    ranked = apart.join(linked, F.col("node") == F.col("d_node"), "left")
    second = ranked.groupBy("band").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), "node", "label", "n")).alias("c"))
    second = second.select("band", F.col("c.node").alias("centre"), F.col("c.label").alias("c_label"), F.col("c.n").alias("centre_n"))
    tried = apart.join(stage(second), "band").where("label != c_label").where(possible(F.col("n"), F.col("centre_n"), percent))
    tried = tried.select(*_pair(F.col("node"), F.col("centre"))).distinct()
    tried = stage(tried.join(pairs, ["a", "b"], "left_anti"))
    labels = _relabelled(labels, stage(verified(tried, sets, percent)))

    # the rest: members of other components, unless their common elements are too few
    apart = _apart(members, labels)
    sizes, alike = _rare_elements(sets, apart.select("node", "n", "label").distinct(), percent)
    apart = apart.join(sizes, F.col("node") == F.col("u_node")).drop("u_node").join(nodes.select("node", "bands"), "node")
    apart = stage(apart)
    asking = apart.where("label != most").select("band", *(F.col(c).alias(f"a_{c}") for c in ("node", "label", "n", "common", "bands")))
    most_shared = F.least("common", "a_common")
    open_still = 100 * most_shared >= percent * (F.col("n") + F.col("a_n") - most_shared)
    first_band = F.array_min(F.array_intersect("bands", "a_bands")) == F.col("band")  # a pair comes up in one bucket only
    late = (
        asking.join(apart, "band")
        .where((F.col("a_label") != F.col("label")) & open_still & first_band)
        .select(*_pair(F.col("a_node"), F.col("node")))
        .unionByName(alike)
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
        .join(tried, ["a", "b"], "left_anti")
    )
    labels = _relabelled(labels, stage(verified(stage(late), sets, percent)))
    named = nodes.select("node").join(labels, F.col("node") == F.col("l_node"), "left").select("node", F.coalesce("label", "node").alias("label"))
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = stage(named.join(ids, "node"))
    least = named.groupBy(F.col("label").alias("c_label")).agg(F.min("least").alias("component"))
    known = stage(named.join(stage(least), F.col("label") == F.col("c_label")).select(F.col("node").alias("k_node"), "component"))
    found = rows.join(known, F.col("node") == F.col("k_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return found.select(
        "doc_id",
        "text_key",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are kept, one document of each component."""
    gone = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("gone_key"))
    return docs.join(gone, same, "left_anti")
