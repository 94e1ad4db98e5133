"""A Merkle manifest of a table: one tree of rows per group, one tree over the groups, proofs for every row.

Every node's digest is the SHA-256 (lower-case hex) of its children's digests end to end, eight children a node, the last
node of a level fewer. A tree is kept as an append log: nodes stand in the order in which they are completed, a node right
after its last child. With ``leaf`` the last leaf below a node of level ``k``, ``leaf // 8**j`` nodes of every level ``j``
are complete before that leaf is appended and the levels below ``k`` close on it, so the node's position is

    sum(leaf // 8**j for j = 0 .. depth) + k

which needs no look at the tree. Builders work side by side on aligned runs of 8**3 leaves; the tops of the runs are the
leaves of the next layer, so no task sees more than one run. Proofs go down the layers again: a run's log gives the
siblings inside it by their positions, and what lies above its top is joined once per run, not per leaf.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampwise.llm.numbering import numbered
from ampwise.session import small, stage

# The Python functions of this module travel with their tasks, so executors need pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARITY = 8
RUN_LEVELS = 3
RUN = ARITY**RUN_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def framed(values: Sequence[Column]) -> Column:
    """Values end to end, each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    texts = [value.cast("string") for value in values]
    sized = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.concat(*[F.coalesce(s, F.lit("-")) for s in sized])


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(framed(values), 256)


def levels_above(leaves: int) -> int:
    """Levels between the leaves and the one node at the top."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def position(level: int, place: int, leaves: int, levels: int) -> int:
    """Where the node stands in the log of a tree of so many leaves and levels."""
    last = min((place + 1) * ARITY**level, leaves) - 1
    return sum(last // ARITY**j for j in range(levels + 1)) + level


def append(leaves: Sequence[str], levels: int) -> list[str]:
    """The log of an aligned run: every node once it is complete."""
    log, open_nodes = [], [[] for _ in range(levels + 1)]
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        open_nodes[0].append(leaf)
        for level in range(levels):
            kids = open_nodes[level]
            if len(kids) < ARITY and i + 1 < len(leaves):
                break
            log.append(hashlib.sha256("".join(kids).encode()).hexdigest())
            open_nodes[level] = []
            open_nodes[level + 1].append(log[-1])
    return log


def siblings(log: Sequence[str], leaf: int, leaves: int, levels: int) -> list[dict[str, str]]:
    """For each level from the leaf up, the digests left and right of its path, addressed by their positions."""
    found = []
    for level in range(levels):
        place = leaf // ARITY**level
        first = place - place % ARITY
        after = min(first + ARITY, -(-leaves // ARITY**level))
        left, right = (
            "".join(log[position(level, k, leaves, levels)] for k in span)
            for span in (range(first, place), range(place + 1, after))
        )
        found.append({"left": left, "right": right})
    return found


def _append_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            levels = min(RUN_LEVELS, levels_above(one.column("n")[0].as_py()))
            digests = one.column("leaves")[0].values.field("digest").to_pylist()
            yield one.append_column("log", pa.array([append(digests, levels)], pa.list_(pa.string())))


def _prove_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    for batch in batches:
        for row in range(batch.num_rows):
            tree, total, run, log, above = (batch.column(c)[row].as_py() for c in ("tree", "n", "run", "log", "above"))
            leaves = batch.column("leaves")[row].values
            levels = min(RUN_LEVELS, levels_above(total))
            paths = [siblings(log, k, len(leaves), levels) + above for k in range(len(leaves))]
            columns = [
                pa.array([tree] * len(leaves), pa.string()),
                pa.array([run * RUN + k for k in range(len(leaves))], pa.int64()),
                leaves.field("digest"),
                leaves.field("payload"),
                pa.array(paths, pa.list_(step)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "index", "digest", "payload", "path"])


def _place_nodes(layer: int):
    """The nodes of a layer's runs with their places in the whole tree; a run's leaves are the tops of the layer below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels, out, at = min(RUN_LEVELS, levels_above(row["n"])), [], 0
                deepest = levels_above(row["size"])
                for i in range(row["held"]):
                    for level in range(levels + 1):
                        if level and (i + 1) % ARITY**level and i + 1 < row["held"]:
                            break
                        if level or not layer:
                            up = layer * RUN_LEVELS + level
                            place = row["run"] * ARITY ** (RUN_LEVELS - level) + i // ARITY**level
                            out.append((row["tree"], position(up, place, row["size"], deepest), up, place, row["log"][at]))
                        at += 1
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column) for column in zip(*out)], names=["tree", "position", "level", "place", "digest"]
                    )

    return run


def _tops(runs: DataFrame) -> DataFrame:
    """Each run's last node, with its place in the layer above and the number of nodes there."""
    total = F.ceil(F.col("n") / RUN).alias("n")
    return runs.select("tree", "size", total, F.col("run").alias("index"), F.element_at("log", -1).alias("digest"))


def _layers(leaves: DataFrame) -> list[DataFrame]:
    """Staged layers of runs ``(tree, size, n, run, leaves, log)``, from the rows up to the runs that are whole trees.

    ``size`` counts the tree's rows and ``n`` its nodes where the layer begins. Small trees end early and pass through.
    """
    layers, largest = [], RUN + 1
    while largest > RUN:
        if layers:
            leaves = _tops(layers[-1]).withColumn("payload", F.lit(None).cast("string"))
        payload = leaves.schema["payload"].dataType.simpleString()
        entry = F.struct("index", "digest", "payload")
        run = F.floor(F.col("index") / RUN).alias("run")
        runs = leaves.groupBy("tree", "size", "n", run).agg(F.array_sort(F.collect_list(entry)).alias("leaves"))
        held = f"array<struct<index:bigint,digest:string,payload:{payload}>>"
        schema = f"tree string, size bigint, n bigint, run bigint, leaves {held}, log array<string>"
        layers.append(stage(runs.mapInArrow(_append_runs, schema)))
        largest = layers[-1].agg(F.max("n")).first()[0] or 0
    return layers


def _carried_down(layers: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves of the lowest layer with their paths, given the paths ``(tree, run, above)`` over the highest tops."""
    found = None
    for layer in reversed(layers):
        payload = layer.schema["leaves"].dataType.elementType["payload"].dataType.simpleString()
        schema = f"tree string, index bigint, digest string, payload {payload}, path {PATH}"
        runs = layer.join(above, ["tree", "run"]).select("tree", "n", "run", "leaves", "log", "above")
        found = runs.mapInArrow(_prove_runs, schema)
        above = found.select("tree", F.col("index").alias("run"), F.col("path").alias("above"))
    return found


@dataclass(frozen=True)
class Manifest:
    """The layers of the trees of rows, each tree's top ``(tree, subroot)``, and the layers of the tree over those."""

    layers: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]

    def log(self) -> DataFrame:
        """All nodes of the trees of rows: tree, position in its log, level, place in the level, digest."""
        parts = [
            layer.select("tree", "size", "n", "run", F.size("leaves").alias("held"), "log").mapInArrow(
                _place_nodes(k), "tree string, position bigint, level bigint, place bigint, digest string"
            )
            for k, layer in enumerate(self.layers)
        ]
        return reduce(DataFrame.unionByName, parts)

    def root(self) -> DataFrame:
        """One row with the digest over all; none for an empty table."""
        return _tops(self.upper[-1]).select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """One row per leaf: tree, index, digest, payload, ``path`` (digests left and right by level, up to the root)."""
        start = self.upper[-1].select("tree", "run", F.array().cast(PATH).alias("above"))
        subroots = _carried_down(self.upper, start)
        over = subroots.select(F.col("payload").alias("tree"), F.lit(0).cast("long").alias("run"), F.col("path").alias("above"))
        return _carried_down(self.layers, small(over))


def tree_name(group: Column) -> Column:
    """A string for every group, the null one first, in bytewise order; groups are told apart by it without nulls."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def build(
    rows: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    payload: Column | None = None,
) -> Manifest:
    """A tree per ``group`` over the digests of ``fields``, leaves ascending by ``order``, and one over the groups.

    Null counts as a group of its own, null orders come first, and rows of equal order stand by their digests, so the
    same rows give the same roots in whatever order they come. Repeated rows are leaves of their own. Other columns don't
    matter, whatever their names. ``payload`` is kept with each leaf. An empty table has no tree and no root.
    """
    payload = F.lit(None).cast("string") if payload is None else payload
    digest = leaf_digest([F.col(c) for c in fields])
    leaves = rows.select(
        tree_name(F.col(group)).alias("tree"), F.col(order).alias("_order"), digest.alias("digest"), payload.alias("payload")
    )
    placed = numbered(leaves, "tree", ["_order", "digest"]).withColumn("size", F.col("n"))
    layers = _layers(placed)
    subroots = stage(_tops(layers[-1]).select("tree", F.col("digest").alias("subroot")))
    named = subroots.select(F.lit("").alias("over"), "tree", F.col("subroot").alias("digest"))
    upper = numbered(named, "over", ["tree"]).withColumnsRenamed({"tree": "payload", "over": "tree"})
    return Manifest(layers, subroots, _layers(upper.withColumn("size", F.col("n"))))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def verify(rows: DataFrame, tampered: dict[str, Column], **shape) -> DataFrame:
    """Every row's proof, checked with the leaf of the row as ``tampered`` shows it (columns in place of fields).

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; the folded root is computed from the
    tampered leaf and the siblings of the manifest of the untampered rows.
    """
    fields = shape.get("fields", FIELDS)
    shown = leaf_digest([tampered.get(c, F.col(c)) for c in fields])
    manifest = build(rows, payload=F.struct(F.col(shape.get("order", "doc_id")).alias("key"), shown.alias("shown")), **shape)
    proofs = manifest.proofs().join(small(manifest.subroots), "tree").join(F.broadcast(manifest.root()))
    checked = proofs.withColumn("folded_root", folded(F.col("payload.shown")))
    return checked.select(
        F.col("payload.key").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest().alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
