"""Mixing sources to target weights.

Each source's documents are laid end to end in a hashed order and taken from the front until the source's target is
met; a source that gives more than it has starts again, at most ``MOST`` times in all. What is taken is cut into blocks
of words. A splitting tree over the output shards draws exactly how many blocks of each source every shard gets, and
each shard takes the next blocks of the permuted order; inside a shard rows are ordered by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampwise.llm.draws import even, split_tree
from ampwise.session import small, stage

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
SHARDS = 8
BLOCK_WORDS = 1 << 16  # at most
SHARD_BLOCKS = 64  # of a source in a shard, on average, as far as it has words
BUCKET_ROWS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, most: int = MOST) -> DataFrame:
    """Targets of (source, words): shares of all words by the weights 1, 2, 3 repeating over the sources by code point,
    null last; a target stops at ``most`` times the source's words, and the excess goes to the others by weight.

    With the sources in the order in which they reach their limit, the share a unit of weight gets is the greatest of
    (words left without those before) / (weights left). The table has one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = ((F.row_number().over(ordered) - 1) % 3 + 1).alias("weight")
    limits = totals.select("*", weight, (F.col("words") * most).alias("limit"))
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("words").over(everywhere) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weights = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shares = limits.select("*", F.struct((rest / weights).alias("share"), rest.alias("rest"), weights.alias("weights")).alias("at"))
    shares = shares.withColumn("top", F.max("at").over(everywhere))
    target = F.least(F.col("limit").cast("double"), F.col("top.rest").cast("double") * F.col("weight") / F.col("top.weights"))
    return shares.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("at", "top")


def _block_draws(shards: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sources in frame["sources"]:
                quotas = sorted((s["number"], s["blocks"]) for s in sources)
                blocks = [n for _, n in quotas]
                matrix = split_tree(blocks, even(sum(blocks), shards), seed)
                until = np.cumsum(np.array(matrix, dtype=np.int64).reshape(shards, len(blocks)), axis=0)
                yield pd.DataFrame({"number": [k for k, _ in quotas], "until": until.T.tolist()})

    return run


def draw_mix(
    docs: DataFrame, size: Column, shards: int = SHARDS, seed: int = 7, block_words: int = BLOCK_WORDS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(row, size, source_size, target, taken, copies): every row, as a struct, with what the mix takes of it.

    ``docs`` needs doc_id and source; ``size`` counts a row's words. ``copies`` has one (copy, words, shard) for each
    time the row is taken; only the row that meets its source's target may be taken in part, so a source gives its
    target rounded to whole words, laid in blocks over the shards. The order is a hash of doc_id and size, so reruns agree; rows that are equal in both
    may trade places. A null source is a source of its own, the last; rows without words are taken zero times. Columns
    of ``docs`` stay inside ``row``, so no name can clash. The table of sources is assumed to fit one task.
    """
    rows = stage(
        docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), size.alias("size")).withColumn(
            "mark", F.xxhash64(F.lit(seed), "row.doc_id", "size")
        )
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    targets = source_targets(totals)
    targets = targets.withColumn("quota", F.round("target").cast("long"))
    # Blocks are as fine as every shard needs to get its part of every source.
    fine = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("quota") / (shards * SHARD_BLOCKS))))
    targets = targets.withColumn("block", fine.cast("long"))
    targets = targets.withColumn("blocks", F.ceil(F.col("quota") / F.col("block")).cast("long"))
    targets = targets.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    matrix = targets.groupBy().agg(F.collect_list(F.struct("number", "blocks")).alias("sources"))
    matrix = matrix.mapInPandas(_block_draws(shards, seed), "number int, until array<long>")
    targets = targets.join(matrix, "number").select(
        F.col("source").alias("named"),
        "number",
        F.col("words").alias("source_size"),
        "target",
        "quota",
        "block",
        "until",
        F.ceil(F.col("n") / bucket_rows).cast("int").alias("buckets"),
    )
    share = F.shiftrightunsigned("mark", 11) / F.lit(float(1 << 53))
    rows = rows.join(small(targets), F.col("source").eqNullSafe(F.col("named"))).withColumn(
        "bucket", F.floor(share * F.col("buckets")).cast("int")
    )
    bucket = ["number", "bucket"]
    sums = rows.groupBy(bucket).agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*bucket, F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(bucket).orderBy("mark", "row.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, bucket)
    rows = rows.withColumn("start", F.col("ahead") + F.col("inside"))

    def copy(k: int) -> Column:
        at = F.col("start") + F.col("source_size") * k
        words = F.least(F.col("size"), F.col("quota") - at)
        block = F.floor(at / F.col("block"))
        shard = F.size(F.filter("until", lambda u: u <= block))
        return F.when(words > 0, F.struct(F.lit(k).alias("copy"), words.alias("words"), shard.alias("shard")))

    rows = rows.withColumn("copies", F.array_compact(F.array(*(copy(k) for k in range(MOST)))))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    return rows.select("row", "size", "source_size", "target", taken.alias("taken"), "copies")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """(row, shard, order): a row for each copy, whole documents only.

    The document that meets its source's target goes in if at least half of it is taken, so a source gives its target to
    within half a document. Written with ``repartition(shards, "shard").sortWithinPartitions("shard", "order")`` each shard
    comes out shuffled.
    """
    drawn = draw_mix(docs, word_count(F.col("text")), shards, seed).withColumn("c", F.explode("copies"))
    whole = drawn.where(2 * F.col("c.words") >= F.col("size"))
    order = F.xxhash64(F.lit(seed), "row.doc_id", "c.copy", "size")
    return whole.select("row", F.col("c.shard").alias("shard"), order.alias("order"))
