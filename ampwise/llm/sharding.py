"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into small buckets by a hash. How many rows each bucket sends to each shard is drawn exactly, first for
groups of buckets, then within each group, so that no task sees more than one group. A bucket permutes its rows and
deals them out by those counts; the rows are exchanged, and each shard permutes what it got, again by small buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampwise.llm.draws import draw, even
from ampwise.session import stage

SHARDS = 8
BUCKET_ROWS = 2048
GROUP_BUCKETS = 1024
LAW = "rows"


def _group_draws(shards: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for groups in frame["groups"]:
                totals = sorted((g["group"], g["n"]) for g in groups)
                left = even(sum(n for _, n in totals), shards)
                rng, out = np.random.default_rng(seed), []
                for group, n in totals:
                    sent = draw(rng, left, n)
                    left = [a - b for a, b in zip(left, sent)]
                    out.append((group, sent))
                yield pd.DataFrame(out, columns=["group", "quota"])

    return run


def _bucket_draws(seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, buckets, quota in zip(frame["group"], frame["buckets"], frame["quota"]):
                rng, left, out = np.random.default_rng([seed, int(group)]), [int(q) for q in quota], []
                for bucket, n in sorted((b["bucket"], b["n"]) for b in buckets):
                    sent = draw(rng, left, n)
                    left = [a - b for a, b in zip(left, sent)]
                    out.append((bucket, np.cumsum(sent).tolist()))
                yield pd.DataFrame(out, columns=["bucket", "until"])

    return run


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(bucket, until): running numbers of rows that each bucket of (bucket, n) sends to the shards, drawn exactly."""
    counts = counts.withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    buckets = counts.groupBy("group").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bucket", "n")).alias("buckets"))
    quotas = buckets.groupBy().agg(F.collect_list(F.struct("group", "n")).alias("groups"))
    quotas = quotas.mapInPandas(_group_draws(shards, seed), "group long, quota array<long>")
    return buckets.drop("n").join(quotas, "group").mapInPandas(_bucket_draws(seed), "bucket long, until array<long>")


def shard(
    docs: DataFrame, shards: int = SHARDS, seed: int = 11, bucket_rows: int = BUCKET_ROWS, carried: list[str] | None = None
) -> DataFrame:
    """(row, size, text_crc32, law, shard, slot, grown_shard): every row, as a struct, with its place.

    The law is ``rows``: shard sizes differ by one row at most; slots run from 0 without gaps. Size is the UTF-8 bytes
    of the text plus 1; a null text counts as empty. Null ids are rows like any other. Rows that are equal in doc_id and
    text are dealt out too; which of them gets which place is left open. ``grown_shard`` is null: this law promises
    nothing for another number of shards. Columns of ``docs`` stay inside ``row``, so no name can clash; ``carried``
    names those to carry besides doc_id, all by default.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    buckets = max(1, -(-docs.count() // bucket_rows))
    mark = lambda k: F.xxhash64(F.lit(seed + k), F.col("doc_id"), F.col("text"))
    keyed = stage(
        docs.select(
            (F.struct("*") if carried is None else F.struct("doc_id", *carried)).alias("row"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(mark(0), F.lit(buckets)).alias("bucket"),
            mark(1).alias("one"),
            mark(2).alias("two"),
            mark(3).alias("three"),
        )
    )
    matrix = communication_matrix(keyed.groupBy("bucket").agg(F.count("*").alias("n")), shards, seed)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("one", "row.doc_id", "text_crc32", "size"))
    dealt = (
        keyed.withColumn("rank", rank)
        .join(matrix, "bucket")
        .withColumn("shard", F.size(F.filter("until", lambda u: u < F.col("rank"))))
        .withColumn("place", F.pmod(F.xxhash64("two", "shard"), F.lit(-(-buckets // shards))))
        .drop("bucket", "one", "two", "until", "rank")
    )
    dealt = stage(dealt)
    parts = dealt.groupBy("shard", "place").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("shard", "place", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("shard", "place").orderBy("three", "row.doc_id", "text_crc32", "size"))
    return (
        dealt.withColumn("inner", inner)
        .join(parts, ["shard", "place"])
        .select(
            "row",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("before") + F.col("inner") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
