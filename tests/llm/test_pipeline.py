"""The pipeline's stages against plain versions, and the registered queries on the given tables."""

import zlib
from collections import Counter

import brute_llm as brute
import compare
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from ampwise.llm import quality
from ampwise.llm.catalog import CHECKS, QUERIES
from ampwise.session import stage


def test_stages(spark, small_folder):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_folder}/benchmark.parquet").collect()]
    columns, sizes = docs.columns, {}
    for name, apply in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        source = {r.doc_id: r.source for r in docs.collect()}
        verdicts = {r.doc_id: r.kept for r in quality.judge(docs).collect()} if name == "quality_rules" else {}
        docs = stage(apply(spark, docs, small_folder))
        after = [r.doc_id for r in docs.collect()]
        sizes[name] = len(after)
        if name == "quality_rules":
            assert sorted(after) == sorted(d for d, kept in verdicts.items() if kept)
            assert not any(brute.counts(before[d])[5] for d in after)
        if name == "near_duplicates":
            assert sorted(after) == sorted(d for d, _, c in brute.components(before.items(), 5) if d == c)
        if name == "decontamination":
            found = brute.contamination(before.values(), bench)
            assert sorted(after) == sorted(d for d, w in zip(before, found) if not w[1])
        if name == "mixture":
            assert all(r.text == before[r.doc_id] for r in docs.collect()) and max(Counter(after).values()) <= 3
            words = {d: len(brute.SPACED.findall(t or "")) for d, t in before.items()}
            held, taken = Counter(), Counter()
            for d, n in words.items():
                held[source[d]] += n
            for d in after:
                taken[source[d]] += words[d]
            wanted = brute.targets(held)
            assert all(abs(taken[x] - wanted[x]) <= max(n for d, n in words.items() if source[d] == x) / 2 + 1 for x in held)
        if name == "shards":
            placed = docs.select("doc_id", "shard_size", "shard_text_crc32", "shard_law", "shard", "slot").collect()
            assert Counter(r.doc_id for r in placed) == drawn
            for r in placed:
                raw = (before[r.doc_id] or "").encode()
                assert (r.shard_size, r.shard_text_crc32, r.shard_law) == (len(raw) + 1, zlib.crc32(raw), "rows")
            assert sorted((r.shard, r.slot) for r in placed) == [(k, i) for k in range(8) for i in range(sum(r.shard == k for r in placed))]
        drawn = Counter(after)
        if name != "shards":
            assert docs.columns == columns
    assert sizes["shards"] == sizes["mixture"] > 0
    shards = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(shards) - min(shards) <= 1


def test_registered():
    names = set(entry_module.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, small_folder, name):
    assert compare.difference(QUERIES[name](spark, small_folder), compare.connect(small_folder), CHECKS[name]) is None
