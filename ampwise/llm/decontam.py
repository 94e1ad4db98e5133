"""Benchmark decontamination by windows of words.

Windows of ten words of the benchmark make a table with their items. Document positions whose first words are hashed
like those of some window are candidates; their windows are compared as text, so every hit is verified. Only DataFrame
functions run on the documents, in one pass: words, candidates and hits of a document stay in its row until the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
LEAD = 3  # words of the hash that finds candidates
BROADCAST_WINDOWS = 100_000
CANDIDATES = "array<struct<at:int,n:int,gram:string>>"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased; null: none."""
    ascii_only = lambda w: F.length(w) == F.octet_length(w)
    lowered = F.transform(
        F.split(F.coalesce(text, F.lit("")), BREAKS),
        lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)),
    )
    return F.filter(lowered, lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where lambda bodies mention it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, n, lead, items): every window of the items, its words, the hash of its first words, and its items.

    An item of fewer words is one window; an item without words, or a null, has none. Null item ids count as ``''``.
    """
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    grams = words.where(F.size("words") > 0).select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1)),
                lambda at: F.slice("words", at, window),
            )
        ).alias("own"),
    )
    gram = F.array_join("own", " ")
    lead = F.coalesce(*(F.when(F.size("own") >= k, _lead(F.col("own"), F.lit(0), k)) for k in range(LEAD, 0, -1)))
    return (
        grams.select("item", gram.alias("gram"), F.size("own").alias("n"), lead.alias("lead"))
        .groupBy("gram", "n", "lead")
        .agg(F.collect_set("item").alias("items"))
    )


def _lead(words: Column, at: Column, n: int) -> Column:
    """Hash of ``n`` words from the 0-based position ``at`` on."""
    return F.xxhash64(*(F.get(words, at + k) for k in range(n)))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, spans, items) per document, repeated rows as often as they come.

    ``spans`` are the hit runs (first word, words), ``items`` the sorted ids of the items with a window in the text. A
    null or empty text has no words and no hits. ``text_key`` hashes the text, so that rows with null or repeated ids
    can be told apart. Only doc_id and text are read; an empty table gives no rows, an empty benchmark no hits.

    Up to ``BROADCAST_WINDOWS`` windows are held as a hash set by every task; beyond that each position is joined.
    """
    windows = benchmark_windows(benchmark, window)
    known = windows.select("n", "lead").distinct().limit(BROADCAST_WINDOWS + 1).collect()
    small = len(known) <= BROADCAST_WINDOWS
    sizes = sorted({r["n"] for r in known}) if small else list(range(1, window + 1))

    def of_size(words: Column, n: int) -> Column:
        leads = [r["lead"] for r in known if r["n"] == n]
        places = F.sequence(F.lit(0), F.size(words) - n)
        if small:
            places = F.filter(places, lambda at: _lead(words, at, min(n, LEAD)).isin(leads))
        gram = lambda at: F.array_join(F.slice(words, at + 1, n), " ")
        grams = F.transform(places, lambda at: F.named_struct(F.lit("at"), at, F.lit("n"), F.lit(n), F.lit("gram"), gram(at)))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast(CANDIDATES))

    def candidates(words: Column) -> Column:
        return F.concat(F.array().cast(CANDIDATES), *(of_size(words, n) for n in sizes))

    def examined(words: Column) -> Column:
        marker = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("gram"))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.concat(F.array(marker), candidates(words)).alias("found"))

    rows = docs.select(
        F.col("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
        _bound(words_of(F.col("text")), examined).alias("seen"),
    ).select("doc_id", "text_key", F.col("seen.n_words").alias("n_words"), F.explode("seen.found").alias("c"))
    rows = rows.select("doc_id", "text_key", "n_words", "c.at", "c.n", "c.gram")
    table = windows.select(F.col("gram").alias("known"), "items")
    hits = rows.join(F.broadcast(table) if small else table, F.col("gram") == F.col("known"), "left")
    hits = hits.where(F.col("known").isNotNull() | (F.col("at") < 0))
    found = hits.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(F.when(F.col("at") < 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", (F.col("at") + F.col("n")).alias("after"))))).alias("spans"),
        F.collect_set("items").alias("items"),
    )
    merged = F.aggregate("spans", F.array().cast("array<struct<at:int,after:int>>"), _merge)
    spans = F.transform(merged, lambda s: F.named_struct(F.lit("first"), s["at"], F.lit("n"), s["after"] - s["at"]))
    return (
        found.select(
            "doc_id",
            "text_key",
            "n_words",
            spans.alias("spans"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        )
        .drop("copy")
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["n"]))
    )


def _merge(runs: Column, span: Column) -> Column:
    """Add a span to sorted disjoint runs; touching runs become one."""
    last = F.try_element_at(runs, F.lit(-1))
    joins = F.coalesce(last["after"] >= span["at"], F.lit(False))
    longer = F.named_struct(F.lit("at"), last["at"], F.lit("after"), F.greatest(last["after"], span["after"]))
    return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(span)))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a benchmark window in their text."""
    found = scan(docs, benchmark, window).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("found_key"))
    return docs.join(found, same, "left_anti")
