"""Merkle manifest, phrase fingerprints and whitening against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampwise.llm import merkle, phrases, whitening

CLASH = ", tree string, n string, index string, run string, payload string, place string, ahead string, x string, key string"
DOCS = "doc_id long, text string, source string, lang string, n_chars long" + CLASH


def table(spark, rows, parts=4):
    clash = ("y",) * CLASH.count(" string")
    return spark.createDataFrame([(*row, *clash) for row in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "É", "ß", "日本", "x", "repeat repeat"]
    out = [(k, " ".join(r.choices(words, k=r.randint(0, 60))), f"s{k % 3}", "en", 7) for k in range(90)]
    out += [(100 + k, "short " * k, None, "de", None) for k in range(9)]
    out += [(200, None, "s", None, None), (201, "", "s", None, 0), (202, "ABC", "s", "", 3), (203, "abc", "s", "é", 3)]
    out += [(204, "a" * 30_000, "s", "en", 1), (205, "ab" * 20_000, "s", "en", 1), (89, out[3][1], "s0", "en", 7)]
    return out + [out[5], out[5], (None, "no id", "s", "en", 5), (None, "No id", "s", "en", 5)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, source, lang, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Levels from the leaves to the one node at the top."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 8])) for k in range(0, len(last), 8)])
    return levels


def plain_path(levels, place):
    out = []
    for level in levels[:-1]:
        first = place - place % 8
        run = level[first : first + 8]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= 8
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, plain_leaf(*row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for k, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = plain_path(trees[g], k) + plain_path(top, at)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = plain_leaf(row[0], lowered(row[1]), *row[2:]) if hit else leaf
            for left, right in path:
                node = sha(left + node + right)
            root = top[-1][0]
            out.append((row[0], leaf, trees[g][-1][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def tampered():
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {"text": F.when(hit, F.translate("text", upper, lower)).otherwise(F.col("text"))}


def as_bag(rows):
    return Counter(tuple(r) for r in rows)


def test_merkle_proofs(spark, rows):
    found = merkle.verify(table(spark, rows), tampered()).collect()
    assert as_bag(found) == as_bag(plain_manifest(rows))
    assert {r.verified for r in found} == {True, False}


def test_merkle_many_layers(spark):
    """More rows than a run of runs needs two layers; one row, and one row a group."""
    for rows in (
        [(k, f"T{k}", "s", "en", 1) for k in range(4300)],
        [(1, "One", "s", "en", 1)],
        [(k, "t", "s", f"g{k:03}", 1) for k in range(70)],
    ):
        assert as_bag(merkle.verify(table(spark, rows), tampered()).collect()) == as_bag(plain_manifest(rows))
    assert merkle.verify(table(spark, []), tampered()).count() == 0


def test_merkle_log_is_in_order_of_completion(spark):
    rows = [(k, "t", "s", "en" if k < 1500 else "de", 1) for k in range(1600)]
    log = merkle.build(table(spark, rows)).log().collect()
    for lang in ("en", "de"):
        leaves = [plain_leaf(*row) for row in sorted(rows) if row[3] == lang]
        levels, want = plain_tree(leaves), []
        for i in range(len(leaves)):
            for level in range(len(levels)):
                if level and (i + 1) % 8**level and i + 1 < len(leaves):
                    break
                want.append((level, i // 8**level, levels[level][i // 8**level]))
        own = sorted((r.position, r.level, r.place, r.digest) for r in log if r.tree == f"={lang}")
        assert [x[0] for x in own] == list(range(len(want))) and [x[1:] for x in own] == want


def test_merkle_row_order_does_not_matter(spark, rows):
    roots = {merkle.build(table(spark, r, n)).root().first()["root"] for r, n in ((rows, 1), (rows[::-1], 7))}
    assert len(roots) == 1


def plain_phrases(text):
    seen, held = set(), ""
    for letter in text:
        held += letter
        if held not in seen:
            seen.add(held)
            held = ""
    return seen


def test_phrases_are_those_of_the_plain_parse():
    r = random.Random(4)
    texts = ["", "a", "aaaaaaaaaa", "ab" * 999, "日本" * 50] + ["".join(r.choices("abc é", k=r.randint(1, 900))) for _ in range(60)]
    for text in texts:
        found, ends = phrases.parse(text)
        assert len(found) == len(set(found)) and set(found) == plain_phrases(text)
        assert "".join(found) == text[: ends[-1] if ends else 0]
        for other in texts[::9]:
            kept = len(text) - len(text) // 3
            want = text[:kept] + other[: len(text) // 3]
            edited, print_ = phrases.Parsed(text).edited(other)
            assert edited == want and print_ == phrases.Parsed(want).print


def test_sketches_tell_the_share_of_common_phrases():
    r = np.random.default_rng(6)
    for size, common in ((3, 2), (40, 10), (500, 400), (20_000, 5_000)):
        gaps = []
        for _ in range(40):
            both, left, right = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (common, size - common, size - common))
            prints = [phrases.printed(phrases.sketch(np.concatenate([both, x]))) for x in (left, right)]
            gaps.append(phrases.likeness(*prints) - common / (2 * size - common))
        assert abs(np.mean(gaps)) < 0.03 and np.abs(gaps).max() < 0.2
    assert phrases.likeness("", "") == 1.0 and phrases.likeness("", phrases.Parsed("a").print) == 0.0


@pytest.mark.parametrize("runs", [1, 3, 16])
def test_fingerprints(spark, rows, runs):
    found = phrases.fingerprints(table(spark, rows), runs).collect()
    # Rows of equal id stand by a hash that Spark computes.
    ties = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t, *_ in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda row: (row[0] is None, -(row[0] or 0), ties[row[1] or ""]))
    want = []
    for k, row in enumerate(order):
        text, following = row[1] or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        prints = [phrases.Parsed(t).print for t in (text, edited, following)]
        near = [phrases.likeness(prints[0], p) for p in prints[1:]]
        want.append((row[0], len(text), sha(edited), prints[0], prints[1], *near))
    assert as_bag(found) == as_bag(want)
    by_text = {}
    for row in found:
        by_text.setdefault((row.doc_id, row.n_chars), set()).add(row.fingerprint)
    assert phrases.fingerprints(table(spark, []), runs).count() == 0
    only = phrases.fingerprints(table(spark, rows[:1]), runs).collect()
    assert len(only) == 1 and only[0].near_next == 1.0


VECTORS = "vec_id long, embedding array<float>, label int, index string, x string, key string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, "a", "b", "c", "d") for k, v in rows], VECTORS).repartition(5)


def plain_whitening(rows, kept=16):
    held = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in held])
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = fitted - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(values)[::-1][:kept] if values[k] > 1e-12 * values.sum()]
    projected = (x - sums / n) @ axes[:, order] / np.sqrt(values[order])
    gaps = [int(((n * v - sums).astype(object) ** 2).sum()) for v in x]
    return [k for k, _ in held], n, gaps, projected, values[order] / values.sum()


@pytest.mark.parametrize("width", [2, 5, 20])
def test_whitening(spark, width):
    r = np.random.default_rng(width)
    mixed = r.normal(size=(width, width))
    rows = [(k, [float(c) for c in r.normal(size=width) @ mixed]) for k in range(700)]
    rows += [(1000 + k, rows[7][1]) for k in range(400)]  # copies don't weigh
    rows += [(2000, None), (2001, []), (2002, [1.0] * (width - 1) + [None]), (2003, [float("nan")] * width)]
    rows += [(2004, [float("inf")] * width), (7, rows[7][1]), (None, rows[8][1])]
    rows += [(2005, [1.0] * (width + 1)), (2006, [1e30] * width)]  # of another width, beyond the whole numbers
    found = whitening.whiten(vectors(spark, rows)).collect()
    keys, n, gaps, projected, explained = plain_whitening(rows[:-2])
    assert len(found) == len(keys) * min(width, 16)
    by_key = {}
    for row in found:
        assert row.n == n and row.identity_error < 1e-9
        assert row.explained == pytest.approx(explained[row.component - 1], rel=1e-9)
        by_key.setdefault(row.vec_id, []).append(row)
    signs = None
    for key, gap, line in zip(keys, gaps, projected):
        own = [row for row in by_key[key] if row.deviation == gap]
        got = np.array([row.whitened for row in sorted(own, key=lambda row: row.component)[:: len(own) // len(line)]])
        signs = np.sign(got * line) if signs is None else signs
        assert np.allclose(got * signs, line, atol=1e-6)


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 2.0, 2.0 * k]) for k in range(50)])).collect()
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1.0) for r in flat)
