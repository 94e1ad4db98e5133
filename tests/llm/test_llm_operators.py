"""The operators against plain versions: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pydoc_data.topics import topics

import brute_llm as brute
import numpy as np
import pytest

from ampwise.llm import decontam, draws, licenses, minhash, mixing, quality, sharding, suffix_dedup, url_rules, warc, wrappers

CLASH = ", bands string, node string, anchor string, size string, words string, row string, spans string, host string"
DOCS = "doc_id long, text string, source string, n_chars long" + CLASH
WORDS = [f"w{k}x" for k in range(90)] + ["É", "ß9", "Über", "the", "THE"]


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): near and exact copies, repeated lines, nulls, empties, repeated rows, a long text."""
    r = random.Random(3)
    out = [(k, prose(r, r.randint(1, 400)), f"s{k % 4}") for k in range(40)]
    for k in range(40, 60):
        words = out[k - 40][1].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "changed"
        out.append((k, " ".join(words), "s1"))
    shared = prose(r, 120)
    out += [(60 + k, prose(r, 30) + " " + shared + "\n" + prose(r, 20), "s0") for k in range(3)]
    out += [(63, out[5][1], "s2"), (64, None, None), (65, "", "s0"), (66, " \n\t ", None), (67, "one two", "s3"), (68, "One  two", "s3")]
    out += [(69, "a" * 1500, "s0"), (70, "ab " * 700, "s0"), (71, "line one here\n" * 40, "s1"), (72, prose(r, 9000), "s2")]
    out += [(72, out[-1][1], "s2"), (None, out[6][1], "s9"), (None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ("x",) * CLASH.count(" string")
    return spark.createDataFrame([(d, t, s, len(t or ""), *clash) for d, t, s in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def as_bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("group_rows", [0, 2, 128])
def test_suffix_dedup(docs, rows, none, group_rows):
    for width in (60, 400):
        want = brute.repeats([t for _, t, _ in rows], width)
        found = suffix_dedup.remove_repeats(docs, width, group_rows=group_rows).collect()
        assert as_bag(found) == as_bag((d, *w) for (d, _, _), w in zip(rows, want))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_shared_passages_go_from_400_bytes_on(spark):
    """Passages of over 50 words in two documents: 399 bytes stay, 400 go; ``n_bytes`` is the text's length either way."""
    r = random.Random(3)
    sizes, texts = (330, 399, 400, 450), []
    for size in sizes:
        passage = " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(80))[:size]
        assert len(passage.split()) > 50
        for left, right in ("KL", "MN"):
            before, after = ("".join(r.choices("klmnopqrst ", k=300)) for _ in range(2))
            texts.append((before + left, passage, right + after))
    table = spark.createDataFrame(
        [(k, "".join(t), "s", 1, *("x",) * CLASH.count(" string")) for k, t in enumerate(texts)], DOCS
    )
    want = []
    for k, (before, passage, after) in enumerate(texts):
        gone = len(passage) if len(passage) >= 400 else 0
        kept = before + after if gone else before + passage + after
        digest = hashlib.sha256(kept.encode()).hexdigest()
        want.append((k, len(before + passage + after), gone, int(gone > 0), digest))
    assert as_bag(suffix_dedup.remove_repeats(table).collect()) == as_bag(want)


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_structured_words_do_not_collide(spark):
    """Words of 1024 and 2048 letters that agree under any polynomial over 2^64; a very long word; odd bytes."""
    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    long = "x" * 70_000
    texts = [one, two, thue_morse(2048, "ab"), thue_morse(2048, "ba"), long, long + "y", long]
    table = spark.createDataFrame([(k, t, "s", 1, *("x",) * CLASH.count(" string")) for k, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 4}
    line = " ".join([one, "p", "q", two, "p", "q"])
    counted = quality.judge(spark.createDataFrame([(1, line, "s", 1, *("x",) * CLASH.count(" string"))], DOCS)).first()
    assert counted.n_words == 6 and counted.n_repeat_words == 0


def test_suffix_arrays_and_fragments():
    r = random.Random(8)
    for trial in range(20):
        vocabulary = [bytes(r.choices(b"abcde ", k=r.randint(1, 9))) for _ in range(25)]
        base = b" ".join(r.choices(vocabulary, k=300))
        parts = []
        for _ in range(r.randint(1, 6)):
            a = r.randrange(len(base))
            parts.append(b" ".join(r.choices(vocabulary, k=20)) + base[a : r.randrange(a, len(base) + 1)])
        parts += [b"a" * 700, b"ab" * 400] * (trial % 2)
        seen = Counter(p[i : i + 100] for p in parts for i in range(len(p) - 99))
        want = [[i for i in range(len(p) - 99) if seen[p[i : i + 100]] > 1] for p in parts]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(parts, 100)] == want
        data, starts = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        _, _, first, last, _, offsets, places = suffix_dedup.fragments(data, starts, 100)
        held = []
        for a, b, low, high in zip(first, last, offsets, offsets[1:]):
            held += list(range(a, b + 1)) if low == high else (a + places[low:high]).tolist()
        assert sorted(held) == [s + i for p, s in zip(parts, starts) for i in range(len(p) - 99)]


def test_source_targets_and_mix(docs, rows, none):
    def run(seed):
        drawn = mixing.draw_mix(docs, mixing.word_count(docs["text"]), shards=4, seed=seed, block_words=50, bucket_rows=4)
        return drawn.select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "copies").collect()

    found = run(7)
    assert as_bag((r.doc_id, r.size) for r in found) == as_bag((d, len(brute.SPACED.findall(t or ""))) for d, t, _ in rows)
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.taken == sum(c.words for c in r.copies)
    want = brute.targets(sizes)
    for r in found:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    assert as_bag((r.doc_id, r["size"], r.taken) for r in run(7)) == as_bag((r.doc_id, r["size"], r.taken) for r in found)
    mixed = mixing.mix(docs, shards=4).select("row.doc_id", "row.source", "row.text", "shard").collect()
    drawn = mixing.draw_mix(docs, mixing.word_count(docs["text"]), shards=4)
    copies = drawn.select("row.doc_id", "row.text", "size", "copies").collect()
    assert as_bag((r.doc_id, r.text, r.shard) for r in mixed) == as_bag(
        (r.doc_id, r.text, c.shard) for r in copies for c in r.copies if 2 * c.words >= r["size"]
    )
    words = Counter()
    for row in mixed:
        words[row.source] += len(brute.SPACED.findall(row.text))
    longest = max(len(brute.SPACED.findall(t or "")) for _, t, _ in rows)
    assert all(abs(words[s] - taken[s]) <= longest / 2 for s in sizes)
    assert mixing.draw_mix(none, mixing.word_count(none["text"])).count() == 0


def test_every_shard_gets_its_part_of_every_source(spark):
    """Sources of very different sizes, documents of about ten words: each shard's words of a source stay near an eighth."""
    r = random.Random(7)
    data = [(k, prose(r, r.randint(5, 15)), "big" if k % 10 else "small") for k in range(20_000)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    drawn = mixing.draw_mix(frame, mixing.word_count(frame["text"]))
    words = defaultdict(Counter)
    for row in drawn.select("row.source", "copies").collect():
        for c in row.copies:
            words[row.source][c.shard] += c.words
    for source, shards in words.items():
        assert len(shards) == mixing.SHARDS
        assert all(0.6 < 8 * n / sum(shards.values()) < 1.4 for n in shards.values())


def test_draws_beyond_numpys_limit_follow_the_law():
    rng = np.random.default_rng(3)
    got = np.array([draws.hypergeometric(rng, 2 * 10**9, 10**9, 3 * 10**6) for _ in range(200)])
    spread = (3 * 10**6 * 2 / 9) ** 0.5
    assert abs(got.mean() - 2 * 10**6) < 5 * spread / 200**0.5 and 0.8 < got.std() / spread < 1.2
    assert draws.hypergeometric(rng, 10**9, 5, 10**9 + 5 - 2) >= 10**9 - 2


def test_draws_are_exact():
    for seed in range(30):
        r = random.Random(seed)
        colours, parts = [r.randint(0, 50) for _ in range(5)], r.randint(1, 9)
        matrix = draws.split_tree(colours, draws.even(sum(colours), parts), seed)
        assert [sum(c) for c in zip(*matrix)] == colours and [sum(m) for m in matrix] == draws.even(sum(colours), parts)
    rng = np.random.default_rng(1)
    assert 0 <= draws.hypergeometric(rng, 3 * 10**9, 10**9, 10**9) <= 10**9
    assert sum(draws.draw(rng, [10**9, 10**10, 5], 10**9)) == 10**9


def test_license_table_is_reachable(spark):
    frame = spark.createDataFrame([(s,) for s in licenses.SENTENCES], "s string")
    changed = frame.select("s", licenses.normalised(frame["s"]).alias("n"), frame["s"].rlike(licenses.CUE).alias("cue"))
    assert changed.where("s != n or not cue").count() == 0
    known = set(licenses.SENTENCES.values())
    assert all(i in known for _, sequence in licenses.RULES for i in sequence)


def test_license_scan(spark, docs, rows, none):
    mit = (
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and\n"
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without\n"
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the\n"
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    )
    texts = [
        ("Some prose.\nReleased under the MIT License.\nMore prose.", ["MIT"]),
        ("no full stop here\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.", ["GPL-3.0-only", "CC-BY-NC-4.0"]),
        (mit, ["MIT"]),
        ("The word license alone. Permission is needed.", []),
    ]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(frame).collect()} == {k: w for k, (_, w) in enumerate(texts)}
    assert as_bag((r.doc_id,) for r in licenses.scan(docs).collect()) == as_bag((d,) for d, _, _ in rows)
    assert licenses.scan(none).count() == 0


GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %s of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL_IDS = ["GPL-%s+-free", "GPL-hope", "GPL-see", "GPL-received"]
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
BSD = """Copyright (c) 2020, A. Nobody
All rights
reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_verbatim_notices(spark):
    """Notices as their authors give them, plain and as comments, with code before and after."""
    apache = ["Apache-2-ref", "Apache-comply", "Apache-copy", "Apache-asis", "Apache-see"]
    wanted = [
        (GPL % (":", ",", 3), [i.replace("%s", "3") for i in GPL_IDS], ["GPL-3.0-or-later"]),
        (GPL % (";", ";", 2), [i.replace("%s", "2") for i in GPL_IDS], ["GPL-2.0-or-later"]),
        (APACHE, apache, ["Apache-2.0"]),
        (MPL, ["MPL-2-subject"], ["MPL-2.0"]),
        (BSD, ["Reserved", "BSD-permit", "BSD-source", "BSD-binary", "BSD-endorse"], ["BSD-3-Clause", "Proprietary"]),
    ]
    for key, found in licenses.SENTENCES.items():
        if key.startswith("spdx license identifier "):
            tag = "SPDX-License-Identifier: " + key[24:].replace(" ", "-")
            wanted.append((tag, [found], None))
    texts = []
    for text, ids, names in wanted:
        for form in ("%s", "/*\n%s */\nint main() { return 0; }\n", "A title\n\n%s\n\nMore prose. And more."):
            texts.append((form % text, ids, names))
        texts.append(("#!/bin/sh\n#\n" + "".join(f"# {line}\n" for line in text.splitlines()) + "#\nexit 0\n", ids, names))
    frame = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(frame).collect():
        text, ids, names = texts[r.doc_id]
        assert r.sentences == ids and r.licenses, text
        assert names is None or r.licenses == names, text


@pytest.mark.parametrize("limit", [0, 100_000])
def test_decontamination(spark, docs, rows, none, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    items = [("a", rows[60][1][150:500]), ("b", "one two"), ("c", rows[60][1][150:500]), ("d", None), ("e", "... !"), (None, "ß9")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.contamination([t for _, t, _ in rows], [("" if i is None else i, t) for i, t in items])
    found = decontam.scan(docs, bench)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), sum(s.n for s in r.spans)) for r in found.collect()]
    assert as_bag(got) == as_bag((d, n, hit, k, hit) for (d, _, _), (n, hit, k, _) in zip(rows, want))
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert as_bag((r.doc_id,) for r in kept.collect()) == as_bag((d,) for (d, _, _), w in zip(rows, want) if not w[1])
    assert decontam.scan(none, bench).count() == 0
    assert decontam.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_license_scan_equals_a_plain_walk(spark, small_folder):
    """Known sentences in random company, wrapped, run together and cut, and the texts of the given table."""
    r = random.Random(12)
    known, texts = list(licenses.SENTENCES), []
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 6)):
            words = r.choice(known).split(" ") if r.random() < 0.7 else r.choices(["the", "licence", "copyright", "2.0", "free"], k=r.randint(1, 5))
            words = words[: r.randint(1, len(words))] if r.random() < 0.1 else words
            parts.append("".join(w + r.choice([" ", " ", " ", "\n", ", ", " - "]) for w in words[:-1]) + words[-1])
        text = "".join(p + r.choice([". ", "\n", ".\n", "; ", ": ", " ", "\n\n"]) for p in parts)
        texts.append(text if r.random() < 0.5 else text.title())
    rows = list(enumerate([*texts, None, ""]))
    rows += [(x.doc_id + 10_000, x.text) for x in spark.read.parquet(f"{small_folder}/documents.parquet").collect()]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    plain = {d: brute.licence_ids(t, licenses.SENTENCES, licenses.SENTENCE_END, licenses.CUE) for d, t in rows}
    assert sum(map(bool, plain.values())) > 200
    for row in found:
        assert row.sentences == plain[row.doc_id], rows[row.doc_id]
        assert row.licenses == brute.licence_rules(row.sentences, licenses.RULES)


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "<p>two</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "<p>one</p>", "", None, "<p>é</p>", "<p>one</p>"]
    pages = [(k, f"http://h{k % 2}.org/a?b=1#c", h) for k, h in enumerate(html)]
    pages += [(2, None, "<p>one</p>"), (None, "http://x\r\ny/", "<p>one</p>"), (None, None, None)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    for least in (0, 5, 100):
        found = [r.asDict(True) for r in warc.round_trip(frame, least).collect()]
        want, groups = [], defaultdict(list)
        for page, _, text in pages:
            groups[text or ""].append(-1 if page is None else page)
        got = Counter()
        for r in found:
            c = r["capture"]
            assert c["digest_ok"] is (True if c["record_type"] == "response" else None)
            assert r["request"]["concurrent_to"] == c["record_id"] == r["metadata"]["concurrent_to"]
            got[r["metadata"]["page_id"], c["payload_bytes"], c["payload_digest"], c["record_type"], (r["original"] or {}).get("page_id")] += 1
        for text, ids in groups.items():
            size, most = len(text.encode()), max(ids)
            ids = sorted(ids)
            for k, page in enumerate(ids):
                first = size < least or k == len(ids) - 1
                name = None if page < 0 else page
                kind = ("response", None) if first else ("revisit", None if most < 0 else most)
                want.append((name, size, brute.payload_digest(text), *kind))
        assert got == Counter(want)
    assert warc.round_trip(frame.where("false")).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    frame = spark.createDataFrame([(1, "http://a/", "x\r\n\r\ny"), (2, "http://b/", "é" * 5000)], "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert {bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()} == {"x\r\n\r\ny", "é" * 5000}


def test_warc_foreign_archives(spark, tmp_path):
    """One member per record, two versions, headers without a blank, folded headers, other records, zeros at the end."""
    end = b"\r\n\r\n"
    payload = "é" * 200_000
    sha = base64.b32encode(hashlib.sha1(payload.encode()).digest())

    def record(version, headers, block):
        lines = [version, *headers, b"content-length:%d" % len(block)]
        return b"\r\n".join(lines) + end + block + end

    records = [
        record(b"WARC/1.0", [b"WARC-Type: warcinfo", b"WARC-Record-ID:<urn:0>", b"Content-Type: application/warc-fields"], b"software: x\r\n"),
        record(
            b"WARC/1.0",
            [b"warc-type:response", b"WARC-Record-ID: <urn:1>", b"WARC-Target-URI: <http://a/>", b"WARC-Payload-Digest:", b" sha1:" + sha],
            b"HTTP/1.1 200 OK\r\nX: y" + end + payload.encode(),
        ),
        record(b"WARC/1.1", [b"WARC-Type: request", b"WARC-Record-ID: <urn:2>", b"WARC-Concurrent-To: <urn:1>"], b"GET / HTTP/1.1" + end),
        record(b"WARC/1.1", [b"WARC-Type: response", b"WARC-Record-ID: <urn:3>", b"WARC-Payload-Digest: md5:00"], b"HTTP/1.1 200" + end + b"x"),
        record(b"WARC/1.0", [b"WARC-Type: response", b"WARC-Record-ID: <urn:4>", b"Content-Type: text/dns"], b"a. 1 IN A 1.2.3.4"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records) + b"\0" * 600)
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "w" / "c.warc").write_bytes(b"".join(records))
    found = warc.read_records(spark, str(tmp_path / "w"))
    rows = Counter((r.record_type, r.record_id, r.target_uri, r.payload_bytes, r.digest_ok) for r in found.collect())
    assert rows == {
        ("warcinfo", "<urn:0>", None, None, None): 3,
        ("response", "<urn:1>", "http://a/", 400_000, True): 3,
        ("request", "<urn:2>", None, None, None): 3,
        ("response", "<urn:3>", None, 1, None): 3,
        ("response", "<urn:4>", None, 17, None): 3,
    }
    held = warc.captures(found.where("record_type in ('response', 'request')").distinct()).collect()
    assert {r.capture.record_id: r.request and r.request.record_id for r in held} == {"<urn:1>": "<urn:2>", "<urn:3>": None, "<urn:4>": None}
    for broken in (gzip.compress(records[1])[:-30], records[1][:90], b"hello" + end):
        with pytest.raises(ValueError):
            list(warc.parse_records(warc.unpacked(broken)))


def test_quality(docs, rows, none):
    found = quality.judge(docs).collect()
    got = as_bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == as_bag((d, *brute.counts(t)) for d, t, _ in rows)
    assert all(not (r.kept and r.base_failed) for r in found)
    verdicts = Counter()
    for d, t, _ in rows:
        ratio, fits = brute.in_bands(t, quality.BANDS, quality.LADEN, quality.CHUNK_BYTES, quality.BAD_SHARE, quality.LEVEL)
        verdicts[d, fits, round(ratio, 9)] += 1
    judged = Counter((r.doc_id, r.kept, r.base_failed, round(r.ratio, 9)) for r in found)
    for (d, kept, failed, ratio), n in judged.items():
        assert verdicts[d, True, ratio] >= n if kept else failed or verdicts[d, False, ratio] >= n
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert as_bag((r.doc_id,) for r in kept.collect()) == as_bag((r.doc_id,) for r in found if r.kept)
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0


def test_compression_bands_on_labelled_text(spark, small_folder):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    good = spark.read.parquet(f"{small_folder}/labels.parquet").where("quality = 1")
    judged = quality.judge(docs).join(good, "doc_id").where("not base_failed")
    assert judged.where("not kept").count() == 0 and judged.count() > 30


def test_compression_bands_on_real_and_long_prose(spark):
    """Python's own manual and clean texts of several MB pass; noise, text laden with symbols and spoilt text do not."""
    r = random.Random(4)
    manual = [t for t in topics.values() if len(t) > 600 and 10 * sum(map(t.count, "#*$%&|<>")) < len(t.split())]  # without tables
    manual += ["\n".join(manual[k::3]) for k in range(3)]
    syllables = "an be con der en fi gra ho in jo ka lu mi no or pa qui re sto tu un ver wi xe yo za".split()
    vocabulary = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(2500)]
    weights = [1 / (k + 3) for k in range(2500)]
    long = [" ".join(r.choices(vocabulary, weights, k=n)) for n in (20_000, 100_000, 600_000)]
    noise = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n)) for n in (4000, 60_000)]
    noise = [" ".join(t[k : k + 60] for k in range(0, len(t), 60)) for t in noise]
    laden = [" ".join(w + r.choice(["***", "$$$", "%%%", "&&&", "###"]) for w in t.split()) for t in (prose(r, 2000), long[0])]
    spoilt = [long[0][:30_000] + " ".join(f"{k} to be had here now" for k in range(1200))]
    texts = [(t, True) for t in manual + long] + [(t, False) for t in noise + laden + spoilt]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(8)
    judged = [j for j in quality.judge(frame).collect() if not j.base_failed]
    good = [j for j in judged if texts[j.doc_id][1]]
    assert len(good) > 25 and max(len(texts[j.doc_id][0]) for j in good) > 3_000_000
    assert all(j.kept for j in good)
    assert not any(j.kept for j in judged if not texts[j.doc_id][1])


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">Accept &amp; go</div><article><h1>Title {k}</h1><p>First <b>bold</b>{k} &lt;x&gt;<br>next<p>Second {k}
<div class="ad">Buy</div><p>Share this story</p><section class="comments"><p>me too</p></section></article><aside>More</aside>
<form><input>Go</form><script>var t="</p>";</script><!-- <p>no</p> --><footer>&copy; Site</footer></body></html>"""


def test_wrapper_induction(spark):
    pages = [(k, f"http://one.org/{k}", PAGE.format(k=k)) for k in range(12)]
    pages += [(20, "http://two.org/", "<div><div class=menu>x</div><p>Only  text\n here</p></div>"), (21, "http://two.org/", None)]
    pages += [(22, None, ""), (23, "nonsense", "plain &amp; simple <"), (24, "http://two.org/", "<p>a<b>b</b></p><p>" + "long " * 9000)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in wrappers.extract(frame).collect()}
    assert got[3].text == "Title 3 First bold3 <x> next Second 3"  # the shared line is template
    assert got[20].text == "Only text here" and got[21].text == got[22].text == "" and got[23].text == "plain & simple <"
    assert got[24].text == "ab " + ("long " * 9000).strip()
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(pages)
    assert wrappers.extract(frame.where("false")).count() == 0


def test_layouts_of_a_host_have_their_own_templates(spark):
    """Five layouts, each a fifth of the pages, two too rare for a template; notices stand in elements without a tell-tale name."""
    forms = [
        "<div class=top><p>Notice A</p></div><div class=text{k}><h1>T{k}</h1>{more}</div>",
        "<table><tr><td>Menu B</td></tr><tr><td>T{k}{more}</td></tr></table><div>End B</div>",
        "<section><div>Advert C</div></section><div class=body><h1>T{k}</h1>{more}</div><p>Bye C</p>",
        "<div class=wrap><div class=x><span>Line D</span></div><div class=y><p>T{k}</p>{more}</div></div>",
        "<dl><dt>Rules E</dt></dl><div class=e><p>T{k}</p>{more}</div>",
    ]
    pages = []
    for k in range(50):
        more = "".join(f"<p>p{k} {i}</p>" for i in range(k % 7 + 1))
        pages.append((k, f"http://many.org/{k}", f"<html><body>{forms[k % 5].format(k=k, more=more)}</body></html>"))
    pages += [(90 + k, f"http://many.org/rare{k}", f"<body><ul><li>rare {k}</li></ul></body>") for k in range(2)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    for k in range(50):
        assert got[k] == " ".join([f"T{k}", *(f"p{k} {i}" for i in range(k % 7 + 1))])
    assert got[90] == "rare 0" and got[91] == "rare 1"


def test_tree_matching():
    one = wrappers.number(wrappers.parse("<div><p>a</p><ul><li>x</li><li>y</li></ul><p>b</p></div>"))
    two = wrappers.number(wrappers.parse("<div><h2>t</h2><p>a</p><ul><li>x</li></ul><span>s</span><p>b</p></div>"))
    pairs = []
    assert wrappers.matched(one[0], two[0], pairs) == len(pairs) == 6
    assert {one[a].text for a, _ in wrappers.equal_places(one, two)} == {"a", "x", "b"}


def test_tree_matching_of_long_lists_and_deep_trees():
    """No size changes the method: constant kids of long lists are matched, and elements of any depth keep their place."""
    r = random.Random(6)
    kids = [r.choice(["<p>v%d</p>", "<p><b>v%d</b></p>", "<ul><li>v%d</li></ul>", "<p><i>v</i>%d</p>"]) for _ in range(400)]
    pages = []
    for page in range(2):
        own = [k % r.randrange(10**9) for k in kids]
        own[200] = "<div><p>always here</p></div>"
        pages.append(wrappers.number(wrappers.parse("<div>" + "<h2>new</h2><dl></dl>" * page + "".join(own[: 400 - 30 * page]) + "</div>")))
    assert "always here" in {pages[0][a].text for a, _ in wrappers.equal_places(*pages)}
    for depth in (150, 250, 5000):
        noise = "<span>" * depth + "<script>bad</script><nav>bad</nav>" + "</span>" * depth
        page = f"<article><div>one</div>{noise}<div>{'<div>' * depth}two{'</div>' * depth}</div><font>{'<font>' * depth}<div>three</div></article>out"
        trees = [wrappers.parse(page) for _ in range(2)]
        nodes = [wrappers.number(tree) for tree in trees]
        assert wrappers.main_text(trees[0], set()) == "one two three"
        assert len(wrappers.equal_places(*nodes)) == 3
    deep = wrappers.number(wrappers.parse("<div>" * 3000 + "<b></b><i></i>" + "</div>" * 3000))
    other = wrappers.number(wrappers.parse("<div>" * 3000 + "<u></u><i></i><u></u>" + "</div>" * 3000))
    assert wrappers.matched(deep[0], other[0], []) == 3002


def test_copies_of_an_article_are_no_template(spark):
    """Mirrors of one article, with other scripts, counts and links, give its whole text, beside a host with a template."""
    r = random.Random(8)
    paragraphs = [prose(r, 25) for _ in range(3)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    copies = [f"<html><script>track({k})</script><article><h1>News</h1>{body}<p>{k} readers</p></article></html>" for k in range(7)]
    alone = [f"<html><article><h1>News</h1>{body}</article></html>"]
    others = [f"<html><article><h1>T{k}</h1><p>Follow us every day</p><p>{prose(r, 30)}</p></article></html>" for k in range(6)]
    pages = [(k, "http://mirror/a", p) for k, p in enumerate(copies)] + [(20, "http://alone/a", alone[0])]
    pages += [(30 + k, "http://mixed/a", p) for k, p in enumerate(copies + others)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    whole = " ".join(["News", *paragraphs])
    assert got[20] == whole
    assert all(got[k] == f"{whole} {k} readers" and got[30 + k] == f"{whole} {k} readers" for k in range(7))
    assert all("Follow us" not in got[37 + k] and got[37 + k].startswith(f"T{k} ") for k in range(6))


def test_templates_alone_find_the_text(spark):
    """No element, role or class tells anything here: what all pages of a host say is template, what varies is content."""
    r = random.Random(9)
    want, pages = {}, []
    for host in range(3):
        menu = "".join(f"<li>{prose(r, 2)}</li>" for _ in range(5))
        foot = prose(r, 40)
        for k in range(9):
            text = [prose(r, r.randint(5, 60)) for _ in range(r.randint(1, 5))]
            page = f"<div><ul>{menu}</ul><div>{''.join(f'<p>{t}</p>' for t in text)}</div><div><p>{foot}</p></div></div>"
            pages.append((10 * host + k, f"http://h{host}.org/{k}", page))
            want[10 * host + k] = " ".join(text)
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in wrappers.extract(frame).collect()} == want
    plain = {k: wrappers.main_text(wrappers.parse(page), set()) for k, _, page in pages}
    assert all(len(plain[k]) > len(want[k]) for k in want)


def test_class_names_do_not_drop_the_main_text():
    def text(page):
        tree = wrappers.parse(page)
        wrappers.number(tree)
        return wrappers.main_text(tree, set())

    kept = ["<article class='post has-sidebar'>%s</article>", "<div id='content' class='with-sidebar'>%s</div>", "<main class='no-comments'>%s</main>"]
    kept += ["<article class='post social'>%s</article>", "<main class='comments'>%s</main>", "<div class='social'><main>%s</main></div>"]
    kept += ["<div class='widget'><article>%s</article></div>", "<div class=promo><div itemprop=articleBody>%s</div></div>"]
    kept += ["<div class='content-sidebar-wrap'>%s</div>", "<main><article class='post social'>%s</article></main>", "<div id=content class='right-sidebar'>%s</div>"]
    for form in kept:
        assert text("<body>" + form % "<p>the text</p>" + "</body>") == "the text", form
    noise = ["<div class='sidebar'>x</div>", "<div class='cookie-notice'>x</div>", "<div id='site-footer'>x</div>", "<p class='a comments'>x</p>"]
    noise += ["<section class='comments'><article class='comment'>x</article></section>", "<div class=related><article>x</article></div>"]
    for one in noise:
        assert text(f"<body><article class='social'><p>the text</p>{one}</article>{one}</body>") == "the text", one


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(docs, rows, none, words):
    distinct = {d: t for d, t, _ in rows if d is not None}
    want = {d: (n, c) for d, n, c in brute.components(distinct.items(), words)}
    found = minhash.near_duplicates(docs, words).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    nulls = {(r.component_id, r.kept) for r in found if r.doc_id is None}
    assert nulls == {(want[6][1], False), (None, True)}
    assert minhash.deduplicated(docs, words).columns == docs.columns
    assert minhash.near_duplicates(none).count() == 0


def test_graded_copies_are_linked_through_others(spark):
    """Many copies at all distances, so that buckets hold several components and no centre reaches all of them."""
    r = random.Random(5)
    base, out = prose(r, 160).split(), []
    for k in range(150):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = r.choice(["the", "new", f"u{k}"])
        out.append((k, " ".join(words)))
    rows = out + out[::3] * 2  # rows repeated in id and text count once
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 4).collect()}
    assert got == {d: c for d, _, c in brute.components(out, 4)}


def test_rare_elements(spark):
    shared = list(range(90))
    sets = [(bytes([k + 1]), shared + list(range(100 * k + 2000, 100 * k + 2010))) for k in range(10)]
    sets.append((b"z", list(range(2000, 2010))))  # shares rare elements, but is too small for a link
    frame = spark.createDataFrame(sets, "node binary, elements array<long>")
    nodes = spark.createDataFrame([(n, len(e), n) for n, e in sets], "node binary, n long, label binary")
    common, alike = minhash._rare_elements(frame, nodes, 80)
    assert as_bag(common.collect()) == as_bag([(n, 90) for n, _ in sets[:-1]] + [(b"z", 0)])
    assert alike.count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 470)]
    frame = spark.createDataFrame([(f"{a:04}".encode(), f"{b:04}".encode()) for a, b in links if a != b], "a binary, b binary")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {int(r.node): int(r.label) for r in minhash.components(frame).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_url_rules(spark):
    urls = ["http://a.b.NET/x", "https://example.net/en/1?q#f", "http://example.net/en", "ftp://x.example.com/de/a", "http://org/fr/", None, ""]
    urls += ["no scheme", "http://net", "http://net/?a", "http://xnet/", "http://..net/", "a://b://c.net/", "http://example.org#/fr/", "http://net/", "http://net/"]
    rules = [*url_rules.RULES, ("b.net", "", "allow"), ("net", "/x", "allow"), ("b.net", "/xyz", "block"), ("c.net", "/", "allow"), ("c.net", "/", "block")]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(None, urls[0], "x")], "page_id long, url string, host string")
    for own in (url_rules.RULES, rules):
        found = url_rules.judge(pages, url_rules.rule_table(spark, own))
        assert as_bag(found.collect()) == as_bag((k, *brute.verdict(u, own)[:3], brute.verdict(u, own)[3]) for k, u in [*enumerate(urls), (None, urls[0])])
        assert url_rules.judge(pages.where("false"), url_rules.rule_table(spark, own)).count() == 0
    empty = url_rules.judge(pages, url_rules.rule_table(spark).where("false"))
    assert {(r.rule, r.verdict) for r in empty.collect()} == {(None, "allow")}


@pytest.mark.parametrize("bucket_rows", [3, 2048])
def test_sharding(docs, rows, none, bucket_rows):
    found = sharding.shard(docs, shards=5, bucket_rows=bucket_rows).collect()
    assert as_bag((r.row.doc_id, r.row.text) for r in found) == as_bag((d, t) for d, t, _ in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r["size"] == len((r.row.text or "").encode()) + 1 and r.row["size"] == "x"
        assert r.text_crc32 == zlib.crc32((r.row.text or "").encode()) and r.law == "rows"
    assert sorted(slots) == list(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(none).count() == 0
