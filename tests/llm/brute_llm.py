"""Plain versions of the operators, for small tables of rows."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(texts, width):
    """For each text: bytes, removed bytes, runs, digest of the rest."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                mask[i : i + width] = b"\1" * width
        kept = bytes(x for x, gone in zip(b, mask) if not gone)
        out.append((len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


def contamination(texts, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            grams[tuple(words[k : k + window])].add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for text in texts:
        words = WORD.findall(lower(text))
        hit, found = [0] * len(words), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                own = grams.get(tuple(words[k : k + n]))
                if own:
                    found |= own
                    hit[k : k + n] = [1] * n
        out.append((len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def counts(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marks = [0] * len(words)
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            marks[k : k + 3] = [1] * 3
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    repeated = len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * sum(marks) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, sum(marks), failed


def components(rows, words, percent=80):
    """(doc_id, set size, component) of rows (doc_id, text) with distinct ids."""
    sets = {}
    for doc, text in rows:
        own = SPACED.findall(lower(text))
        grams = [tuple(own[i : i + words]) for i in range(len(own) - words + 1)] or ([tuple(own)] if own else [])
        sets[doc] = frozenset(grams)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for doc, grams in sets.items():
        shared = Counter(other for g in grams for other in holders[g])
        for other, k in shared.items():
            if 100 * k >= percent * (len(grams) + len(sets[other]) - k):
                a, b = find(doc), find(other)
                parent[max(a, b)] = min(a, b)
        for g in grams:
            holders[g].append(doc)
    return [(d, len(sets[d]), find(d)) for d in sets]


def targets(sizes, most=3):
    """Targets by source for {source: words}, by repeated sharing."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] > most * sizes[s] * total]
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            free.remove(s)
    return out


def verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        head = re.match(r"[^/?#]*", rest)[0]
        host, path = lower(head), re.match(r"[^?#]*", rest[len(head) :])[0]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, default, None)
    return host, path, best[3], best[2]


def payload_digest(page):
    return base64.b32encode(hashlib.sha1((page or "").encode()).digest()).decode()


def licence_ids(text, sentences, sentence_end, cue):
    """Identifiers of the known sentences that begin and end at line or sentence ends, the longest first."""
    text = text or ""
    if not re.search(cue, text):
        return []
    words = []  # word, whether a line begins with it, whether one ends with it
    for line in re.sub(sentence_end, "\n", text).split("\n"):
        plain, own = line.lower(), []
        for k, c in enumerate(plain):
            digits = 0 < k < len(plain) - 1 and plain[k - 1].isnumeric() and plain[k + 1].isnumeric()
            own.append(c if c.isalpha() or c.isnumeric() or (c == "." and digits) else " ")
        own = "".join(own).split()
        words += [(w, k == 0, k == len(own) - 1) for k, w in enumerate(own)]
    known = sorted(((s.split(" "), i) for s, i in sentences.items()), key=lambda x: -len(" ".join(x[0])))
    out, at = [], 0
    while at < len(words):
        for sentence, name in known if words[at][1] else ():
            part = words[at : at + len(sentence)]
            if [w for w, _, _ in part] == sentence and part[-1][2]:
                out.append(name)
                at += len(sentence)
                break
        else:
            at += 1
    return out


def licence_rules(ids, rules):
    left, found = list(ids), []
    for name, sequence in rules:
        k, hit = 0, False
        while k + len(sequence) <= len(left):
            if left[k : k + len(sequence)] == sequence:
                left[k : k + len(sequence)] = [None]
                hit = True
            k += 1
        if hit and name not in found:
            found.append(name)
    return found


def in_bands(text, bands, laden, chunk, bad_share, level):
    """Ratio of the whole text, and whether it and its chunks stay inside the bands."""
    import zstandard

    def fits(raw):
        ratio = len(raw) / len(zstandard.ZstdCompressor(level=level, write_content_size=True).compress(raw))
        for below, least, few, most in bands:
            if len(raw) < below:
                symbols = sum(raw.count(c) for c in b"#*$%&|<>")
                limit = few if symbols >= laden * len(raw.split()) else most
                return least <= ratio <= limit, ratio

    raw = (text or "").encode()
    if not raw:
        return 0.0, True
    whole, ratio = fits(raw)
    parts = [raw[k : k + chunk] for k in range(0, len(raw), chunk)] if len(raw) > chunk else []
    bad = sum(len(p) for p in parts if not fits(p)[0])
    return ratio, whole and bad <= bad_share * len(raw)
