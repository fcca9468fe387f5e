"""Kept and dropped texts against plain histograms."""

import collections
import math
import random

import pytest

from sparkfolio.llm import quality

MARKS, SYMBOLS, SPACE = ".,;:'\"?!-()", "#*$%&|<>", " \t\n\v\f\r"


def plain_class(b):
    c = chr(b)
    for k, own in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SPACE, MARKS, SYMBOLS)):
        if c in own:
            return k
    return 6 if b < 128 else 7


def plain_words(text):
    out = []
    for w in text.encode().split():  # ASCII white space only
        for _ in range(3):
            if len(w) > 1 and w[-1] < 128 and plain_class(w[-1]) >= 4:
                w = w[:-1]
        out.append(bytes(b + 32 if 65 <= b <= 90 else b for b in w))
    return out


def distance(p, q):
    keys = set(p) | set(q)
    total = lambda x: max(sum(x.values()), 1)
    d = 0.0
    for k in keys:
        a, b = p.get(k, 0) / total(p), q.get(k, 0) / total(q)
        m = (a + b) / 2
        d += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(d / 2, 0))


def folded(words, common):
    return collections.Counter(w if w in common else None for w in words)


def plain_verdicts(rows):
    """(class distance, word distance, limit) of each (text, lang)."""
    out = [None] * len(rows)
    for lang in {la for _, la in rows}:
        own = [(i, t or "", plain_words(t or "")) for i, (t, la) in enumerate(rows) if la == lang]
        classes, counts = collections.Counter(), collections.Counter()
        for _, t, w in own:
            classes.update(map(plain_class, t.encode()))
            counts.update(w)
        common = {w for w, _ in counts.most_common(quality.COMMON)}
        whole = folded(counts.elements(), common)
        far = {i: distance(folded(w, common), whole) for i, _, w in own if len(w) >= quality.MIN_WORDS}
        power = {i: len(w).bit_length() for i, _, w in own}
        limit, limits = min(quality.MAX_WORDS, distance({None: 1}, whole) - 1e-6), {}
        for p in range(64):
            seen = sorted({round(far[i], 12) for i in far if power[i] == p})
            if len(seen) >= quality.ENOUGH:
                at = lambda f: seen[math.ceil(f * len(seen)) - 1]
                limit = min(limit, at(0.5) + max(quality.SPREAD * (at(0.75) - at(0.5)), quality.LEAST))
            limits[p] = limit
        for i, t, _ in own:
            near = distance(collections.Counter(map(plain_class, t.encode())), classes) if len(t.encode()) >= quality.MIN_CHARS else 0.0
            out[i] = near, far.get(i, 0.0), limits[power[i]]
    return out


def test_kept_against_plain_histograms(spark):
    rng = random.Random(17)
    letters = "abcdefghiklmnoprstué"
    vocabulary = {la: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(200)] for la in ("xx", None)}
    rows = []
    for k in range(260):
        la = "xx" if k % 4 else None
        common = list(dict.fromkeys(vocabulary[la]))[: quality.COMMON]
        share = 0.02 if k % 23 == 7 else rng.uniform(0.35, 0.6)
        word = lambda: common[int(rng.random() ** 2 * len(common))] if rng.random() < share else "".join(rng.choice(letters) for _ in range(11))
        text = " ".join(w.capitalize() if rng.random() < 0.1 else w + rng.choice(["", "", "", ".", ",", "?!"]) for w in (word() for _ in range(rng.choice([5, 40, 70, 90, 120, 200, 400]))))
        rows.append(("#$%&" * 200 + " " + text if k % 29 == 3 else text, la))
    rows += [(None, "xx"), ("", None), rows[5], rows[5]]
    plain = plain_verdicts(rows)
    docs = spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    dropped = 0
    for i, (near, far, limit) in enumerate(plain):
        r = got[i]
        assert r.class_distance == pytest.approx(near, abs=1e-9) and r.word_distance == pytest.approx(far, abs=1e-9)
        if min(abs(near - quality.MAX_CLASS), abs(far - limit)) > 1e-6:
            assert r.kept == (not r.base_failed and near <= quality.MAX_CLASS and far <= limit), (i, near, far, limit)
            dropped += not r.kept and not r.base_failed
    assert len(got) == len(rows) and dropped >= 10
