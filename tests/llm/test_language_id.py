"""Language models against the plain formula, by shards, and on marks, ties and clashing names."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from sparkfolio.llm import language_id
from sparkfolio.llm.text import pieces

TEXTS = {"a": ["abracadabra alakazam", "a bad cab", "banana band banana"], "b": ["the cat sat on the mat", "that hat", "a", "on"], "c": ["zz top", "pizza zzz", "xyz"]}


def folded(text):
    return " " + " ".join(re.findall("[a-z]+", text.lower()))


class Plain:
    """Interpolated Kneser-Ney as in the textbook, by dictionaries."""

    def __init__(self, texts, size):
        self.size, self.c = size, [Counter() for _ in range(6)]
        kinds = [defaultdict(set) for _ in range(6)]
        for t in map(folded, texts):
            for i in range(len(t)):
                for n in range(1, 6):
                    if i + n <= len(t):
                        g = t[i : i + n]
                        if n == 5:
                            self.c[5][g] += 1
                        elif i == 0:
                            self.c[n][g] += 1
                        if n > 1:
                            kinds[n - 1][g[1:]].add(g[0])
        for n in range(1, 5):
            for g, before in kinds[n].items():
                self.c[n][g] += len(before)

    def p(self, n, context, ch):
        if n == 0:
            return 1 / self.size
        c = self.c[n]
        after = {g: k for g, k in c.items() if g[:-1] == context}
        if not after:
            return self.p(n - 1, context[1:], ch)
        once, twice = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
        d = min(max((once + 0.5) / (once + 2 * twice + 1), 0.1), 0.9)
        total = sum(after.values())
        return max(c[context + ch] - d, 0) / total + d * len(after) / total * self.p(n - 1, context[1:], ch)

    def entropy(self, text):
        t = folded(text)
        return -sum(math.log(self.p(min(5, i + 1), t[max(0, i - 4) : i], t[i])) for i in range(1, len(t))) / (len(t) - 1)


def counted(spark):
    grams = Counter()
    for lang, texts in TEXTS.items():
        for t in map(folded, texts):
            grams.update((lang, t[k : k + 5]) for k in range(len(t) - 4))
            grams.update((lang, t[:k]) for k in range(1, min(5, len(t) + 1)))
    return spark.createDataFrame([(lang, g, n) for (lang, g), n in grams.items()], "lang string, gram string, n long")


def test_model_follows_the_formula(spark):
    stats = language_id.statistics(counted(spark)).toArrow()
    rows = stats.to_pylist()
    met = {(x, n): tuple(sum(r["lang"] == x and r["c"] == k and len(r["gram"]) == n for r in rows) for k in (1, 2)) for x in TEXTS for n in range(1, 6)}
    size = len({c for texts in TEXTS.values() for t in map(folded, texts) for c in t}) + 1
    asked = ["abra banana", "the hat", "zzz", "qqq the", "a", "unseen words entirely", "cat"]
    p = next(pieces(pa.array(asked)))
    for langs in (list(TEXTS), ["b"]):
        mine = {"lang": [], "gram": [], "c": [], "total": [], "kinds": []}
        for r in rows:
            if r["lang"] in langs:
                for k in mine:
                    mine[k].append(r[k])
        model = language_id.Model(langs, pa.table(mine), met, size)
        _, h = model.score(p)
        want = [[Plain(TEXTS[x], size).entropy(t) for x in langs] for t in asked]
        assert np.allclose(h, want, atol=1e-5)


def test_probabilities_sum_to_one():
    size = len({c for texts in TEXTS.values() for t in map(folded, texts) for c in t}) + 1
    plain = Plain(TEXTS["a"], size)
    seen = {c for t in map(folded, sum(TEXTS.values(), [])) for c in t}
    for context in ("", "a", "ban", "anan", "qq"):
        total = sum(plain.p(len(context) + 1, context, c) for c in seen) + plain.p(len(context) + 1, context, "?")
        assert total == pytest.approx(1, abs=1e-9)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    parts = {f"l{k}": ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(3)) for _ in range(12)] for k in range(5)}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(40)), x) for i in range(300) for x in [f"l{i % 5}"]]
    more = [(901, "\u0301 12 \u0301", None), (902, None, "l1"), (903, "", "l1"), (904, "42", None), (904, "42", None), (None, rows[0][1], None), (905, rows[0][1], "l0"), (905, rows[0][1], "l0"), (906, "\u00c9\u0301 q", None)]
    return rows, spark.createDataFrame([(*r, 1.0, True, "x") for r in rows + more], "doc_id long, text string, lang string, score double, rejected boolean, _low string").repartition(4)


def test_shards_change_nothing(spark, labelled, monkeypatch):
    rows, d = labelled
    got = []
    for shard in (8, 2, 1):
        monkeypatch.setattr(language_id, "SHARD", shard)
        models = language_id.fit(d.filter(~language_id.held_out()))
        assert [len(m.langs) for m in models] == [min(shard, 5 - k) for k in range(0, 5, shard)]
        out = language_id.identify(d, models, ("doc_id", "text", "_low")).collect()
        got.append(sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred, round(r.score, 4), round(r.entropy, 4), r.rejected) for r in out))
    assert got[0] == got[1] == got[2] and len(got[0]) == d.count()
    lang = {i: x for i, x, *_ in got[0]}
    assert all(lang[i] == x for i, _, x in rows)
    # marks and digits are no letters; repeated rows and rows without an id are predicted each
    assert all(lang[i] == "und" for i in (901, 902, 903, 904)) and lang[906] != "und" and lang[-1] == lang[905] == "l0"
    assert [x[1:] for x in got[0] if x[0] == 905][0] == [x[1:] for x in got[0] if x[0] == -1][0]


def test_bounds_of_the_sample_hold_for_long_texts(spark, labelled):
    rows, d = labelled
    models = language_id.fit(d, train_rows=20, train_chars=2000)
    assert 0 < sum(len(k) for m in models for k in m.keys) < sum(len(k) for m in language_id.fit(d) for k in m.keys)
