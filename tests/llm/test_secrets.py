"""Secret scan: base spans against a plain scanner, automata against step-by-step scoring, recall by format, clean text."""

import random
import string

import numpy as np
import pytest
from sparkfolio.llm import secret_scan as S

TOKEN = set(string.ascii_letters + string.digits + "+/_.=-")


def plain(text):
    """The base patterns by hand, without regular expressions."""
    out, low = [], "".join(c.lower() if c in string.ascii_letters else c for c in text)
    run = lambda i, ok: next((j for j in range(i, len(text) + 1) if j == len(text) or text[j] not in ok), i)
    i = 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i):
                for quote in (1, 0):  # greedy first, then back
                    j = i + len(word)
                    if quote and not (j < len(text) and text[j] in "\"'"):
                        continue
                    j = run(j + quote, " ")
                    if j < len(text) and text[j] in ":=":
                        j = run(j + 1, " ")
                        j += j < len(text) and text[j] in "\"'"
                        if (e := run(j, TOKEN)) > j:
                            end, size = e, e - j
                            break
                if end:
                    break
        if end:
            if size >= 6:
                out.append(("assign", i, end))
            i = end
        else:
            i += 1
    for kind, ok, least, head in (("access", set(string.ascii_uppercase + string.digits), 20, "AKIA"), ("hex", set("0123456789abcdef"), 24, "")):
        i = 0
        while i < len(text):
            e = run(i + len(head), ok) if text.startswith(head, i) else i
            if e > i + len(head):
                if e - i >= least:
                    out.append((kind, i, e))
                i = e
            else:
                i += 1
    return sorted(out, key=lambda x: (x[1], S.KINDS.index(x[0])))


def test_base_spans_against_a_plain_scanner(spark):
    rng = random.Random(8)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "=", ":", " ", "  ", '"', "'", "abc", "DEF123", "0f9e8d7c6b5a", "é", "\n", "x=", "token=token", "\u017fecret=abcdefgh", "A" * 16, "."]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))) for k in range(400)]
    rows += [(900, None), (901, ""), (None, "token=abcdef"), (902, "api_key=" + "k" * 100_000), (903, "token: abcdef"), (903, "token: abcdef")]
    got = S.scan(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string").repartition(3)).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans if s.kind != "format"]) for r in got), key=key) == sorted(((i, plain(t or "")) for i, t in rows), key=key)
    assert sum(len(plain(t or "")) for _, t in rows) > 100


@pytest.fixture(scope="module")
def detector():
    return S.published()


def accepted(detector, strings):
    size = np.array([len(s) for s in strings])
    flat = S._SYMBOL[np.frombuffer("".join(strings).encode(), dtype=np.uint8)]
    return detector.accepts(flat, np.cumsum(size) - size, size)


def test_scores_step_by_step(detector):
    strings = [S.labelled_credentials(x, 3, 5)[k] for x in S.FORMATS for k in range(3)] + ["word", "a", "Getting.started", "x" * 90]
    scores = detector.scores(strings)
    for m, a in enumerate(detector.automata):
        assert np.allclose(scores[:, m], [a.score(s) for s in strings])
    for s, row in zip(strings, scores, strict=True):
        q, total = detector.ordinary.start, 0.0
        for c in s:
            k = S.SYMBOLS.index(c)
            total, q = total + detector.ordinary.logp[q, k], detector.ordinary.next[q, k]
        assert row[-1] == pytest.approx(total + detector.ordinary.end[q])


def test_automata_keep_lengths_and_merge_the_rest(detector):
    for name, a in zip(detector.names, detector.automata, strict=True):
        prefix, _, length = S.FORMATS[name]
        assert len(prefix) + length < a.states <= len(prefix) + length + 8, name
        assert a.likely[len(prefix) + length] and not a.likely[len(prefix) + length - 2]


def test_recall_of_each_format_and_placement(spark):
    keys = {x: S.labelled_credentials(x, 300, 77) for x in S.FORMATS}
    places = ("{}", "note value={}, then", 'x:"{}".', "{}.", "path/{}", "key-{}", "{}/x", "https://h/{}", "a.b_{}.c")
    rows = [(x, t, k, t.format(k)) for x, own in keys.items() for t in places for k in own]
    docs = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(4)
    hit = dict.fromkeys(((x, t) for x in keys for t in places), 0)
    for r in S.scan(docs).collect():
        x, t, key, text = rows[r.doc_id]
        hit[x, t] += any(text[a:b] == key for _, a, b in r.spans)
    assert min(hit.values()) >= 0.95 * 300, hit


def test_ordinary_text_is_left_alone(detector):
    clean = ["4111111111111111", "3668798256337530", "20240131123000000", "Donaudampfschifffahrtsgesellschaft", "getUserAccountBalanceFromHttpRequest", "SCREAMING_CASE_CONSTANT_NAME", "counterrevolutionaries", "abababababababab",
             "----------------", "src/main/java/org/Example", "ACGTTGCAACGTGGCATTACGATCG", "1234567890123456", "internationalisation_2024", "a" * 40, "AKIA", "x", "ab" * 20, "the-quick-brown-fox-jumps-over-lazy-dogs"]
    assert not accepted(detector, clean).any()


def test_learned_from_labelled_credentials(spark):
    rng = random.Random(6)
    draw = lambda n: ["tk-" + "".join(rng.choice("ACDFHJKLMN23456") for _ in range(rng.choice([12, 18]))) for _ in range(n)]
    rows = [("house token", s) for s in draw(600)] + [("house token", None), (None, "abc"), ("house token", "not a token!")]
    d = S.learned(spark.createDataFrame(rows, "format string, credential string"))
    fresh = draw(300)
    assert d.names == ["house token"] and accepted(d, fresh).mean() >= 0.95
    assert not accepted(d, ["tk-" + "".join(rng.choice("ACDFHJKLMN23456") for _ in range(n)) for n in (5, 9, 15, 25)]).any()
    got = S.scan(spark.createDataFrame([(1, f"use {fresh[0]} now")], "doc_id long, text string"), d).collect()[0]
    assert [tuple(x) for x in got.spans] == [("format", 4, 4 + len(fresh[0]))]


def test_keys_inside_runs(spark, detector):
    """Two keys beside each other, and a key behind a letter where its format has a literal prefix."""
    keys = {x: S.labelled_credentials(x, 40, 91) for x in S.FORMATS}
    rows, want = [], {}
    for x, own in keys.items():
        for k, (a, b) in enumerate(zip(own[::2], own[1::2])):
            glue = "." if x != "hex digest" else "/"
            rows.append((len(rows), f"{a}{glue}{b}"))
            want[len(rows) - 1] = {(0, len(a)), (len(a) + 1, len(a) + 1 + len(b))}
            if len(S.FORMATS[x][0]) >= S.LITERAL:
                rows.append((len(rows), f"x{a}"))
                want[len(rows) - 1] = {(1, 1 + len(a))}
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(want[r.doc_id] <= {(a, b) for _, a, b in r.spans} for r in got)
    assert found >= 0.9 * len(rows)


def test_false_positives_on_words(spark):
    """Joined words, paths and names of the given word list: none of 20,000 is a credential."""
    rng = random.Random(13)
    words = S.WORDS.split()
    lines = [rng.choice(["/", "-", "_", ".", ""]).join(rng.choice(words) for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    got = S.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    wrong = got.filter("exists(spans, s -> s.kind = 'format')").count()
    assert wrong <= 20, wrong
