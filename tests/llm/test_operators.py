"""Each operator against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import json
import random
import re
import zlib

import numpy as np
import pytest
from sparkfolio.llm import chat_format, components, decontamination, language_id, mixing, ngram_join, quality, secret_scan, substring_dedup, suffix_dedup, token_store
from sparkfolio.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# names that operators use inside clash with these extra columns on purpose
SCHEMA = "doc_id long, text string, lang string, source string, n long, spans string, kept string, size long, node long, term string"


def words(text):
    return WORD.findall(text or "")


def texts():
    rng = random.Random(11)
    vocabulary = ["the", "of", "and", "é"] + ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(90), say(20)
    out = [None, "", "  \n ", "one", "two words", say(12), say(13), "same " * 60, "a b " * 300]
    for k in range(40):
        t = say(rng.randint(5, 120))
        out.append(t if k % 4 else f"{t}\n{passage} {line}\n{line}\n{say(8)}")
    base = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(8):
        copy = list(base)
        copy[k * 9] = f"edit{k}"
        out.append(" ".join(copy))
    return out + [out[20], out[20], passage, say(20000), "été " + passage[3:]]


def table(spark, rows=None, schema=SCHEMA):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, ["en", None, "de"][i % 3] if i is not None else None, [None, "s1", "s2"][(i or 0) % 3], 1, "x", "y", 2, 3, "z") for i, t in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).repartition(5).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_substring_dedup(spark, docs):
    first, kept = {}, by_id(substring_dedup.remove_repeats(docs))
    w = {i: words(t) for i, t in enumerate(texts())}
    for d, x in w.items():
        for i in range(len(x) - 12):
            first.setdefault(tuple(x[i : i + 13]), d)
    for d, x in w.items():
        keep = [True] * len(x)
        for i in range(len(x) - 12):
            if first[tuple(x[i : i + 13])] < d:
                keep[i : i + 13] = [False] * 13
        expected = " ".join(a for a, k in zip(x, keep, strict=True) if k)
        assert (kept[d].n_words, kept[d].n_removed, kept[d].kept) == (len(x), len(x) - sum(keep), expected)


def spans_of(texts, size=13):
    """Spans by document, without Spark; also how many rows each k-mer has."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    sort = lambda rows, *by: pa.Table.from_batches(rows).sort_by([(c, "ascending") for c in by]).combine_chunks().to_batches(max_chunksize=17)
    parts = [batch.slice(i, 50) for i in range(0, len(texts), 50)]
    known = collections.defaultdict(list)
    for b in substring_dedup._marks(iter(sort([x for b in parts for x in substring_dedup._kmers(size, 5)(iter([b]))], "deal", "doc_id"))):
        for d, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
            known[d].append(k)
    marked = [pa.RecordBatch.from_arrays([*b.columns, pa.array([known[d] for d in b.column("doc_id").to_pylist()], pa.list_(pa.int64()))], ["doc_id", "text", "marks"]) for b in parts]
    rows = [x for b in marked for x in substring_dedup._paths(size, 5)(iter([b]))]
    t = sort(rows, "kmer", "doc_id") if rows else []
    spans = [(d, a, a + n + size - 1) for b in substring_dedup._repeats(iter(t)) for d, a, n, *_ in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    return spans, collections.Counter(k for b in t for k in b.column("kmer").to_pylist())


def test_substring_windows_that_share_32_bits(monkeypatch):
    # the upper halves of all windows' hashes are alike, their lower halves are not
    real = substring_dedup.window_hash
    monkeypatch.setattr(substring_dedup, "window_hash", lambda w, n: real(w, n) >> np.uint64(32) if n == 13 else real(w, n))
    phrase = "one phrase of five words"
    texts = [" ".join(f"w{k}x{i}" for i in range(8)) + f" {phrase} " + " ".join(f"v{k}x{i}" for i in range(8)) for k in range(60)]
    assert spans_of(texts)[0] == []
    assert {(d, a, b) for d, a, b in spans_of([texts[0], texts[1], texts[0]])[0] if d != 2} == set()


def test_substring_spans_are_verified():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(20))
    right = next(substring_dedup._digests(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([[{"sa": 2, "n": 13}, {"sa": 2, "n": 99}]])], ["doc_id", "text", "asked"])])))
    assert right.num_rows == 1
    for digest, gone in ((right.column("digest")[0].as_py(), 13), (b"x" * 16, 0)):
        batch = pa.RecordBatch.from_arrays([pa.array([2]), pa.array([text]), pa.array([[{"a": 2, "n": 13, "digest": digest}]])], ["doc_id", "text", "spans"])
        assert next(substring_dedup._kept(iter([batch]))).column("n_removed").to_pylist() == [gone]


def test_substring_settled_rows_have_no_company():
    spans, rows = spans_of([f"n{k} " + "a b " * 100 for k in range(400)])
    assert max(rows.values()) <= 8 * 189  # each of 8 pieces sends its first document's windows; no key gathers what is settled
    assert {d for d, _, _ in spans} == set(range(1, 400))


def test_substring_repeated_ids_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (5, a + " x"), (7, b), (None, a)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(d).collect()))
    assert got == [(0, 40, 0), (1, 40, 0), (5, 40, 0), (5, 40, 40), (5, 41, 40), (7, 40, 40)]


def test_substring_dedup_with_hot_kmers(spark, docs, monkeypatch):
    t = texts() + [" ".join([*(f"w{k}x{i}" for i in range(k % 9)), "one phrase of five words", "a b " * (k % 20), *(f"v{k % 7}x{i}" for i in range(20))]) for k in range(60)]
    d = table(spark, list(enumerate(t))).repartition(6).cache()
    row = lambda r: (r.doc_id, r.n_words, r.n_removed, r.kept)
    before = sorted(map(row, substring_dedup.remove_repeats(d).collect()))
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    for hot in (1, 10):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        assert substring_dedup.hot_cells(d.filter("text is not null"), 13, 5).any()
        assert sorted(map(row, substring_dedup.remove_repeats(d).collect())) == before
    monkeypatch.setattr(substring_dedup, "HOT", 1)
    test_substring_dedup(spark, docs)


@pytest.mark.parametrize("group, large", [(1024, 100_000), (2, 100_000), (2, 2)])
def test_suffix_dedup(spark, docs, group, large, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    got = by_id(suffix_dedup.remove_long_repeats(docs, 400))
    raw = {i: (t or "").encode() for i, t in enumerate(texts())}
    count = collections.Counter(b[i : i + 400] for b in raw.values() for i in range(len(b) - 399))
    for d, b in raw.items():
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                keep[i : i + 400] = bytes(400)
        expected = bytes(c for c, k in zip(b, keep, strict=True) if k)
        assert (got[d].n_bytes, got[d].n_spans, bytes(got[d].kept)) == (len(b), len(re.findall(b"\0+", bytes(keep))), expected)


def test_deep_shallow_sorts():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [b"a" * k for k in range(40)] * 2
    order, lcp = suffix_dedup.deep_shallow(strings)
    assert [strings[i] for i in order] == sorted(strings)
    assert all(lcp[k] == suffix_dedup.common(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))


@pytest.mark.parametrize("block", [1024, 3])
def test_ngram_join(spark, docs, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = {}
    for i, t in enumerate(texts()):
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    linked = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    low = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    got = by_id(ngram_join.near_duplicates(docs))
    assert {d: (r.class_id, r.n_links) for d, r in got.items()} == {d: (low[d], sum(a == d for a, _ in linked)) for d in sets}


def test_bands_reach_the_recall():
    b, r = ngram_join.choose_bands(0.8, 0.999999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999999


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50) if i != 20] + [(7, 7), (3, 4)], "u long, v long")
    assert {r.node: r.component for r in components.connected_components(e).collect()} == {i: 0 if i <= 20 else 21 for i in range(51)}
    assert components.connected_components(e.limit(0)).isEmpty()


def benchmark(spark):
    t = texts()
    rows = [(0, t[9]), (1, " ".join(words(t[12])[:30]).upper()), (2, "the"), (3, None), (4, "!?"), (5, t[9])]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(spark, docs):
    rx, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: rx.findall((t or "").translate(low))
    windows = collections.defaultdict(set)
    for r in benchmark(spark).collect():
        w = split(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(r.item_id))
    got = by_id(decontamination.contamination(docs, benchmark(spark)))
    for d, t in enumerate(texts()):
        w, hit, items = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[k]
        assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == (len(w), len(hit), sorted(items))


def test_proximity(spark):
    rng = random.Random(12)
    words_of = [f"w{k}" for k in range(30)]
    items = [[rng.choice(words_of) for _ in range(n)] for n in (1, 2, 4, 6, 12)]
    rows = []
    for k in range(80):
        w = [rng.choice(words_of + ["x", "y"]) for _ in range(rng.randint(0, 30))]
        if k % 2:  # an item with words put in and left out
            for t in items[k % 5]:
                w += [t] + ["x"] * rng.choice([0, 0, 0, 1, 2])
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: set(r.near_items) for r in decontamination.contamination(d, b, 10, 2).collect()}
    often = collections.Counter(t for _, text in rows for t in text.split() if t in {x for w in items for x in w})
    # which of equally frequent terms is the first is the plan's choice
    index, windows, plan = decontamination.prepare(d, b, 10)
    first = {r.win: (r.terms[0].offset, len(r.terms), r.terms[0].often, r.terms[0].term, [(t.term, t.offset) for t in r.terms]) for r in plan.collect()}
    names = collections.defaultdict(set)
    phrase = {}
    for r in windows.collect():
        names[r.win].add(str(r.item_id))
        phrase[r.win] = list(r.phrase)
    assert all(o[2] == min(often[t] for t in phrase[w]) for w, o in first.items())
    for i, text in rows:
        w, want = text.split(), set()
        for win, g in phrase.items():
            back = first[win][0]
            second = first[win][4][1][1] if len(g) > 1 else None
            for at, t in enumerate(w):
                if t != g[back]:
                    continue
                fits = lambda o, at=at, back=back, g=g, w=w, second=second: any(0 <= q < len(w) and w[q] == g[o] and not (o == second and q == at) for q in range(at - back + o - 2, at - back + o + 3))
                if all(o == back or fits(o) for o in range(len(g))):
                    want |= names[win]
        assert got[i] == want, (i, got[i], want)


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert {(r.doc_id, r.size) for r in got} == {(i, len(words(t))) for i, t in enumerate(texts())}
    size = collections.Counter()
    for r in got:
        size[r.source] += r.size
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s)), (3, 1, 2), strict=True))
    cap, total, level = {s: 2 * n for s, n in size.items()}, 1.5 * sum(size.values()), 0.0
    for _ in range(9):
        free = [s for s in size if cap[s] > weight[s] * level]
        level = (total - sum(cap[s] for s in size if s not in free)) / sum(weight[s] for s in free) if free else level
    assert all(r.target == pytest.approx(min(cap[r.source], weight[r.source] * level)) and r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, mixing.mix(docs.repartition(2)).collect())) == sorted(map(str, got))


def test_quality_base_counts(spark, docs):
    got = by_id(quality.quality(docs))
    for d, t in enumerate(texts()):
        t, w = t or "", words(t)
        grams, covered = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [False] * len(w)
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                covered[i : i + 5] = [True] * 5
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(covered))
        assert r.base_failed == (len(w) < 10 or 100 * sum(covered) > 20 * len(w)) and (not r.kept or not r.base_failed)


def test_quality_drops_texts_without_common_words(spark):
    rng = random.Random(5)
    common = {"en": ["the", "of", "something", "otherwise"], "de": ["der", "und", "gesellschaft", "ebenfalls"]}
    rare = lambda k: "".join(rng.choice("abcdefghiklmnoprst") for _ in range(k))
    say = lambda lang, n: " ".join(rng.choice(common[lang]) if rng.random() < 0.37 else rare(rng.randint(4, 9)) for _ in range(n))
    rows = [(i, say(lang, rng.randint(55, 500)), lang) for i in range(600) for lang in [["en", "de"][i % 2]]]
    rows += [(1000 + i, " ".join(rare(rng.randint(4, 9)) for _ in range(55 << i % 4)), ["en", "de"][i % 2]) for i in range(8)]  # word lists
    rows += [(2000 + i, say("de", 200 + i), "en") for i in range(4)] + [(3000 + i, " ".join(rng.choice(common["en"][:1]) if k % 33 == 0 else rare(7) for k in range(300)), "en") for i in range(4)]
    got = by_id(quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert not [i for i in got if i >= 1000 and got[i].kept]
    assert sum(got[i].kept for i in range(600)) >= 594
    refs = quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    word = np.frombuffer(b"something", dtype=np.uint8)
    assert quality.SpanHash(word)(np.array([0]), np.array([9]))[0] in refs["en"][1]


def test_jensen_shannon():
    assert quality.jensen_shannon(np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([0.5, 0.5])) == pytest.approx([0.5579, 0], abs=1e-3)


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    more = docs.unionByName(table(spark, [(500, "It's <|endoftext|> U.S. 12.5, ÉTÉ… end., a b 'll café. İ ǅ"), (501, "x" * 3000), (502, texts()[20])]))
    tok = Tokenizer.from_file(tokenizer_path())
    folder = token_store.write_store(more, tokenizer_path())
    got = by_id(token_store.read_store(spark, folder, tokenizer_path()))
    ids = {r.doc_id: r.ids for r in token_store.read_ids(spark, folder, tokenizer_path()).collect()}
    start = 0
    for r in more.select("doc_id", "text").orderBy("doc_id").collect():
        expected = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert ids[r.doc_id] == expected
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(expected), zlib.crc32(np.array(expected, dtype="<u4").tobytes()))
        start += len(expected)
    stored = spark.read.parquet(f"{folder}/objects").filter("kind = 0")
    assert stored.count() == stored.select("digest").distinct().count()


def test_chunks_realign():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 49000, 30000).astype("<u2")
    b = np.concatenate([rng.integers(0, 49000, 777).astype("<u2"), a])
    chunk = lambda x: [x[s:e].tobytes() for s, e in zip([0, *token_store.cuts(x)], token_store.cuts(x), strict=False)]
    assert b"".join(chunk(a)) == a.tobytes() and len(set(chunk(a)) & set(chunk(b))) > 0.8 * len(chunk(a))


def test_language_id(spark):
    rng = random.Random(2)
    syllables = {"en": ["th", "er", "ing", "on"], "fr": ["é", "eau", "que", "ou"], "de": ["sch", "ung", "ei", "ß"]}
    say = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    rows = [(i, say(lang), lang) for i in range(120) for lang in [["en", "fr", "de"][i % 3]]] + [(900, None, "en"), (901, "", None), (902, "12 !", "fr"), (903, "qzx jqw vvk " * 30, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.identify(d, language_id.fit(d.filter(~language_id.held_out()))))
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 and not got[i].rejected for i, _, lang in rows[:120])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902)) and got[903].rejected
    assert language_id.fit(d.limit(0)) == [] and by_id(language_id.identify(d, []))[0].lang_pred == "und"


def test_chat_format(spark):
    calls = [(1, 0, "a", "f", '{"x":1}', ["b"]), (1, 2, "b", "f", '{"x":"no"}', []), (1, 3, "c", "f", "{", ["d"]), (1, 4, "d", "g", None, ["c"]), (1, 9, "a", "f", '{"x":2}', [])]
    results = [(1, 5, "a", "A"), (1, 6, "zz", "lost"), (1, 7, "a", "late")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    m = spark.createDataFrame([(1, 1, "system", "hé"), (2, 0, "system", None)], "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat_format.format_chats(m, c, r, {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}}).collect()}
    one = json.loads(got[1].chat)
    assert [x["id"] for x in one["calls"]] == ["b", "a", "c", "d"] and (got[1].n_calls, got[1].n_linked, got[1].n_orphans, got[1].n_invalid, got[1].n_cyclic) == (4, 1, 1, 3, 2)
    assert one["calls"][1]["result"] == "A" and got[1].chat == chat_format.canonical(one) and "hé" in got[1].chat
    assert got[2].n_messages == 1


def test_empty_tables(spark):
    none = table(spark, [])
    assert substring_dedup.remove_repeats(none).isEmpty() and suffix_dedup.remove_long_repeats(none).isEmpty() and ngram_join.near_duplicates(none).isEmpty()
    assert mixing.mix(none).isEmpty() and quality.quality(none).isEmpty() and secret_scan.scan(none).isEmpty()
    assert decontamination.contamination(none, benchmark(spark).limit(0)).isEmpty()
    assert token_store.read_store(spark, token_store.write_store(none, tokenizer_path()), tokenizer_path()).isEmpty()


def test_repeated_rows_and_null_ids(spark):
    t = texts()[9]
    d = table(spark, [(5, t), (5, t), (None, t), (6, None)])
    assert [(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(d).orderBy("doc_id").collect()] == [(None, 0), (5, 0), (5, 0), (6, 0)]
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_join.near_duplicates(d).collect()) == [(0, 0, 0), (5, 5, 1), (5, 5, 1), (6, 6, 0)]
    assert decontamination.contamination(d, benchmark(spark)).count() == 4 and mixing.mix(d).count() == 4


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before.columns, name
        assert docs.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_pipeline_decides_each_row_once(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    say = lambda: " ".join("".join(rng.choice("abcdefghiklm") for _ in range(6)) for _ in range(60))
    a, b, c, d, leak = (say() for _ in range(5))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts_of = lambda stage, rows: sorted((r.doc_id or -1, r.text) for r in stage(spark, table(spark, rows), str(tmp_path)).collect())
    # a clean row without an id stays, a copy goes, one id with two texts keeps both
    rows = [(None, a), (7, b), (7, c), (7, c), (8, b), (None, d), (9, d)]
    assert texts_of(corpus_pipeline.near_duplicates, rows) == sorted([(-1, a), (7, b), (7, c), (9, d)])
    rows = [(None, leak), (None, a), (7, b), (7, leak), (8, c)]
    assert texts_of(corpus_pipeline.decontaminated, rows) == sorted([(-1, a), (7, b), (8, c)])
    rows = [(None, a), (None, b), (7, b), (7, b), (7, b), (8, c)]
    want = collections.Counter()
    for r in mixing.mix(table(spark, rows)).collect():
        want[r.doc_id or -1] += r.times
    got = collections.Counter(i for i, _ in texts_of(corpus_pipeline.mixture, rows))
    assert got == +want


def test_pipeline_stages_with_clashing_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    names = ["_row", "_TIMES", "_class", "_key", "_text", "time", "times", "score", "rejected", "entropy", "lang_pred", "class_id", "n_hit", "col", "key", "n", "bucket", "target"]
    rng = random.Random(9)
    say = lambda k: " ".join("".join(rng.choice(["abc", "klm", "xyz"][k % 3]) for _ in range(5)) for _ in range(60))
    rows = [(i, say(i), f"l{i % 3}", f"s{i % 2}", *([7] * len(names))) for i in range(90)] + [(None, say(0), "l0", None, *([7] * len(names))), (3, None, "l0", "s1", *([7] * len(names)))]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{x}` long" for x in names)
    spark.createDataFrame([(1, say(1))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table_of in (rows, []):
        docs = spark.createDataFrame(table_of, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            kept = out.collect()
            assert bool(kept) == bool(table_of) and all(r[x] == 7 for r in kept for x in names), name
