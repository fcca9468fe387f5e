"""Vector codes, conversation repair and line dedup against plain versions; rows of one or no id for others."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import chat_repair, decontamination, line_dedup, perfect_hash, suffix_dedup, vector_codes
from sparkfolio.llm.rows import free_name, keyed


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label_error) of each kept row and the codebooks, one vector after another."""
    fine = [(i, v, la) for i, v, la in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = {}
    for _, v, _ in fine:
        if len(v) % parts == 0:
            sizes[len(v)] = sizes.get(len(v), 0) + 1
    if not sizes:
        return [], []
    size = max(sizes, key=lambda n: (sizes[n], -n))
    kept = [(i, [math.floor(256 * Fraction(x)) for x in v], la, v) for i, v, la in fine if len(v) == size]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    w = size // parts
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(parts)]
    split = [cut(v) for _, v, *_ in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda book, x: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = {}
            for s in split:
                own.setdefault(near(book, s[p])[1], []).append(s[p])
            new.append([tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(book)])
        books = new
    out, sums = [], {}
    for (i, _, la, _), s in zip(kept, split):
        best = [near(book, x) for book, x in zip(books, s)]
        error = sum(d for d, _ in best)
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, la))
        sums[la] = sums.get(la, 0) + error
    fits = lambda x: x if x < 2**63 else None
    return [(i, c, fits(e), fits(sums[la])) for i, c, e, la in out], books


def vectors(kind):
    rng = random.Random(kind)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([1, 2, None])) for i in rng.sample(range(500), 150)]
    if kind == "odd":
        rows += [(None, [0.5] * 32, None), (7, None, 1), (8, [], 1), (9, [None] + [0.1] * 31, 1), (10, [float("nan")] + [0.1] * 31, 2), (11, [float("inf")] * 32, 2)]
        rows += [(12, [0.1] * 16, 3), (13, [0.1] * 31, 3), rows[0], rows[0], (rows[1][0], [0.25] * 32, 9)]
    if kind == "few":
        rows = rows[:5] + rows[:2]
    if kind == "wide":
        rows = [(i, [x * 1e30 if i % 9 == 0 else x for x in v], la) for i, v, la in rows[:70]]
    return rows


@pytest.mark.parametrize("kind", ["plain", "odd", "few", "wide"])
def test_vector_codes(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit(1), "V": F.lit(2), "error": F.lit(3)}).repartition(5)
    coded, books = vector_codes.compress(df)
    got = sorted((r.id is None, r.id or 0, r.code, str(r.error), str(r.label_error)) for r in vector_codes.with_label_errors(coded).collect())
    expected, plain = plain_codes(rows)
    assert [[tuple(map(int, e)) for e in b] for b in books] == plain
    assert got == sorted((i is None, i or 0, c, str(e), str(s)) for i, c, e, s in expected)


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [1.0] * 15, 1)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(df)
    assert books is None and vector_codes.with_label_errors(coded).count() == 0 and vector_codes.books_sha256(books) == hashlib.sha256(b"").hexdigest()


def plain_edits(rows):
    """Least (cost, audit) over all repairs, by states from the last row to the first; rows: (initial, must go, truncated)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    put = {"": "u", "s": "u", "u": "a", "a": "u"}
    behind = {q: min((0, "") if q in ("", "a") else (9**9, ""), (2, "I") if q == "u" else (9**9, ""), (4, "II") if q == "s" else (9**9, "")) for q in put}
    for initial, gone, cut in reversed(rows):
        here = {}
        for q in put:
            ways = [(behind[q][0] + 3, "D" + behind[q][1])]
            if not gone:
                if (q, initial) in step:
                    c, a = behind[step[q, initial]]
                    ways.append((c + cut, "K" + a))
                c, a = behind[put[q]]
                ways.append((c + 2 + cut, "R" + a))
            here[q] = min(ways)
        for _ in range(3):  # insertions before the row
            for q, to in put.items():
                here[q] = min(here[q], (here[to][0] + 2, "I" + here[to][1]))
        behind = here
    return behind[""]


def plain_repair(rows):
    """The query's row of each conversation, by the contract's sentences."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            after += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = {t for t, *_ in after if t is not None}
        faults, seen, symbols = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in after:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit = plain_edits(symbols)
        made, at, left = [], "", iter(after)
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(left)
            if e in "IR":
                role = "assistant" if at == "u" else "user"
            if e != "D":
                made.append(f"{role}:{text}")
                at = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_chat_repair(spark):
    rng = random.Random(21)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "so?", "long " * 4000 + "end.", "é ü.", None]
    rows = []
    for conv in [*range(60), None]:
        for turn in sorted(rng.sample(range(30), rng.randint(0, 12))):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
        rows += [rng.choice(rows)] if rows and rng.random() < 0.3 else []
        rows += [(conv, None, "user", "no turn.")] if rng.random() < 0.2 else []
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"CONV": F.lit(1), "gone": F.lit(2)}).repartition(7)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in chat_repair.repair(df).collect()}
    assert got == plain_repair(rows)
    assert chat_repair.repair(df.limit(0)).count() == 0


def test_chat_repair_of_a_long_conversation(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"line {t % 900}" + rng.choice([".", ""])) for t in range(6000)]
    got = chat_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert tuple(got)[1:] == plain_repair(rows)[1]


def test_the_automaton_has_few_states():
    rng, r = random.Random(1), chat_repair.Repairs()
    for _ in range(3000):
        rows = bytes(rng.randrange(9) for _ in range(rng.randint(0, 40)))
        initials = [("sua?"[k % 4], False, int(k >= 4)) if k < 8 else ("u", True, 0) for k in rows]
        assert r.repair(rows) == plain_edits(initials)
    assert len(r.vectors) < 100


def plain_lines(texts, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    split = [(t or "").split("\n") for t in texts]
    count = {}
    for lines in split:
        for k in {key(x) for x in lines}:
            count[k] = count.get(k, 0) + 1
    out = []
    for lines in split:
        stay = [x for x in lines if not key(x) or count[key(x)] < least]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("shard_keys", [3, 1 << 16])
def test_line_dedup(spark, shard_keys):
    rng = random.Random(31)
    lines = ["", " ", "Cookies", " cookies\t", "COOKIES\r", "Ünder", "ünder", "x", *(f"only {i}" for i in range(80))]
    texts = [None, "", "\n", "\n\nCookies\n"] + ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["cookies\n" + "y" * 300_000]
    ids = [rng.choice([None, *range(40)]) for _ in texts]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, text string, ROW int").withColumn("drop", F.lit(1)).repartition(6)
    got = line_dedup.drop_common_lines(df, 5, shard_keys).collect()
    expected = [(i, *x) for i, x in zip(ids, plain_lines(texts, 5))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert any(x[2] for x in expected)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = line_dedup.drop_common_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, "")]


def test_lines_of_one_hash_are_told_apart(spark):
    counted = spark.createDataFrame([(5, 1, 10), (5, 2, 3), (6, 7, 4)], "h long, f int, n long")
    shard = line_dedup.Shard(line_dedup.index_of(counted, 1).first().asDict())
    import numpy as np

    asked = np.array([(5, 1), (5, 2), (6, 7)], dtype=line_dedup._ENTRY)
    assert shard(asked).tolist() == [10, 3, 4]


def test_perfect_hash():
    import numpy as np

    for n in (0, 1, 2, 9, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
        slots = perfect_hash.PerfectHash(*perfect_hash.build(keys))(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_keys_of_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, ROW string")
    assert free_name(df, "row") == "row_"
    assert len({r["row_"] for r in keyed(df, "row_").collect()}) == 3
    assert [r["k"] for r in keyed(spark.range(3).withColumnRenamed("id", "doc_id"), "k").collect()] == [0, 1, 2]


def test_suffix_dedup_of_rows_with_one_id(spark):
    shared = "".join(random.Random(2).choices("abcdefgh ", k=900))
    rows = [(1, "zz"), (1, shared + "!"), (2, "?" + shared), (None, shared[100:700]), (None, "short"), (1, None)]
    got = suffix_dedup.remove_long_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ROW", F.lit(1))).collect()
    expected = [(1, 2, 0, 0, b"zz"), (1, 901, 900, 1, b"!"), (2, 901, 900, 1, b"?"), (None, 600, 600, 1, b""), (None, 5, 0, 0, b"short"), (1, 0, 0, 0, b"")]
    assert sorted(map(str, ((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got))) == sorted(map(str, expected))


def test_decontamination_of_rows_with_one_id(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "one two three x x x x x x x x x"), (1, "x x x four five six seven eight nine ten x"), (None, f"see {item} there"), (None, None), (2, "clean")]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark, 10, decontamination.SLOP).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == [("1", 11, 0), ("1", 12, 0), ("2", 1, 0), ("None", 0, 0), ("None", 12, 10)]
