"""Chat formatting against brute force, and on malformed rows."""

import json
import random

from sparkfolio.llm import chat_format

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, kind string, content string, r string"
RESULTS = "conv_id long, turn long, call_id string, content string, c string, answered long, name string"
MESSAGES = "conv_id long, turn long, role string, text string, kind string, call_id string"
TOOLS = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}, "m": {"type": ["string", "null"]}}, "required": ["n"]}}


def frames(spark, messages=(), calls=(), results=()):
    """With further columns whose names the operator uses inside."""
    return (
        spark.createDataFrame([(*x, "k", "c") for x in messages], MESSAGES),
        spark.createDataFrame([(*x, "k", "c", "r") for x in calls], CALLS),
        spark.createDataFrame([(*x, "c", 1, "n") for x in results], RESULTS),
    )


def test_malformed_rows_have_a_defined_result(spark):
    deep = "[" * 100_000 + "]" * 100_000
    calls = [
        (1, None, "a", "f", '{"n":1e999}', None), (1, 1, "b", "f", '{"n":1,"m":"\\ud800"}', ["a", None]), (1, 1, None, "f", deep, None), (1, 2, "c", "f", '{"n":NaN}', ["c"]),
        (1, 3, "d", "f", '{"n":2.0,"m":null}', None), (1, 4, "e", "f", '{"n":-1}', []), (1, 5, "g", None, None, []), (None, 6, "h", "f", "{}", []), (1, 7, "i", "f", "9" * 5000, []),
    ]
    got = chat_format.format_chats(*frames(spark, [(1, None, None, None), (None, 1, "user", "x")], calls, [(1, 4, None, "z"), (1, None, "b", "y")]), TOOLS).collect()
    assert len(got) == 1
    one = json.loads(got[0].chat)
    errors = {x["id"]: x["errors"] for x in one["calls"]}
    assert errors["d"] == [] and errors["e"] == ["$.n: out of range"] and errors["g"] == ["$: unknown tool None"] and errors[None] == ["$: not JSON", "$: no identifier"]
    assert all(errors[x] == ["$: not JSON"] for x in "abci")
    assert (got[0].n_messages, got[0].n_calls, got[0].n_linked, got[0].n_orphans, got[0].n_invalid, got[0].n_cyclic) == (1, 8, 0, 1, 7, 1)
    assert "Infinity" not in got[0].chat and "NaN}" not in got[0].chat.replace('\\"n\\":NaN}', "")


def test_empty_tables_and_repeated_rows(spark):
    assert chat_format.format_chats(*frames(spark), TOOLS).isEmpty()
    call, result = (1, 1, "a", "f", '{"n":1}', []), (1, 2, "a", "A")
    got = chat_format.format_chats(*frames(spark, [], [call] * 3, [result] * 2), TOOLS).collect()[0]
    assert (got.n_calls, got.n_linked, got.n_orphans, got.n_invalid) == (1, 1, 0, 0)


def test_against_brute_force(spark):
    rng = random.Random(5)
    ids = [f"c{k}" for k in range(7)]
    calls = [(rng.randint(1, 20), rng.randint(0, 9), rng.choice(ids), rng.choice(["f", "g"]), json.dumps({rng.choice("nmx"): rng.choice([1, -1, "s", None, 2.5])}), rng.sample(ids, rng.randint(0, 2))) for _ in range(150)]
    results = [(rng.randint(1, 22), rng.randint(0, 12), rng.choice(ids), f"r{k}") for k in range(120)]
    got = {r.conv_id: json.loads(r.chat) for r in chat_format.format_chats(*frames(spark, [], calls, results), TOOLS).collect()}
    assert set(got) == {x[0] for x in calls} | {x[0] for x in results}
    for conv, chat in got.items():
        first = {}
        for c in sorted((x for x in calls if x[0] == conv), key=lambda c: (c[1], c[3], c[4], c[5])):
            first.setdefault(c[2], c)
        answer = {}
        for r in sorted((x for x in results if x[0] == conv), key=lambda r: (r[1], r[3])):
            answer.setdefault(r[2], r)
        # order: always the earliest call that waits for no other; what never becomes free is cyclic
        left, order = dict(first), []
        while free := [c for c in left if not any(x in left for x in left[c][5])]:
            order.append(min(free, key=lambda c: (first[c][1], c)))
            del left[order[-1]]
        cyclic = sorted(left, key=lambda c: (first[c][1], c))
        assert [x["id"] for x in chat["calls"]] == order + cyclic and [x["id"] for x in chat["calls"] if x["cyclic"]] == cyclic
        for x in chat["calls"]:
            _, turn, _, name, arguments, _ = first[x["id"]]
            value = json.loads(arguments)
            n, m = value.get("n", 0), value.get("m")
            valid = name == "f" and "n" in value and isinstance(n, int) and n >= 0 and (m is None or isinstance(m, str))
            valid &= x["id"] not in answer or answer[x["id"]][1] >= turn
            assert (x["errors"] == []) == valid
            assert x["result"] == (answer[x["id"]][3] if x["id"] in answer else None)
        assert sorted(x["id"] for x in chat["orphans"]) == sorted(set(answer) - set(first))
