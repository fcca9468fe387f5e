"""Chat formatting with linked tool calls.

Calls and results are rows; Spark joins them by (conversation, call identifier), deals whole conversations out by
conversation, and each one is written as canonical JSON: its calls in topological order of what they wait for, their
arguments validated against the tools' schemas, orphans and cycles reported.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of the tool that a plain conversation's turns stand for: the user asks, the assistant's turn is the result.
TOOLS = {"reply": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}}, "required": ["text"], "additionalProperties": False}}

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Arguments nested deeper are invalid: they are kept as text and not parsed.
DEPTH = 64


def is_number(value) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def fits(value, kind) -> bool:
    """Whether a JSON value is of a schema's type, or of one of them; an unknown type fits nothing."""
    if isinstance(kind, list):
        return any(fits(value, k) for k in kind)
    if kind == "number":
        return is_number(value)
    if kind == "integer":
        return is_number(value) and (isinstance(value, int) or value.is_integer())
    return isinstance(kind, str) and kind in _TYPES and isinstance(value, _TYPES[kind])


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a JSON value by type (one or a list), enum, required, properties, additionalProperties, items,
    minLength, minimum and maximum of a schema."""
    out: list[str] = []
    kind = schema.get("type")
    if kind is not None and not fits(value, kind):
        return [f"{at}: not {' or '.join(map(str, kind)) if isinstance(kind, list) else kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if is_number(value) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: out of range")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    return out


def _not_json(token: str):
    raise ValueError(f"{token} is no JSON number")


def _finite(token: str) -> float:
    if not math.isfinite(x := float(token)):
        _not_json(token)
    return x


def nesting(text: str) -> int:
    """How deep brackets outside strings are nested, at most."""
    depth = most = 0
    for m in _BRACKETS.finditer(text):
        if (c := m[0]) in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)
_SURROGATE = re.compile("[\ud800-\udfff]")


def parsed(text: str):
    """The value of a JSON text.  A ValueError if it is none: NaN, infinities and numbers beyond doubles, lone
    surrogates, integers of over 4,300 digits and nesting over DEPTH count as none."""
    if nesting(text) > DEPTH:
        raise ValueError("nested too deep")
    value = json.loads(text, parse_constant=_not_json, parse_float=_finite)
    if _SURROGATE.search(json.dumps(value, ensure_ascii=False)):
        raise ValueError("a lone surrogate")
    return value


def topological(calls: dict[str, tuple[int, list[str]]]) -> tuple[list[str], list[str]]:
    """Call ids by what they wait for, earlier turns first; and those in or behind a cycle.  calls: id -> (turn, ids
    waited for); unknown ids are not waited for."""
    waits = {c: {x for x in after if x in calls} for c, (_, after) in calls.items()}
    behind: dict[str, list[str]] = {}
    for c, after in waits.items():
        for x in after:
            behind.setdefault(x, []).append(c)
    left = {c: len(x) for c, x in waits.items()}
    ready = [(calls[c][0], c) for c, n in left.items() if not n]
    heapq.heapify(ready)
    order = []
    while ready:
        _, c = heapq.heappop(ready)
        order.append(c)
        for d in behind.get(c, ()):
            left[d] -= 1
            if not left[d]:
                heapq.heappush(ready, (calls[d][0], d))
    done = set(order)
    return order, sorted((c for c in calls if c not in done), key=lambda c: (calls[c][0], c))


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes beyond those that JSON demands."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def calls_of_turns(turns: DataFrame, tool: str = "reply") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results of a table of plain turns (conv_id, turn, role, text).

    A user's turn calls ``tool`` with its text under the identifier ``turn``; the next turn, if the assistant's,
    is its result, and each call waits for the call before it.  Other turns are messages.  Rows without a conv_id or a turn
    have no place in a conversation and are left out, equal rows count once, a null role is the empty role, and a
    null text is a call without arguments' text, a null result or a null message.
    """
    clean = turns.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text").dropDuplicates(["conv_id", "turn", "role", "text"])
    calls = clean.filter("role = 'user'").select("conv_id", "turn", F.col("turn").cast("string").alias("call_id"), F.lit(tool).alias("name"), F.to_json(F.struct("text")).alias("arguments"), F.array((F.col("turn") - 2).cast("string")).alias("after"))
    results = clean.filter("role = 'assistant'").select("conv_id", "turn", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    return clean.filter("role not in ('user', 'assistant')").select("conv_id", "turn", "role", "text"), calls, results


LINKED = "conv_id long, kind string, turn long, call_id string, name string, arguments string, after array<string>, content string, answered long"


def link(messages: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """Messages, calls with the result of the same identifier (the first by turn), and results without a call.

    Only the columns named are read.  Null identifiers are equal to nothing: such a call has no result, such a result
    is an orphan, and each stays a row of its own.
    """
    results = results.select("conv_id", "turn", "call_id", "content")
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    unnamed = calls.filter("call_id is null").select("conv_id", F.lit("call").alias("kind"), "turn", "call_id", "name", "arguments", "after", F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("answered"))
    lost = results.filter("call_id is null").select("conv_id", F.lit("orphan").alias("kind"), "turn", "call_id", *(F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("arguments", "string"), ("after", "array<string>"))), "content", F.col("turn").alias("answered"))
    results, calls = results.filter("call_id is not null"), calls.filter("call_id is not null")
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    called = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    both = called.join(first, ["conv_id", "call_id"], "full_outer").select(
        "conv_id", F.when(F.col("c").isNotNull(), "call").otherwise("orphan").alias("kind"), F.coalesce("c.turn", "r.turn").alias("turn"), "call_id",
        "c.name", "c.arguments", "c.after", "r.content", F.col("r.turn").alias("answered"),
    )
    empty = F.lit(None).cast("string")
    said = messages.select("conv_id", F.lit("message").alias("kind"), "turn", empty.alias("call_id"), F.col("role").alias("name"), F.col("text").alias("arguments"), F.lit(None).cast("array<string>").alias("after"), empty.alias("content"), F.lit(None).cast("long").alias("answered"))
    return both.unionByName(said).unionByName(unnamed).unionByName(lost)


FORMATTED = "conv_id long, n_messages long, n_calls long, n_linked long, n_orphans long, n_invalid long, n_cyclic long, chat string"


def conversation(rows: list[tuple], tools: dict) -> tuple:
    """The counts and the canonical JSON of one conversation's linked rows.

    Rows stand by turn, null turns first.  A call without an identifier is listed after the others, by turn, with
    the error ``no identifier``.
    """
    early = -(1 << 63)
    turn_of = lambda t: early if t is None else t
    rows = sorted(rows, key=lambda r: (turn_of(r[1]), r[0], r[2] or "", r[3] or "", r[4] or "", r[6] or ""))
    by = {r[2]: r for r in rows if r[0] == "call" and r[2] is not None}
    order, cyclic = topological({c: (turn_of(r[1]), [x for x in r[5] or () if x is not None]) for c, r in by.items()})
    out, invalid, behind = [], 0, set(cyclic)
    for rank, r in enumerate([by[c] for c in order + cyclic] + [r for r in rows if r[0] == "call" and r[2] is None]):
        _, turn, c, name, arguments, _, content, answered = r
        try:
            value = parsed(arguments) if arguments is not None else None
            wrong = schema_errors(value, tools[name]) if name in tools else [f"$: unknown tool {name}"]
        except (ValueError, RecursionError):
            value, wrong = arguments, ["$: not JSON"]
        if c is None:
            wrong = [*wrong, "$: no identifier"]
        if answered is not None and turn is not None and answered < turn:
            wrong = [*wrong, "$: answered before it was called"]
        invalid += bool(wrong)
        out.append({"id": c, "rank": rank, "turn": turn, "name": name, "arguments": value, "errors": wrong, "result": content, "answered": answered, "cyclic": c in behind})
    messages = [{"turn": r[1], "role": r[3], "content": r[4]} for r in rows if r[0] == "message"]
    orphans = [{"id": r[2], "turn": r[1], "content": r[6]} for r in rows if r[0] == "orphan"]
    text = canonical({"messages": messages, "calls": out, "orphans": orphans})
    return len(messages), len(out), sum(x["answered"] is not None for x in out), len(orphans), invalid, len(cyclic), text


def _format(tools: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in FORMATTED.split(", ")])
        names = [c.split()[0] for c in LINKED.split(", ")]
        last, held, out = None, [], []
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held and conv != last:
                    out.append((last, *conversation(held, tools)))
                    held = []
                last = conv
                held.append(tuple(row))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        if held:
            out.append((last, *conversation(held, tools)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row per conversation: counts and ``chat``, canonical JSON of its messages, linked calls and orphan results.

    Calls with one identifier in a conversation count once, the earliest; so do results.  A call without a result
    has null, a result without a call is an orphan, arguments that are null or no JSON are invalid (parsed() says what
    counts as none), calls in or behind a cycle come last and are marked.  A null turn comes before all others.  Calls and
    results without an identifier are linked with nothing, but counted and written, such calls as invalid.  Further
    columns are ignored.  Rows without a conv_id are left out.  Empty tables give no rows.  A
    conversation is one chat and is written by one task; only its own rows are held.
    """
    linked = link(messages, calls, results).select(F.col("conv_id").cast("long").alias("conv_id"), "kind", "turn", "call_id", "name", "arguments", "after", "content", "answered").filter("conv_id is not null")
    return linked.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(_format(tools or TOOLS), FORMATTED)
