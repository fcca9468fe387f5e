"""Removal of long repeated byte strings over sparse suffixes, ordered by deep-shallow sorting.

Every string of ``size`` bytes contains a seed of half that length that its content alone selects (the least
seed hash in the string), so equal strings share an equal seed at an equal place.  Only suffixes that start
after a selected seed are compared, about one in a hundred bytes:

1. Each selected seed travels as (seed hash, hash of its whole neighbourhood, document, place).  Equal
   neighbourhoods settle each other; a row needs only its neighbours in sorted order, so memory is constant.
2. Where one seed has different neighbourhoods (the edges of copies), one row of each fetches its bytes before
   and after the seed.  Per seed they are ordered by multikey quicksort to a shallow depth and, where longer
   prefixes are common, by a blind trie; common extensions to the left and right that reach ``size`` together
   with the seed mark what is repeated.
3. Seeds with more than ``GROUP`` neighbourhoods are settled by the hashes of their windows, in time and memory that
   are linear in the group; with more than ``LARGE`` by Spark aggregation on these hashes, so no group grows in one
   task without a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import free_name, keyed
from .storage import cut
from .text import _BASE, _BYTE, SpanHash, mix, pieces, powers, sliding_argmin, tidy

SHALLOW, GROUP, LARGE = 16, 1024, 100_000
SEEDS = "seed long, near long, doc_id long, at int, a int, b int, dup boolean"


def _seeds(size: int):
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for p in pieces(batch.column("text")):
                if len(p.data) < size:
                    continue
                spans = SpanHash(p.data)
                starts = np.arange(len(p.data) - half + 1)
                seeds = spans(starts, starts + half)
                at = sliding_argmin(seeds, size - half + 1)
                owner = np.searchsorted(p.offsets, np.arange(len(at)), side="right") - 1
                fits = np.arange(len(at)) + size <= p.offsets[owner + 1]
                place = np.unique(at[fits])
                if not len(place):
                    continue
                owner = np.searchsorted(p.offsets, place, side="right") - 1
                a = np.maximum(p.offsets[owner], place - half)
                b = np.minimum(p.offsets[owner + 1], place + size)
                near = mix(spans(a, place) * np.uint64(3) + mix(spans(place, b)))
                seed = seeds[place]
                ident = ids[p.rows][owner]
                key, first, back, many = np.unique(near, return_index=True, return_inverse=True, return_counts=True)
                # an equal neighbourhood in the same piece: one row travels for all, the others are settled
                travels = np.zeros(len(near), dtype=bool)
                travels[first] = True
                dup = many[back] > 1
                base = p.offsets[owner]
                alone = mix(near + mix(np.arange(len(near), dtype=np.uint64) ^ ident.astype(np.uint64)))
                cols = [np.where(travels, seed, alone).view(np.int64), near.view(np.int64), ident, (place - base).astype(np.int32), (a - base).astype(np.int32), (b - base).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(dup)], SEEDS.replace(",", "").split()[::2])

    return run


def _settle(size: int):
    """Input ordered by seed and neighbourhood.  Kind 0: a range of the document that is repeated; kind 1: a
    neighbourhood to compare with the others of its seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first row of the last seed, settled before, and its last row, not yet settled.
        held, settled, shown = None, 0, False
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows or batch is None and held is None:
                continue
            if batch is None:
                c = held
            else:
                c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("seed", "near", "doc_id", "at", "a", "b", "dup")}
                c = {x: np.concatenate([held[x], c[x]]) for x in c} if held is not None else c
            n = len(c["seed"])
            upto = n if batch is None else n - 1
            alike, same = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
            alike[1:n] = c["seed"][1:] == c["seed"][:-1]
            same[1:n] = alike[1:n] & (c["near"][1:] == c["near"][:-1])
            repeated = (same[:n] | same[1:] | c["dup"]) & (c["b"] - c["a"] >= size)
            group = np.cumsum(~alike[:n]) - 1
            heads = ~same[:n]
            several = np.zeros(group[-1] + 1, dtype=bool)
            several[group[heads & alike[:n]]] = True
            now = np.zeros(n, dtype=bool)
            now[settled:upto] = True
            compare = heads & several[group] & now
            if settled and not shown:
                compare[0] = several[0]
            for kind, take in ((0, np.flatnonzero(repeated & now)), (1, np.flatnonzero(compare))):
                if len(take):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(take), kind, dtype=np.int32)), *(pa.array(c[x][take]) for x in ("doc_id", "a", "at", "b", "seed")), pa.array(repeated[take])],
                        ["kind", "doc_id", "a", "at", "b", "seed", "done"],
                    )
            if batch is None:
                return
            g = int(np.searchsorted(group, group[-1]))
            rows = [g] if g == n - 1 else [g, n - 1]
            shown = bool(len(rows) == 2 and (compare[g] or g == 0 and settled and shown))
            c["dup"] = c["dup"].copy()
            c["dup"][n - 1] |= same[n - 1]
            held, settled = {x: c[x][rows] for x in c}, len(rows) - 1

    return run


SETTLED = "kind int, doc_id long, a int, at int, b int, seed long, done boolean"
BYTES = "seed long, doc_id long, at int, done boolean, left binary, right binary"


def _neighbourhoods(size: int):
    """The bytes around each place of a document that is to be compared."""
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places").to_pylist(), strict=True):
                raw = text.as_py().encode()
                for x in places:
                    at = x["at"]
                    out.append((x["seed"], doc, at, x["done"], raw[x["a"] : at], raw[at + half : x["b"]]))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _BYTES, strict=True)], BYTES.replace(",", "").split()[::2])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _BYTES, strict=True)], BYTES.replace(",", "").split()[::2])

    return run


_BYTES = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            n = mid
    return low


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and the common prefix of each with the one before it in that order.

    Multikey quicksort on the first SHALLOW bytes; strings that agree in all of these go to a blind trie.
    """
    order: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        some, depth = todo.pop()
        if len(some) == 1:
            order.append(some[0])
        elif depth == SHALLOW:
            order += _blind_trie(strings, some, depth)
        elif some:
            pivot = _at(strings[some[len(some) // 2]], depth)
            less = [i for i in some if _at(strings[i], depth) < pivot]
            more = [i for i in some if _at(strings[i], depth) > pivot]
            even = [i for i in some if _at(strings[i], depth) == pivot]
            todo.append((more, depth))
            todo.append((even, depth + 1 if pivot >= 0 else SHALLOW))
            todo.append((less, depth))
    return order, [0, *(common(strings[i], strings[j]) for i, j in zip(order, order[1:], strict=False))]


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def _blind_trie(strings: list[bytes], some: list[int], depth: int) -> list[int]:
    """Order of strings that agree up to ``depth``: inner nodes hold only a depth and a branch for each next byte;
    an insertion goes down blindly to some leaf, compares once with its string, and branches where they differ."""
    root: list = [some[:1]]  # a leaf: list of equal strings; an inner node: (depth, {byte: [node]})
    for i in some[1:]:
        s, node = strings[i], root[0]
        while isinstance(node, tuple):
            node = next(iter(node[1].values()))[0] if _at(s, node[0]) not in node[1] else node[1][_at(s, node[0])][0]
        t = strings[node[0]]
        same = common(s, t)
        if same == len(s) == len(t):
            node.append(i)
            continue
        link = root
        while isinstance(link[0], tuple) and link[0][0] < same:
            link = link[0][1][_at(s, link[0][0])]
        if isinstance(link[0], tuple) and link[0][0] == same:
            link[0][1][_at(s, same)] = [[i]]
        else:
            link[0] = (same, {_at(t, same): [link[0]], _at(s, same): [[i]]})
    out, stack = [], [root]
    while stack:
        node = stack.pop()[0]
        if isinstance(node, tuple):
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def _extents(group: list[tuple], need: int) -> list[tuple[int, int] | None]:
    """For each (.., left, right) the longest common extensions with others that together reach ``need``."""
    m = len(group)
    left, right = [x[-2][::-1] for x in group], [x[-1] for x in group]
    if m == 2:
        both = common(*left), common(*right)
        return [both if sum(both) >= need else None] * 2
    reach = []
    for strings in (left, right):
        order, lcp = deep_shallow(strings)
        reach.append((np.array(order), np.array(lcp), np.argsort(order)))
    out: list[tuple[int, int] | None] = []
    for i in range(m):
        if group[i][2]:
            out.append(None)
            continue
        both = []
        for order, lcp, rank in reach:
            r, ext = rank[i], np.zeros(m, dtype=np.int64)
            ext[order[r + 1 :]] = np.minimum.accumulate(lcp[r + 1 :])
            if r:
                ext[order[:r]] = np.minimum.accumulate(lcp[r:0:-1])[::-1]
            both.append(ext)
        good = both[0] + both[1] >= need
        good[i] = False
        out.append((int(both[0][good].max()), int(both[1][good].max())) if good.any() else None)
    return out


def _window_extents(group: list[tuple], need: int) -> list[tuple[int, int] | None]:
    """As _extents, by the hashes of all windows: offset by offset, the prefix sums of both sides move one byte on."""
    m = len(group)
    sides, sizes = [], []
    for strings in ([x[-2][::-1] for x in group], [x[-1] for x in group]):
        sizes.append(np.minimum([len(s) for s in strings], need))
        sides.append(np.frombuffer(b"".join(s[:need].ljust(need, b"\0") for s in strings), dtype=np.uint8).reshape(m, need))
    weight = powers(_BASE, need)
    left, right = np.zeros(m, dtype=np.uint64), np.zeros(m, dtype=np.uint64)
    for k in range(need):
        right += _BYTE[sides[1][:, k]] * weight[k]
    low, high = np.full(m, need + 1), np.full(m, -1)
    for j in range(need + 1):
        fits = np.flatnonzero((sizes[0] >= j) & (sizes[1] >= need - j))
        _, back, many = np.unique(mix(left[fits] * np.uint64(3) + mix(right[fits])), return_inverse=True, return_counts=True)
        again = fits[many[back] > 1]
        low[again], high[again] = np.minimum(low[again], j), j
        if j < need:
            left += _BYTE[sides[0][:, j]] * weight[j]
            right -= _BYTE[sides[1][:, need - j - 1]] * weight[need - j - 1]
    return [(int(h), need - int(x)) if h >= 0 else None for x, h in zip(low, high, strict=True)]


def _compare(size: int):
    """Input ordered by seed.  Kind 0: a repeated range; kind 1: a window by its hash, of a seed with very many neighbourhoods."""
    half = size // 2

    def hashed(group: list[tuple]) -> Iterator[tuple]:
        for doc, at, _, left, right, seed in group:
            s, t = SpanHash(np.frombuffer(left, dtype=np.uint8)), SpanHash(np.frombuffer(right, dtype=np.uint8))
            j = np.arange(max(0, size - half - len(right)), min(len(left), size - half) + 1)
            h = mix(s(len(left) - j, np.full(len(j), len(left))) + mix(t(np.zeros(len(j), dtype=np.int64), size - half - j) ^ np.uint64(seed & (2**64 - 1))))
            for start, x in zip((at - j).tolist(), h.view(np.int64).tolist(), strict=True):
                yield 1, doc, start, start + size, x

    def closed(group: list[tuple]) -> Iterator[tuple]:
        extents = _extents if len(group) <= GROUP else _window_extents
        for (doc, at, done, *_), both in zip(group, extents([x[:5] for x in group], size - half), strict=True):
            if both and not done:
                yield 0, doc, at - both[0], at + half + both[1], 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, group, large = None, [], False
        for batch in batches:
            for seed, *x in zip(*(batch.column(c).to_pylist() for c in BYTES.replace(",", "").split()[::2]), strict=True):
                if seed != last:
                    if not large and len(group) > 1:
                        yield from closed(group)
                    last, group, large = seed, [], False
                group.append((*x, seed))
                if large or len(group) > LARGE:
                    yield from hashed(group)
                    group, large = [], True
        if not large and len(group) > 1:
            yield from closed(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for x in rows(batches):
            out.append(x)
            if len(out) == 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RANGES, strict=True)], ["kind", "doc_id", "a", "b", "window"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RANGES, strict=True)], ["kind", "doc_id", "a", "b", "window"])

    return run


RANGES = "kind int, doc_id long, a int, b int, window long"
_RANGES = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())


def repeated_ranges(docs: DataFrame, size: int = 400) -> DataFrame:
    """(doc_id, a, b): byte ranges covered by strings of ``size`` bytes that also start elsewhere."""
    spark = docs.sparkSession
    docs = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seeds = docs.mapInArrow(tidy(_seeds(size)), SEEDS).repartition("seed").sortWithinPartitions("seed", "near", "doc_id", "at")
    settled = cut(seeds.mapInArrow(tidy(_settle(size)), SETTLED), "suffix-settled")
    places = settled.filter("kind = 1").groupBy("doc_id").agg(F.collect_list(F.struct("seed", "a", "at", "b", "done")).alias("places"))
    around = docs.join(places, "doc_id").mapInArrow(tidy(_neighbourhoods(size)), BYTES)
    compared = cut(around.repartition("seed").sortWithinPartitions("seed").mapInArrow(tidy(_compare(size)), RANGES), "suffix-compared")
    windows = compared.filter("kind = 1")
    often = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    return (
        settled.filter("kind = 0").select("doc_id", "a", "b")
        .unionByName(compared.filter("kind = 0").select("doc_id", "a", "b"))
        .unionByName(windows.join(often, "window", "left_semi").select("doc_id", "a", "b"))
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = batch.column("ranges").to_pylist()
        for p in pieces(batch.column("text")):
            raw, kept, gone, runs = p.data.tobytes(), [], [], []
            for i in range(p.n):
                at, end, parts, n = int(p.offsets[i]), int(p.offsets[i + 1]), [], 0
                base = last = at
                for x in sorted(ranges[p.first + i] or ()):
                    a, b = min(end, base + (x >> 32)), min(end, base + (x & 0xFFFFFFFF))
                    if a > last or not n:
                        parts.append(raw[last:a])
                        n += 1
                    last = max(last, b)
                parts.append(raw[last:end])
                kept.append(b"".join(parts))
                gone.append(end - at - len(kept[-1]))
                runs.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[p.rows], pa.array(np.diff(p.offsets)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_long_repeats(docs: DataFrame, size: int = 400) -> DataFrame:
    """Rows without the bytes covered by a string of ``size`` bytes that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary), a row for each row.  Null and empty texts have
    no bytes and shorter texts lose nothing.  Every row is a document of its own, whatever its doc_id: repeated rows are copies of
    each other, so both lose what they share; null and repeated ids get a key that is written with the rows.  Neighbourhoods of seeds
    are the same if their 64-bit hashes are; different ones are compared by bytes, very many of one seed by window hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = free_name(docs, "row")
    rows = keyed(docs, key, "suffix_rows")
    ranges = repeated_ranges(rows.select(F.col(key).alias("doc_id"), "text"), size).withColumnRenamed("doc_id", key)
    ranges = ranges.groupBy(key).agg(F.collect_list(F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("ranges"))
    joined = rows.join(ranges, key, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(tidy(_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
