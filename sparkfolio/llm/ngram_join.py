"""N-gram Jaccard join by MinHash banding.

Texts with equal n-gram sets are one class member from the start.  One representative of each is signed with
bands of row-wise minima, as many as the target recall at the threshold asks for.  A band value that several
representatives share ties each of them to the least one (never all pairs), and the ties' connected components
hold every candidate pair.  Components are verified on full n-gram sets: in one task up to ``BLOCK``
representatives, and beyond that in pairs of blocks, so nothing unbounded meets in a task.  Pairs exist only
inside the block matrices; what leaves a block is one row per representative: its number of links and the
least representative that the block's links connect it with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import cut
from .text import Piece, SpanHash, mix, pieces, tidy, window_hash

BLOCK = 1024
#: Bits of the map that keeps most texts without a candidate out of the shuffle; it's broadcast as 64-bit words.
MAP_BITS = 1 << 22


def choose_bands(threshold: float, recall: float, rows: tuple[int, ...] = (3, 4, 5, 6)) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with which a pair at ``threshold`` shares a band with chance ``recall``,
    among row counts under which a pair at half the threshold shares one with chance 0.6 at most."""
    fits = []
    for r in rows:
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
        fits.append((1 - (1 - (threshold / 2) ** r) ** b > 0.6, b * r, b, r))
    return min(fits)[2:]


def ngrams(p: Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of the distinct n-grams, ordered by document; a text of fewer words, but some, has one."""
    start, end, doc = p.words()
    words = SpanHash(p.data)(start, end)
    grams = window_hash(words, size)
    inside = np.flatnonzero(doc[: len(grams)] == doc[size - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    owner, value = doc[inside], grams[inside]
    count = np.bincount(doc, minlength=p.n)
    if (short := np.flatnonzero((count > 0) & (count < size))).size:
        first = np.searchsorted(doc, short)
        whole = np.array([int(window_hash(words[a : a + c], int(c))[0]) for a, c in zip(first, count[short], strict=True)], dtype=np.uint64)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, mix(whole + count[short].astype(np.uint64))])
    by = np.lexsort((value, owner))
    owner, value = owner[by], value[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


SIGNED = "doc_id long, n long, x long, y long, bands array<long>"


def _sign(size: int, bands: int, rows: int):
    rng = np.random.default_rng(7)
    factor = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column("text")):
                owner, value = ngrams(p, size)
                count = np.bincount(owner, minlength=p.n)
                full = np.flatnonzero(count)
                first = np.searchsorted(owner, full)
                sums = np.zeros((2, p.n), dtype=np.uint64)
                values = np.zeros((len(full), bands), dtype=np.uint64)
                if len(full):
                    sums[0, full] = np.add.reduceat(mix(value + np.uint64(11)), first)
                    sums[1, full] = np.add.reduceat(mix(value ^ np.uint64(0xABCDEF987654321)), first)
                    for b in range(bands):
                        band = np.full(len(full), b, dtype=np.uint64)
                        for t in range(b * rows, b * rows + rows):
                            band = mix(band * np.uint64(31) + np.minimum.reduceat(value * factor[t] + shift[t], first))
                        values[:, b] = band
                ends = np.zeros(p.n + 1, dtype=np.int32)
                np.cumsum((count > 0) * bands, out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[p.rows], pa.array(count), *(pa.array(s.view(np.int64)) for s in sums), pa.ListArray.from_arrays(ends, values.ravel().view(np.int64))],
                    ["doc_id", "n", "x", "y", "bands"],
                )

    return run


VERIFIED = "node long, root long, links long"


def _verify(size: int, threshold: float):
    num, den = round(threshold * 1000), 1000

    def ramp(n: np.ndarray) -> np.ndarray:
        """0 to n - 1 for each n."""
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
        """How many n-grams each set of one has in common with each of two."""
        flat, owner, first, often = [], [], [], []
        for sets in (one, two):
            all_of, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            by = np.argsort(all_of, kind="stable")
            flat.append(all_of[by])
            owner.append(of[by])
        grams = np.intersect1d(*flat)
        for f in flat:
            first.append(np.searchsorted(f, grams))
            often.append(np.searchsorted(f, grams, "right") - first[-1])
        out = np.zeros((len(one), len(two)), dtype=np.int64)
        pairs = often[0] * often[1]
        few, many = np.flatnonzero(pairs <= 576), np.flatnonzero(pairs > 576)
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(pairs[few]) // 1_000_000)) + 1):
            n, m = often[0][part], often[1][part]
            k = np.repeat(np.arange(len(part)), n)
            row = np.repeat(owner[0][np.repeat(first[0][part], n) + ramp(n)], m[k])
            column = owner[1][np.repeat(first[1][part][k], m[k]) + ramp(m[k])]
            out += np.bincount(row * len(two) + column, minlength=out.size).reshape(out.shape)
        for part in np.array_split(many, len(many) * (len(one) + len(two)) // 4_000_000 + 1):
            hot = []
            for own, at, n, sets in zip(owner, first, often, (one, two), strict=True):
                h = np.zeros((len(sets), len(part)), dtype=np.float32)
                h[own[np.repeat(at[part], n[part]) + ramp(n[part])], np.repeat(np.arange(len(part)), n[part])] = 1
                hot.append(h)
            out += (hot[0] @ hot[1].T).astype(np.int64)
        return out

    def linked(block: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        """Which pairs reach the threshold; of two blocks, only pairs across them (the others are another task's)."""
        a, b = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
        b = b if len(b) else a
        n = np.array([len(s) for s in sets])
        inter = shared([sets[i] for i in a], [sets[i] for i in b])
        near = inter * den >= num * (n[a][:, None] + n[b][None, :] - inter)
        out = np.zeros((len(sets), len(sets)), dtype=bool)
        out[np.ix_(a, b)] = near
        out[np.ix_(b, a)] = near.T
        np.fill_diagonal(out, False)
        return out

    def closed(nodes: np.ndarray, copies: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> tuple:
        link = linked(block, sets)
        far = nodes.copy()
        seen = np.zeros(len(nodes), dtype=bool)
        for i in np.argsort(nodes, kind="stable"):
            if seen[i]:
                continue
            front = np.zeros(len(nodes), dtype=bool)
            front[i] = True
            while front.any():
                seen |= front
                far[front] = nodes[i]
                front = link[front].any(axis=0) & ~seen
        return nodes, far, link @ copies

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            if len(held) > 1:
                nodes, copies, block = (np.array([h[k] for h in held]) for k in (0, 1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in closed(nodes, copies, block, [h[3] for h in held])], ["node", "root", "links"])

        for batch in batches:
            meta = list(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "node", "copies", "block")), strict=True))
            for p in pieces(batch.column("text")):
                owner, value = ngrams(p, size)
                bounds = np.searchsorted(owner, np.arange(p.n + 1))
                for k in range(p.n):
                    *own, node, copies, block = meta[p.first + k]
                    if own != key:
                        yield from out()
                        key, held = own, []
                    if held and held[-1][0] == node:  # a repeated row
                        continue
                    held.append((node, copies, block, value[bounds[k] : bounds[k + 1]].copy()))
        yield from out()

    return run


def _maybe(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be in ``ids``: all that are, and of the others those that meet a set bit of a
    map of ``MAP_BITS`` bits.  The map's size is fixed, so it may be broadcast whatever the tables' sizes."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    words = ids.select(spot(key).alias("s")).groupBy((F.col("s") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    at = docs.withColumn("_s", spot("doc_id")).withColumn("word", (F.col("_s") / 64).cast("int"))
    return at.join(F.broadcast(words), "word").filter(F.expr("getbit(bits, cast(_s % 64 as int)) = 1")).drop("_s", "word", "bits")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.999999) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row.

    Two texts are linked if their sets of ``size`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged; a text of
    fewer words has them all as its one n-gram) have a Jaccard similarity of ``threshold`` or more.  class_id is
    the least doc_id in the connected component of these links, n_links counts the other rows linked with a row,
    n_copies those with an equal set, itself included.  Null, empty and wordless texts and rows without a
    doc_id are linked with nothing.  Repeated rows are copies of each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands, rows = choose_bands(threshold, recall)
    signed = cut(docs.mapInArrow(_sign(size, bands, rows), SIGNED), "signed")
    some = signed.filter("n > 0 and doc_id is not null")
    groups = some.groupBy("n", "x", "y").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    groups = cut(groups, "groups")
    keys = groups.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("many")).filter("many > 1").drop("many")
    ties = keys.join(shared, "band").filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    found = connected_components(ties)
    found = cut(found.join(found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "component").join(groups.select("node", "copies"), "node"), "candidates")
    block = found.select("*", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    dealt = (
        _maybe(docs, found, "node").join(block, F.col("doc_id") == F.col("node")).select("component", "node", "copies", "block", "text", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "text")
        .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    )
    verified = cut(dealt.mapInArrow(_verify(size, threshold), VERIFIED), "verified")
    if found.filter("blocks > 1").isEmpty():
        roots = verified.select("node", F.col("root").alias("class_id"))
    else:
        roots = connected_components(verified.select(F.col("node").alias("u"), F.col("root").alias("v"))).select("node", F.col("component").alias("class_id"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = groups.join(roots, "node", "left").join(links, "node", "left").select("n", "x", "y", F.coalesce("class_id", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return some.select("doc_id", "n", "x", "y").join(classes, ["n", "x", "y"]).select("doc_id", "class_id", "n_links", "n_copies").unionByName(alone)
