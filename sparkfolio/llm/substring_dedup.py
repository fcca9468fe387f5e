"""Substring dedup on word windows by a compacted de Bruijn graph.

Windows of ``size`` consecutive words are edges; two windows that overlap in all but one word share a node.  The graph
is built of repeated edges only, and its nonbranching paths are compacted:

1. Every window belongs to the least ``seed``-word k-mer in it, and equal windows have equal least k-mers.  The k-mers of all
   documents are grouped, and a join hands each document those that another document has too.  A window whose k-mer isn't
   among them repeats nowhere.
2. The other windows travel as paths: neighbouring windows that share one k-mer occurrence are one row (k-mer hash, document,
   first word, window hashes).  Per k-mer the rows arrive ordered by document, so the first holder of a window is its
   source coordinate, and a later document's window becomes (document, place, source document, source place).
3. Paths of one document that continue each other in the same source at the same distance don't branch: they are compacted
   to spans.
4. Spans are verified by source coordinates: a join fetches the digest of the source's words, and only where the document's
   own words have the same digest are they removed.

A copy inside one task's piece of text is settled on the spot and only its first holder travels, so a passage
held by a third of all documents costs a row per piece of text, not one per document.  The windows of a k-mer with
many paths are dealt out one by one, each with its places in the document, so its different windows spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import SpanHash, binaries, mix, pieces, sliding_argmin, spaced, window_hash

PIECE = 4 << 20
KMERS = "deal long, kmer long, doc_id long, known boolean"
PATHS = "kmer long, doc_id long, at int, windows binary, kind tinyint, sdoc long, sat int"
FRAGMENTS = "doc_id long, a int, n int, sdoc long, sa int"
#: A path's windows; windows found to repeat within the piece, with their number; the places of one window of a hot k-mer.
PATH, FOUND, PLACES = 0, 1, 2
#: K-mers of about so many paths are dealt out by window, as one of SAMPLE documents tells.  This only decides where windows
#: are compared, never whether they are equal.
HOT, SAMPLE = 16384, 16
#: K-mers are counted by so many cells of their hashes: a bit each is what all tasks get, so its size doesn't grow with the documents.
CELLS = 1 << 24


def _windows(p, size: int, seed: int):
    """Hashes and places of a piece's k-mers and windows: k-mers, least k-mer's place, window, first word, document."""
    start, end, doc = p.words()
    if len(start) < size:
        return None
    words = SpanHash(p.data)(start, end)
    kmers, windows = window_hash(words, seed), window_hash(words, size)
    at = sliding_argmin(kmers, size - seed + 1)
    inside = np.flatnonzero(doc[: len(windows)] == doc[size - 1 :])
    return (kmers, at[inside], windows[inside], inside, doc) if len(inside) else None


def _kmers(size: int, seed: int):
    """Least k-mers of windows, each once a document.  Of those of several documents of a piece the least document's travels
    under the k-mer (``deal``; ``kmer`` is then 0); the others are known to repeat and are dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for p in pieces(batch.column("text"), PIECE):
                if (seen := _windows(p, size, seed)) is None:
                    continue
                kmers, at, _, _, doc = seen
                at = np.unique(at)
                kmer, ident = kmers[at], ids[p.rows][doc[at]].astype(np.int64)
                by = np.lexsort((ident, kmer))
                kmer, ident = kmer[by], ident[by]
                first, new = np.ones(len(by), dtype=bool), np.ones(len(by), dtype=bool)
                first[1:] = kmer[1:] != kmer[:-1]
                new[1:] = first[1:] | (ident[1:] != ident[:-1])
                kmer, ident, first = kmer[new], ident[new], first[new]
                last = np.append(first[1:], True)
                deal = np.where(first, kmer, mix(kmer ^ mix(ident.view(np.uint64) + np.uint64(1))))
                yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(np.where(first, 0, kmer.view(np.int64))), pa.array(ident), pa.array(~(first & last))], ["deal", "kmer", "doc_id", "known"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input ordered by deal and document: k-mers of several documents, a row for each document."""
    held = None  # the last k-mer, its least document, whether that is out
    for batch in batches:
        if not batch.num_rows:
            continue
        deal, kmer, doc, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("deal", "kmer", "doc_id", "known"))
        kmer = np.where(kmer == 0, deal, kmer)
        head = np.ones(len(deal), dtype=bool)
        head[1:] = deal[1:] != deal[:-1]
        goes_on = held is not None and deal[0] == held[0]
        head[0] = not goes_on
        start = np.maximum.accumulate(np.where(head, np.arange(len(deal)), -1))
        more = doc > np.where(start >= 0, doc[start], held[1] if goes_on else 0)
        group = np.cumsum(head)
        several = np.zeros(group[-1] + 1, dtype=bool)
        several[group[more]] = True
        take = more | known | (head & several[group])
        docs, kmers = doc[take], kmer[take]
        if goes_on and several[0] and not held[2]:
            docs, kmers = np.append(docs, held[1]), np.append(kmers, kmer[0])
        first = np.flatnonzero(head)
        held = (deal[-1], doc[first[-1]], bool(several[group[-1]])) if group[-1] else (held[0], held[1], held[2] or bool(several[0]))
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(kmers)], ["doc_id", "kmer"])


def _marked(kmer: np.ndarray, owner: np.ndarray, marks: pa.ListArray) -> np.ndarray:
    """Which k-mers are among the marks of their document."""
    size = np.diff(marks.offsets.to_numpy())
    both = lambda k, d: mix(k ^ mix(d.astype(np.uint64) + np.uint64(7)))
    known = both(marks.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(marks)), size))
    return np.isin(both(kmer, owner), known)


def _paths(size: int, seed: int, shared=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.zeros(CELLS // 64, dtype=np.uint64) if shared is None else shared.value
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("marks")
            for p in pieces(batch.column("text"), PIECE):
                if (seen := _windows(p, size, seed)) is None:
                    continue
                kmers, at, own, inside, doc = seen
                some = np.flatnonzero(_marked(kmers[at], doc[inside], pa.concat_arrays([marks.slice(p.first, p.n)])))
                if not len(some):
                    continue
                at, own, inside = at[some], own[some], inside[some]
                owner = doc[inside]
                ident = ids[p.rows][owner].astype(np.int64)
                place = inside - np.searchsorted(doc, np.arange(p.n))[owner]
                # copies within the piece: the least document's window is the one that travels
                by = np.lexsort((ident, own))
                new = np.ones(len(by), dtype=bool)
                new[1:] = own[by[1:]] != own[by[:-1]]
                source = np.zeros(len(by), dtype=np.int64)
                source[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
                local = ident > ident[source]
                kind = np.where(local, FOUND, np.where(is_hot(kmers[at], hot), PLACES, PATH))
                sdoc, sat = np.where(local, ident[source], 0), np.where(local, place[source], 0)
                cut = np.ones(len(inside), dtype=bool)
                along = (np.diff(inside) == 1) & (kind[1:] == kind[:-1])
                along &= np.where(kind[1:] == FOUND, (sdoc[1:] == sdoc[:-1]) & (np.diff(sat) == 1), np.diff(at) == 0)
                cut[1:] = ~along
                row = np.flatnonzero(cut)
                counts = np.diff(np.append(row, len(inside)))
                counts, row = counts[kind[row] != PLACES], row[kind[row] != PLACES]
                found = kind[row] == FOUND
                flat = own.copy()
                flat[row[found]] = counts[found]
                flat = flat[(kind == PATH) | (cut & (kind == FOUND))]
                # found paths need no company: they are dealt out evenly
                key = np.where(found, mix(mix(ident[row].view(np.uint64)) ^ place[row].astype(np.uint64)), kmers[at[row]])
                yield _rows(key, ident[row], place[row], flat, np.where(found, 1, counts), kind[row], sdoc[row], sat[row])
                one = np.flatnonzero(kind == PLACES)
                if len(one):
                    one = one[np.lexsort((place[one], ident[one], own[one]))]
                    head = np.ones(len(one), dtype=bool)
                    head[1:] = (own[one[1:]] != own[one[:-1]]) | (ident[one[1:]] != ident[one[:-1]])
                    row = one[head]
                    counts = np.diff(np.append(np.flatnonzero(head), len(one)))
                    none = np.zeros(len(row), dtype=np.int64)
                    yield _rows(own[row], ident[row], none, place[one].astype(np.uint64), counts, kind[row], none, none)

    return run


def _rows(key, ident, at, flat, counts, kind, sdoc, sat) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(ident), pa.array(at.astype(np.int32)), binaries(flat.astype("<u8"), counts), pa.array(kind.astype(np.int8)), pa.array(sdoc), pa.array(sat.astype(np.int32))],
        ["kmer", "doc_id", "at", "windows", "kind", "sdoc", "sat"],
    )


def _path_counts(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column("text"), PIECE):
                if (seen := _windows(p, size, seed)) is not None:
                    kmers, at, _, _, _ = seen
                    key, n = np.unique(kmers[np.unique(at)].view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["kmer", "n"])

    return run


def hot_cells(docs: DataFrame, size: int, seed: int) -> np.ndarray:
    """A bit for each of CELLS cells of k-mers: whether its k-mers are least in about HOT or more paths.  2 MB, whatever the documents."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(_path_counts(size, seed), "kmer long, n long")
    cells = counts.groupBy(F.col("kmer").bitwiseAND(CELLS - 1).alias("cell")).agg(F.sum("n").alias("n")).filter(F.col("n") * SAMPLE >= HOT)
    words = cells.groupBy(F.expr("shiftright(cell, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
    out = np.zeros(CELLS // 64, dtype=np.int64)
    for r in words.collect():  # at most CELLS / 64 rows
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def is_hot(kmers: np.ndarray, words: np.ndarray) -> np.ndarray:
    cell = (kmers & np.uint64(CELLS - 1)).astype(np.int64)
    return (words[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input ordered by k-mer and document: runs of windows that an earlier document holds, with where it holds them."""
    held = None  # the last k-mer, its windows, their least documents and their places there
    for batch in batches:
        if not batch.num_rows:
            continue
        kmer, doc, at, kind, sdoc, sat = (batch.column(c).to_numpy() for c in ("kmer", "doc_id", "at", "kind", "sdoc", "sat"))
        column = batch.column("windows")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
        flat = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view("<u8")
        counts = np.diff(offsets) // 8
        row = np.repeat(np.arange(len(kmer)), counts)
        what = kind[row]
        place = np.where(what == PLACES, flat.view(np.int64), at[row] + spaced(counts))
        gone = what == FOUND
        source, from_ = sdoc[row].copy(), sat[row].astype(np.int64)
        live = np.flatnonzero(~gone)
        k, d, x = kmer[row[live]], doc[row[live]], place[live]
        key = np.where(what[live] == PLACES, k.view(np.uint64), flat[live])
        if held is not None and len(k) and held[0] == k[0]:
            key, d, x, k = np.concatenate([held[1], key]), np.concatenate([held[2], d]), np.concatenate([held[3], x]), np.concatenate([np.full(len(held[1]), held[0]), k])
        kept = len(key) - len(live)
        if len(key):
            by = np.lexsort((key, k))  # stable: a window's first place is its least document's
            new = np.ones(len(by), dtype=bool)
            new[1:] = (key[by[1:]] != key[by[:-1]]) | (k[by[1:]] != k[by[:-1]])
            first = np.zeros(len(by), dtype=np.int64)
            first[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            gone[live] = (d > d[first])[kept:]
            source[live], from_[live] = d[first][kept:], x[first][kept:]
            hold = by[new & (k[by] == k[-1])]
            held = (k[-1], key[hold], d[hold], x[hold])
        take = np.flatnonzero(gone)
        if len(take):
            size = np.where(what[take] == FOUND, flat[take].view(np.int64), 1)
            cut = np.ones(len(take), dtype=bool)
            along = (row[take[1:]] == row[take[:-1]]) & (np.diff(place[take]) == 1) & (np.diff(from_[take]) == 1) & (source[take[1:]] == source[take[:-1]])
            cut[1:] = ~along
            head = np.flatnonzero(cut)
            n = np.add.reduceat(size, head)
            t = take[head]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[row[t]]), pa.array(place[t].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(source[t]), pa.array(from_[t].astype(np.int32))], ["doc_id", "a", "n", "sdoc", "sa"]
            )


def compacted(fragments: DataFrame, size: int) -> DataFrame:
    """(doc_id, a, n, sdoc, sa): maximal spans of n words from word a on, equal by hash to those from sa on in sdoc.

    Fragments that continue each other have one document, source and distance; each one's successor is the next of these.
    """
    order = W.partitionBy("doc_id", "sdoc", "far").orderBy("a")
    # the filter is what joins ask for anyway: with it, all uses of the fragments are one exchange
    f = fragments.filter("doc_id is not null and sdoc is not null").withColumn("far", F.col("sa") - F.col("a"))
    f = f.withColumn("upto", F.max(F.col("a") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    f = f.withColumn("path", F.sum((F.col("upto").isNull() | (F.col("a") > F.col("upto"))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = f.groupBy("doc_id", "sdoc", "far", "path").agg(F.min("a").alias("a"), F.max(F.col("a") + F.col("n")).alias("end"))
    return spans.select("doc_id", "a", (F.col("end") - F.col("a") + size - 1).alias("n"), "sdoc", (F.col("a") + F.col("far")).alias("sa"))


def repeated_spans(named: DataFrame, size: int = 13, seed: int = 5) -> DataFrame:
    """compacted() of all documents (doc_id, text; no null ids): words covered by windows that start in a document of smaller
    doc_id too."""
    marks = named.mapInArrow(_kmers(size, seed), KMERS).repartition("deal").sortWithinPartitions("deal", "doc_id").mapInArrow(_marks, "doc_id long, kmer long")
    shared = named.sparkSession.sparkContext.broadcast(hot_cells(named, size, seed))
    marked = named.join(marks.groupBy("doc_id").agg(F.collect_list("kmer").alias("marks")), "doc_id")
    paths = marked.mapInArrow(_paths(size, seed, shared), PATHS).repartition("kmer").sortWithinPartitions("kmer", "doc_id")
    return compacted(paths.mapInArrow(_repeats, FRAGMENTS), size)


def _digest(raw: bytes, start: list[int], end: list[int], a: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join([raw[start[k] : end[k]] for k in range(a, a + n)]), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the asked spans of each document's words."""
    for batch in batches:
        ids, asked = batch.column("doc_id").to_pylist(), batch.column("asked")
        for p in pieces(batch.column("text")):
            start, end, doc = p.words()
            bounds = np.searchsorted(doc, np.arange(p.n + 1)).tolist()
            raw, start, end, out = p.data.tobytes(), start.tolist(), end.tolist(), []
            for i in range(p.n):
                for x in asked[p.first + i].as_py():
                    if bounds[i] + x["sa"] + x["n"] <= bounds[i + 1]:  # else another row of this id was meant
                        out.append((ids[p.first + i], x["sa"], x["n"], _digest(raw, start, end, bounds[i] + x["sa"], x["n"])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["sdoc", "sa", "n", "digest"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        for p in pieces(batch.column("text")):
            start, end, doc = p.words()
            bounds = np.searchsorted(doc, np.arange(p.n + 1)).tolist()
            raw, kept, gone = p.data.tobytes(), [], []
            start, end = start.tolist(), end.tolist()
            for i in range(p.n):
                a, b = bounds[i], bounds[i + 1]
                keep = np.ones(b - a, dtype=bool)
                for x in spans[p.first + i].as_py() or ():
                    if x["a"] + x["n"] <= b - a and _digest(raw, start, end, a + x["a"], x["n"]) == x["digest"]:
                        keep[x["a"] : x["a"] + x["n"]] = False
                kept.append(b" ".join([raw[start[k] : end[k]] for k in (np.flatnonzero(keep) + a).tolist()]))
                gone.append(b - a - int(keep.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[p.rows], pa.array(np.diff(bounds)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )


def remove_repeats(docs: DataFrame, size: int = 13, seed: int = 5) -> DataFrame:
    """Documents without the words covered by a window that starts in a document of smaller doc_id.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Returns doc_id, n_words, n_removed and kept (the words that stay, joined by
    one space).  Null or empty text: no words.  Texts shorter than a window lose nothing.  Repeated rows with one
    doc_id are the same document: neither removes words of the other.  A null doc_id is kept whole.  An empty table gives
    an empty one; other columns are ignored.
    """
    long = docs.schema["doc_id"].dataType.simpleString() == "bigint"
    some = docs.select("doc_id" if long else F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = some.filter("doc_id is not null")  # dealt out by doc_id once, for all three joins
    spans = repeated_spans(named, size, seed)
    asked = spans.select("sdoc", "sa", "n").distinct().groupBy(F.col("sdoc").alias("doc_id")).agg(F.collect_list(F.struct("sa", "n")).alias("asked"))
    proofs = named.join(asked, "doc_id").mapInArrow(_digests, "sdoc long, sa int, n int, digest binary")
    proven = spans.join(proofs, ["sdoc", "sa", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("a", "n", "digest")).alias("spans"))
    kind = "array<struct<a: int, n: int, digest: binary>>"
    both = named.join(proven, "doc_id", "left").unionByName(some.filter("doc_id is null").withColumn("spans", F.lit(None).cast(kind)))
    return both.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
