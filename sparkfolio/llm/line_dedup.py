"""Drops lines that many documents hold, by counts behind a sharded minimal perfect hash.

Documents are hashed in blocks of bounded size: a block is one row that holds its lines' hashes, 12 bytes a line, in a written
table.  Spark counts documents per distinct hash, with partial sums before any shuffle, and each shard of the hash space becomes one
row: a minimal perfect hash of the shard's line hashes, and behind it a fingerprint and a saturated count for each slot.  Blocks then
send each shard one packed row of what they hold of it; a task reads a shard's arrays first and lets these rows probe them as they
stream by.  What comes back to a block is the hashes to drop.  No line is a row of a join, no array is broadcast, and
a line that all documents share is one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash, build
from .rows import free_name, keyed
from .storage import cut
from .text import SpanHash, pieces, tidy

LEAST_DOCUMENTS = 10
#: Distinct hashes in one shard, about.
SHARD_KEYS = 1 << 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: An odd base of hashes apart from those of text.py.
_SECOND = 0xD1342543DE82EF95
_ENTRY = np.dtype([("h", "<u8"), ("f", "<u4")])


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lines' keys of the documents, in order, and each document's number of lines; an empty key's entry is zero."""
    ends = np.sort(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]), kind="stable")
    # a document's end comes behind its newlines; an end that is also the place of the next document's newline comes first
    is_end = _ends_first(data, offsets, ends)
    starts = np.empty(len(ends), dtype=np.int64)
    starts[:1] = 0
    starts[1:] = ends[:-1] + ~is_end[:-1]
    counts = np.diff(np.concatenate([[-1], np.flatnonzero(is_end)]))
    solid = np.flatnonzero(~_SPACE[data])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = i < j
    out = np.zeros(len(ends), dtype=_ENTRY)
    if full.any():
        a, b = solid[i[full]], solid[j[full] - 1] + 1
        low = _LOWER[data]
        out["h"][full] = SpanHash(low)(a, b)
        out["f"][full] = (SpanHash(low, _SECOND)(a, b) >> np.uint64(32)) | np.uint64(1)
    return out, counts


def _ends_first(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ends`` are documents' ends: of equal places all but the last if a newline stands there, else all."""
    is_end = np.isin(ends, offsets[1:])
    newline = np.zeros(len(ends), dtype=bool)
    inside = ends < len(data)
    newline[inside] = data[ends[inside]] == 10
    last = np.ones(len(ends), dtype=bool)
    last[:-1] = ends[1:] != ends[:-1]
    return is_end & ~(newline & last)


def blocks_of(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each block of documents: block, keys (longs), counts (lines of each), lines (entries of all lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column(1)):
                lines, counts = line_hashes(piece.data, piece.offsets)
                parts = keys[piece.rows].astype("<i8"), counts.astype("<i4"), lines
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["block", "keys", "counts", "lines"])
                number += 1

    return rows.select(key, text).mapInArrow(tidy(run), "block long, keys binary, counts binary, lines binary")


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["counts"], "<i4"), np.frombuffer(row["lines"], _ENTRY)


def document_counts(blocks: DataFrame) -> DataFrame:
    """h, f, n: in how many documents of all blocks each line hash is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, counts, lines = _block(row)
                which = np.repeat(np.arange(len(counts)), counts)
                some = lines["f"] > 0
                lines, which = lines[some], which[some]
                order = np.lexsort((which, lines["f"], lines["h"]))
                lines, which = lines[order], which[order]
                new = np.ones(len(lines), dtype=bool)
                new[1:] = lines[1:] != lines[:-1]
                first = new.copy()
                first[1:] |= which[1:] != which[:-1]
                at = np.flatnonzero(new)
                n = np.add.reduceat(first.astype(np.int64), at) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(lines["h"][at].view("<i8")), pa.array(lines["f"][at].view("<i4")), pa.array(n)], ["h", "f", "n"])

    return blocks.select("keys", "counts", "lines").mapInArrow(run, "h long, f int, n long").groupBy("h", "f").agg(F.sum("n").alias("n"))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash: its place among ``shards`` equal ranges of the upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


INDEX = "shard long, sizes binary, bits binary, fingerprints binary, counts binary, clashes binary"
_CLASH = np.dtype([("h", "<u8"), ("f", "<u4"), ("n", "u1")])


def index_of(counted: DataFrame, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """A row for each shard that has lines: the perfect hash, and by slot the fingerprint's 16 bits and the count up to ``least``.

    Different lines of one 64-bit hash, told apart by 32 more bits, don't enter it: they stand in full in ``clashes``.
    """
    shard = F.expr(f"shiftrightunsigned(shiftrightunsigned(h, 32) * {shards}, 32)")

    def run(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        f, n = table.column("f").to_numpy().view(np.uint32), table.column("n").to_numpy()
        order = np.lexsort((f, h))
        h, f, n = h[order], f[order], n[order].astype(np.uint8)
        same = np.zeros(len(h), dtype=bool)
        same[1:] |= h[1:] == h[:-1]
        same[:-1] |= h[1:] == h[:-1]
        clashes = np.zeros(int(same.sum()), dtype=_CLASH)
        clashes["h"], clashes["f"], clashes["n"] = h[same], f[same], n[same]
        h, f, n = h[~same], f[~same], n[~same]
        sizes, bits = build(h)
        slot = PerfectHash(sizes, bits)(h)
        prints, counts = np.zeros(len(h), dtype="<u2"), np.zeros(len(h), dtype=np.uint8)
        prints[slot], counts[slot] = f >> np.uint32(16), n
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype("<i8"), bits, prints, counts, clashes)]
        return pa.Table.from_arrays([table.column("shard").slice(0, 1), *parts], [x.split()[0] for x in INDEX.split(", ")])

    rows = counted.select(shard.alias("shard"), "h", "f", F.least("n", F.lit(least)).alias("n"))
    return rows.groupBy("shard").applyInArrow(run, INDEX)


class Shard:
    """A shard's arrays, which lines probe."""

    def __init__(self, row: dict):
        self.slots = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["bits"], np.uint8))
        self.prints, self.counts = np.frombuffer(row["fingerprints"], "<u2"), np.frombuffer(row["counts"], np.uint8)
        self.clashes = {(h, f): n for h, f, n in np.frombuffer(row["clashes"], _CLASH).tolist()}

    def __call__(self, lines: np.ndarray) -> np.ndarray:
        """The count of each line; 0 for one that the index doesn't have, as far as fingerprints tell."""
        slot = self.slots(lines["h"])
        held = slot >= 0
        slot = np.maximum(slot, 0)
        out = np.zeros(len(lines), dtype=np.int64)
        if len(self.counts):
            same = self.prints[slot] == (lines["f"] >> np.uint32(16)).astype("<u2")
            out = np.where(held & same, self.counts[slot], 0).astype(np.int64)
        if self.clashes:
            out = np.array([self.clashes.get(x, n) for x, n in zip(lines.tolist(), out.tolist())], dtype=np.int64)
        return out


def probes(blocks: DataFrame, shards: int) -> DataFrame:
    """shard, block, lines: for each block and shard the distinct entries that the block has of it, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = np.frombuffer(row["lines"], _ENTRY)
                lines = np.unique(lines[lines["f"] > 0])
                shard = shard_of(lines["h"], shards)
                cuts = np.flatnonzero(np.diff(shard)) + 1
                each = np.split(lines, cuts) if len(lines) else []
                first = shard[np.concatenate([[0], cuts])] if len(lines) else shard
                packed = pa.array([x.tobytes() for x in each], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array([row["block"]] * len(each), pa.int64()), packed], ["shard", "block", "lines"])

    return blocks.select("block", "lines").mapInArrow(run, "shard long, block long, lines binary")


def common_lines(blocks: DataFrame, index: DataFrame, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """block, lines: the entries of the block's lines whose count reaches ``least``; each shard's arrays come before its probes."""
    arrays = [x.split()[0] for x in INDEX.split(", ")][1:]
    empty = {n: F.lit(None).cast("binary").alias(n) for n in ("lines", *arrays)}
    held = index.select("shard", F.lit(-1).cast("long").alias("block"), empty["lines"], *arrays)
    asked = probes(blocks, shards).select("shard", "block", "lines", *(empty[n] for n in arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["block"] < 0:
                    shard = Shard(row)
                    continue
                lines = np.frombuffer(row["lines"], _ENTRY)
                if len(lines := lines[shard(lines) >= least]):
                    out.append((row["block"], lines.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["block", "lines"])

    rows = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "block")
    return rows.mapInArrow(tidy(run), "block long, lines binary")


def drops(blocks: DataFrame, common: DataFrame) -> DataFrame:
    """key, drop: which lines of a document go, as packed bits, for documents that lose any; a block comes before its common lines."""
    empty = [F.lit(None).cast("binary").alias(n) for n in ("keys", "counts")]
    rows = blocks.select("block", F.lit(0).alias("part"), "keys", "counts", "lines")
    rows = rows.unionByName(common.select("block", F.lit(1).alias("part"), *empty, "lines"))

    def decided(now: dict, found: list[bytes]) -> pa.RecordBatch:
        keys, counts, lines = _block(now)
        common = np.frombuffer(b"".join(found), _ENTRY)
        gone, known = np.isin(lines["h"], common["h"]), set(common.tolist())
        at = np.flatnonzero(gone)
        gone[at] = [x in known for x in lines[at].tolist()]  # different lines may share the first 64 bits
        ends = np.cumsum(counts)
        some = np.add.reduceat(gone, ends - counts) > 0 if len(counts) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(some)
        packed = [np.packbits(gone[ends[i] - counts[i] : ends[i]], bitorder="little").tobytes() for i in at]
        return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(packed, pa.binary())], ["key", "drop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"]:
                    found.append(row["lines"])
                    continue
                if found:
                    yield decided(now, found)
                now, found = row, []
        if found:
            yield decided(now, found)

    return rows.repartition("block").sortWithinPartitions("block", "part").mapInArrow(tidy(run), "key long, drop binary")


def kept_lines(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of rows with doc_id, text and drop: doc_id, n_lines, n_dropped and the lines that stay."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for text, drop in zip(batch.column(1), batch.column(2)):
                text, drop = text.as_py() or "", drop.as_py()
                sizes.append(text.count("\n") + 1)
                gone.append(0)
                if drop is not None:
                    flags = np.unpackbits(np.frombuffer(drop, np.uint8), count=sizes[-1], bitorder="little").tolist()
                    text = "\n".join(line for line, flag in zip(text.split("\n"), flags) if not flag)
                    gone[-1] = sum(flags)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names)

    return rows.select("doc_id", "text", "drop").mapInArrow(tidy(run), ", ".join(f"{n} {t}" for n, t in zip(names, (kind, "long", "long", "string"))))


def drop_common_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_lines, n_dropped, kept (its other lines, joined by newlines).

    A null or empty text is one empty line.  A line without a character besides white space is never dropped.  Each row counts as a
    document of its own, whatever its doc_id: null and repeated ids get a key that is written with the rows.  An empty table gives an
    empty result; further columns, whatever their names, don't travel.  Lines are told apart by 96 bits of hash.
    """
    docs = docs.select("doc_id", "text")
    key = free_name(docs, "row")
    rows = keyed(docs, key, "line_rows")
    blocks = cut(blocks_of(rows, key), "line_blocks")
    lines = blocks.agg(F.sum(F.length("lines")).alias("n")).first()["n"] or 0
    shards = max(1, -(-lines // _ENTRY.itemsize // shard_keys))
    common = common_lines(blocks, index_of(document_counts(blocks), shards, least), shards, least)
    found = drops(blocks, common).withColumnRenamed("key", key)
    return kept_lines(rows.join(found, key, "left"), ["doc_id", "n_lines", "n_dropped", "kept"])
