"""Product quantisation: integer vectors become one code a part, with codebooks learned over all rows.

Vectors travel once as NumPy blocks, one array a component (columnar), in a written table.  Each round is an RDD treeAggregate
over these blocks: distances to a part's codebook add up dimension by dimension, np.add.at gathers int64 sums and counts of
each entry, and these tensors, whose size is that of the codebooks whatever the number of rows, merge through a reduction tree.
The driver sees nothing but the seeds and such tensors; codes are made in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x).
SCALE = 256
#: Vectors in one block.
BLOCK = 2048
#: Label sums are broadcast up to so many labels (about 3 MB), and joined by shuffle beyond.
BROADCAST_LABELS = 1 << 17


def vectors(df: DataFrame, vector: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int, float]:
    """Rows whose vector has finite components only, that vector as ``v`` (doubles); its length and largest magnitude.

    A vector belongs to the table's dimension: the commonest length that ``parts`` divides (the least of equally common ones).
    Others can't be cut into equal parts and go, as do null and empty vectors.
    """
    v = df.withColumn("v", F.col(vector).cast("array<double>"))
    v = v.filter(F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    largest = F.max(F.array_max(F.transform("v", F.abs))).alias("largest")
    sizes = v.filter(F.size("v") % parts == 0).groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), largest)
    most = sizes.orderBy(F.desc("n"), "size").first()
    return (v.filter(F.lit(False)), 0, 0.0) if most is None else (v.filter(F.size("v") == most["size"]), most["size"], most["largest"])


def exact(data: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of doubles as int64, or, where that or squared distances could exceed it, as Python integers."""
    if not wide:
        return np.floor(data * SCALE).astype(np.int64)
    return np.array([int(x) * SCALE if abs(x) > 2**53 else int(np.floor(x * SCALE)) for x in data.ravel()], dtype=object).reshape(data.shape)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each vector of ``columns`` (dimension, vector); ties to the lower."""
    distance = np.zeros((columns.shape[1], len(book)), dtype=book.dtype)
    for d, x in enumerate(columns):
        apart = x[:, None] - book[None, :, d]
        distance += apart * apart
    index = np.argmin(distance, axis=1)
    return index, distance[np.arange(len(index)), index]


def compress(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors and the final codebooks (part, entry, component), None without any vector.

    The codes are a table (id, label, code, error), one row for each kept row: code has two hex digits a part, error is the
    squared distance summed over parts.  Codebooks start as the parts of the first ``entries`` rows by id (rows without one last, equal
    ids by their vectors); with fewer rows they have as many entries.  Repeated rows count each for itself.  Further columns,
    whatever their names, don't travel.  An error that exceeds a long is null.  An empty table gives an empty result.
    """
    rows, size, largest = vectors(df.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector", parts)
    rows = rows.select("id", "label", "v")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    made = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if not first:
        return df.sparkSession.createDataFrame([], made), None
    wide = size * (2 * (SCALE * largest + 1)) ** 2 >= 2**62
    books = exact(np.array([x["v"] for x in first]), wide).reshape(len(first), parts, size // parts).transpose(1, 0, 2)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for i in range(0, len(data), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(data[i : i + BLOCK].T).tobytes()], pa.binary())], ["block"])

    blocks = cut(rows.select("v").mapInArrow(packed, "block binary"), "vector_blocks").rdd.map(
        lambda r: exact(np.frombuffer(r["block"], dtype=np.float64).reshape(size, -1), wide)
    )

    def gather(state, columns):
        sums, counts = state
        for p, book in enumerate(now):
            own = columns[p * book.shape[1] : (p + 1) * book.shape[1]]
            index, _ = nearest(own, book)
            np.add.at(sums[p], index, own.T)
            np.add.at(counts[p], index, 1)
        return sums, counts

    for _ in range(rounds):
        now = books
        zero = np.zeros(books.shape, dtype=books.dtype), np.zeros(books.shape[:2], dtype=np.int64)
        sums, counts = blocks.treeAggregate(zero, gather, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                piece = batch.slice(i, BLOCK)
                columns = exact(piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).T, wide)
                found = [nearest(columns[p * b.shape[1] : (p + 1) * b.shape[1]], b) for p, b in enumerate(books)]
                codes = np.stack([x for x, _ in found], axis=1).astype(np.uint8)
                errors = [int(x) if x < 2**63 else None for x in sum(d for _, d in found)]
                codes = pa.array([x.tobytes().hex() for x in codes], pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), codes, pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return rows.mapInArrow(coded, made), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors of equal labels (nulls together) summed; null where a long can't hold it.

    Labels are summed before anything travels; rows get the sums from a broadcast if the labels are proven few, else from a join."""
    coded = cut(coded, "vector_codes")
    sums = cut(coded.groupBy("label").agg(F.when(F.count_if(F.col("error").isNull()) == 0, F.try_sum("error")).alias("label_error")), "label_errors").withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def books_sha256(books: np.ndarray | None) -> str:
    """SHA-256 of all components, decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in (() if books is None else books.ravel())).encode()).hexdigest()
