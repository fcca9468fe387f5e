"""Running values in two levels, so that one key with very many rows isn't one task.

A key with more than ``CHUNK_ROWS`` rows is cut into chunks of its order's first column.  Windows run inside chunks; each chunk's
own total (a sum, a count, a maximum, a last value) is a row of a small table, a window over a key's chunks says what came before
each of them, and a join on (key, chunk), by which the rows are partitioned already, carries that into the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch

CHUNK_ROWS = 1_000_000
#: Inputs of fewer bytes than these can't hold a key that one task doesn't sort with ease: keys aren't counted then.
SMALL_BYTES = 512 << 20
#: Chunks are made so many times finer than rows need, as a key's rows may be unevenly spread over its span.
FINER = 8


def input_bytes(df: DataFrame) -> int:
    """Bytes of all that ``df`` is computed from, as its scans know them.

    What no scan knows the size of came from the driver or in a micro-batch, and counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def place(df: DataFrame, at: str) -> Column:
    """A column's value as a number that chunks are cut by."""
    kind = dict(df.dtypes)[at]
    return F.unix_micros(at) if kind == "timestamp" else F.unix_date(at) if kind == "date" else F.col(at).cast("double")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: chunks, totals and counts read it there instead of computing it again each."""
    path = scratch.folder(df.sparkSession, "scan")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(df: DataFrame, by: list[str], at: str, rows: int = CHUNK_ROWS, small: int = SMALL_BYTES) -> DataFrame | None:
    """``df`` with ``_chunk``, 0 but for keys of more than ``rows`` rows; None if there is no such key."""
    if input_bytes(df) < small:
        return None
    # counts need the key's columns only: nothing is written, and no window computed, unless some key is large
    if df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).isEmpty():
        return None
    df = written(df)
    spot = place(df, at)
    hot = df.groupBy(*by).agg(F.count("*").alias("_n"), F.min(spot).alias("_low"), F.max(spot).alias("_high")).filter(F.col("_n") > rows)
    keys = hot.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_n", "_low", "_high")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    share = (spot - F.col("_low")) / (F.col("_high") - F.col("_low") + 1)
    chunk = F.coalesce(F.floor(share * F.ceil(F.col("_n") / rows) * FINER), F.lit(0)).cast("long")
    return df.join(keys, same, "left").withColumn("_chunk", chunk).drop("_n", "_low", "_high", *(f"_k{i}" for i in range(len(by))))


_OVER = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}


def _total(op: str, column: Column, order: list[str]) -> Column:
    if op == "last":
        return F.max_by(column, F.when(column.isNotNull(), F.struct(*order)))
    return _OVER[op](column)


def _joined(op: str, carry: Column, local: Column) -> Column:
    if op == "last":
        return F.coalesce(local, carry)
    if op in ("max", "min"):
        return (F.greatest if op == "max" else F.least)(carry, local)
    return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)


def running(
    df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], before: bool = False, rows: int = CHUNK_ROWS, small: int = SMALL_BYTES
) -> DataFrame:
    """Adds, in ``order`` within ``by``, each running value: name -> (sum, max, min, count or last, column); of the rows before with ``before``.

    Equal to a window over the whole key.  ``order`` must decide the order of all rows of a key; nulls come first.
    """
    cut = chunked(df, by, order[0], rows, small)
    frame = lambda w: w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    if cut is None:
        return df.withColumns({name: _OVER[op](c).over(frame(W.partitionBy(*by))) for name, (op, c) in values.items()})
    names = {name: f"_local_{i}" for i, name in enumerate(values)}
    key = [*by, "_chunk"]
    local = cut.withColumns({names[n]: _OVER[op](c).over(frame(W.partitionBy(*key))) for n, (op, c) in values.items()})
    totals = cut.groupBy(*key).agg(*(_total(op, c, order).alias(f"_total_{i}") for i, (op, c) in enumerate(values.values())))
    over = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    again = {"count": "sum"}
    carries = totals.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)),
        *(_OVER[again.get(op, op)](F.col(f"_total_{i}")).over(over).alias(f"_carry_{i}") for i, (op, _) in enumerate(values.values())),
    )
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(carries, same, "left")
    kinds = dict(local.dtypes)
    made = {n: _joined(op, F.col(f"_carry_{i}"), F.col(names[n])).cast(kinds[names[n]]) for i, (n, (op, _)) in enumerate(values.items())}
    return out.withColumns(made).select(*df.columns, *(n for n in values if n not in df.columns))
