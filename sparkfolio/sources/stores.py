"""Idempotent sinks and probes of fills and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fresh(received: DataFrame, stored: DataFrame, *key: str) -> DataFrame:
    """Received rows whose key isn't stored, each key once (its first row by all columns)."""
    order = W.partitionBy(*key).orderBy(*(c for c in received.columns if c not in key))
    return received.join(stored.select(*key), list(key), "left_anti").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Stored rows with those of ``new`` in their place or beside them; the last by ``version`` wins."""
    order = W.partitionBy(*key).orderBy(F.col("_new").desc(), F.col("version").desc())
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def missing_ranges(coverage: DataFrame, start: str, end: str) -> DataFrame:
    """Uncovered head and tail of [start, end] per symbol."""
    s, e = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    parts = F.array(F.when(F.col("first_ts") > s, F.struct(s.alias("range_start"), F.least("first_ts", e).alias("range_end"))), F.when(F.col("last_ts") < e, F.struct(F.greatest("last_ts", s).alias("range_start"), e.alias("range_end"))))
    return coverage.select("symbol", F.explode(F.array_compact(parts)).alias("r")).select("symbol", "r.range_start", "r.range_end")


def blotter(trades: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of trades, newest first."""
    return trades.orderBy(F.desc("opened_at"), F.desc("trade_id")).offset(offset).limit(limit)
