"""Bars and fills at rest, laid out so that a range reads its own folders only.

Bars lie by timeframe, symbol bucket and day, fills by account bucket and month.  Readers put the layout's columns beside what they ask for:
a fixed symbol or account prunes when the query is planned, ranges that come from a table (trades, for instance) prune when it runs, by
dynamic partition pruning on the same columns.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
BARS, FILLS = ["seconds", "bucket", "day"], ["bucket", "month"]


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bars(bars: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Adds bars (with their ``seconds``) to the store.  Rows are dealt out by folder, and large folders are split between tasks."""
    laid = bars.withColumns({"bucket": bucket(F.col("symbol"), buckets), "day": F.to_date("ts")})
    laid.hint("rebalance", *BARS).write.mode("append").partitionBy(*BARS).parquet(path)


def write_fills(fills: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    laid = fills.withColumns({"bucket": bucket(F.col("account"), buckets), "month": F.trunc("ts", "month")})
    laid.hint("rebalance", *FILLS).write.mode("append").partitionBy(*FILLS).parquet(path)


def bar_range(spark: SparkSession, path: str, symbol: str, seconds: int, start: datetime, end: datetime, limit: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Bars of a symbol and timeframe from ``start`` up to ``end``, both included, oldest first; with a ``limit`` the newest so many."""
    own = spark.range(1).select(bucket(F.lit(symbol), buckets)).first()[0]
    b = spark.read.parquet(path).filter((F.col("seconds") == seconds) & (F.col("bucket") == own) & F.col("day").between(start.date(), end.date()))
    b = b.filter((F.col("symbol") == symbol) & F.col("ts").between(start, end)).drop("bucket", "day")
    return b.orderBy("ts") if limit is None else b.orderBy(F.desc("ts")).limit(limit).orderBy("ts")


def bars_of_ranges(spark: SparkSession, path: str, asked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``asked`` (symbol, seconds, range_start, range_end and others) with each bar that starts in their range.

    A range is a row for each of its days, so both sides meet on folder and symbol.
    """
    days = F.explode(F.sequence(F.to_date("range_start"), F.to_date("range_end")))
    ranges = asked.withColumns({"bucket": bucket(F.col("symbol"), buckets), "day": days})
    return spark.read.parquet(path).join(ranges, ["symbol", *BARS]).filter(F.col("ts").between(F.col("range_start"), F.col("range_end"))).drop("bucket", "day")


def fills_of(spark: SparkSession, path: str, account: int, since: datetime | None = None, until: datetime | None = None, buckets: int = BUCKETS) -> DataFrame:
    """An account's fills from ``since`` to before ``until``."""
    own = spark.range(1).select(bucket(F.lit(account).cast("long"), buckets)).first()[0]
    f = spark.read.parquet(path).filter((F.col("bucket") == own) & (F.col("account") == account))
    if since is not None:
        f = f.filter((F.col("month") >= since.date().replace(day=1)) & (F.col("ts") >= since))
    if until is not None:
        f = f.filter((F.col("month") <= until.date()) & (F.col("ts") < until))
    return f.drop(*FILLS)


def fills_since(spark: SparkSession, path: str, accounts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Fills of many accounts, each from its own moment on; accounts: (account, since)."""
    asked = accounts.withColumn("bucket", bucket(F.col("account").cast("long"), buckets))
    return spark.read.parquet(path).join(asked, ["account", "bucket"]).filter(F.col("ts") >= F.col("since")).drop("since", *FILLS)
