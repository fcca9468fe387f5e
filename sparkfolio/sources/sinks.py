"""Sinks as merges of tables: every write is a new table made of the stored one and the batch, keyed and idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge(stored: DataFrame, batch: DataFrame, key: list[str], machine: list[str]) -> DataFrame:
    """Rows by key: of rows in both, the columns ``machine`` are the batch's and all others stay as people left them; new rows
    have NULL there.  The batch must hold each key once."""
    new = batch.select(*key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in machine))
    j = stored.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    own = [c for c in stored.columns if c not in key]
    return j.select(*key, *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in machine else F.col(c) for c in own))


def replace_keys(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows of other keys, and all of the batch: a delete and an insert by key."""
    return stored.join(batch.select(*key).distinct(), key, "left_anti").unionByName(batch)


def updated(stored: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Stored rows whose ``columns`` are the update's where it has one for the row and the value is given."""
    u = updates.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    j = stored.join(u, key, "left")
    return j.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns))


def excursion_work(trades: DataFrame, most: int) -> DataFrame:
    """Closed trades with an entry price that no excursion is known of, newest first: a top-k, not a sort of all."""
    todo = trades.filter("closed_at is not null and avg_entry is not null and mae is null")
    return todo.orderBy(F.col("closed_at").desc(), F.col("trade_id").desc()).limit(most)


def open_positions(trades: DataFrame) -> DataFrame:
    """The state to resume from: of each key its open trade; a key whose last trade is closed has none."""
    last = F.row_number().over(W.partitionBy("account", "symbol").orderBy(F.col("tid").desc()))
    return trades.withColumn("_r", last).filter("_r = 1 and status = 'open'").drop("_r")


def metric_rows(overall: DataFrame, segments: DataFrame, metrics: list[str]) -> DataFrame:
    """(scope, dimension, key, metric, value): an overall row and a row for each segment, ready to be merged by slice."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    flat = lambda df, scope, d, k: df.select(F.lit(scope).alias("scope"), d.alias("dimension"), k.alias("key"), F.explode(each).alias("e")).select("scope", "dimension", "key", "e.*")
    return flat(overall, "overall", F.lit(""), F.lit("")).unionByName(flat(segments, "segment", F.col("dimension"), F.col("key")))


def latest(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The newest row of each key of an append-only table."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), order).alias("r")).select(*by, "r.*")


def ranked_patterns(patterns: DataFrame) -> DataFrame:
    """Established ones first, then by impact, the costliest first, unknown impact last."""
    return patterns.orderBy(F.col("is_significant").desc(), F.col("impact").asc_nulls_last(), "pattern")


def accept_setup(trades: DataFrame, members: DataFrame, setup: str) -> DataFrame:
    """Trades with the set-up's name and confidence on its members; others keep theirs."""
    m = members.select("trade_id", F.col("confidence").alias("_confidence"))
    j = trades.join(m, "trade_id", "left")
    hit = F.col("_confidence").isNotNull()
    return j.withColumn("setup", F.when(hit, F.lit(setup)).otherwise(F.col("setup"))).withColumn("confidence", F.when(hit, F.col("_confidence")).otherwise(F.col("confidence"))).drop("_confidence")


def rolling_count(events: DataFrame, at: str, hours: int = 24) -> DataFrame:
    """Per account how many events there were in the ``hours`` up to a moment."""
    now = F.to_timestamp(F.lit(at))
    return events.filter((F.col("ts") > now - F.expr(f"interval {hours} hours")) & (F.col("ts") <= now)).groupBy("account").agg(F.count("*").alias("n"))


def realised(trades: DataFrame, day: str) -> DataFrame:
    """Net of an account's closed trades of a session, 0 where there is none."""
    on = (F.col("status") == "closed") & (F.col("session_date") == F.to_date(F.lit(day)))
    return trades.groupBy("account").agg(F.coalesce(F.sum(F.when(on, F.col("net"))), F.lit(0)).alias("net"))


def reconciled(ours: DataFrame, theirs: DataFrame, tolerance: float) -> DataFrame:
    """(account, ours, theirs, difference, matches) against what the broker says; NULL where it says nothing."""
    j = ours.select("account", F.col("net").alias("ours")).join(theirs.select("account", F.col("net").alias("theirs")), "account", "left")
    gap = F.col("ours") - F.col("theirs")
    return j.withColumn("difference", gap).withColumn("matches", F.abs(gap) <= tolerance)


def respecified(trades: DataFrame, instruments: DataFrame) -> DataFrame:
    """Trades with their money computed anew from points by corrected instruments."""
    i = instruments.select("symbol", F.col("point").alias("_point"))
    gross = F.coalesce(F.col("points"), F.lit(0)) * F.col("_point")
    return trades.join(i, "symbol").withColumn("gross", gross.cast("decimal(30,8)")).withColumn("net", (F.col("gross") - F.col("commission") - F.col("fees")).cast("decimal(30,8)")).drop("_point")
