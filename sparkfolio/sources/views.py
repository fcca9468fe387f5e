"""Deterministic trading views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: symbol, tick size, value of a point, exchange time zone, session rollover.
INSTRUMENTS = [
    ("click", "0.25", "50", "America/Chicago", "17:00"),
    ("error", "0.25", "5", "America/New_York", "17:00"),
    ("purchase", "0.01", "1000", "America/Chicago", "17:00"),
    ("signup", "0.01", "10", "America/New_York", "18:00"),
    ("view", "0.25", "20", "America/Chicago", "17:00"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instruments(spark: SparkSession) -> DataFrame:
    """Five rows: always broadcast."""
    from ..functions.exprs import clock

    rows = [(s, t, p, z, clock(r)) for s, t, p, z, r in INSTRUMENTS]
    return spark.createDataFrame(rows, "symbol string, tick string, point string, zone string, rollover int").withColumns({"tick": F.col("tick").cast("decimal(20,8)"), "point": F.col("point").cast("decimal(12,2)")})


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fills: (fill_id, account, symbol, ts, side, qty, price, commission, fees)."""
    e = table(spark, sf_dir, "events")
    qty = (F.col("event_id") % 4 + 1).cast("decimal(6,0)")
    return e.select(
        F.col("event_id").alias("fill_id"), F.col("user_id").alias("account"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.when((F.col("event_id") + F.col("user_id")) % 2 == 0, "buy").otherwise("sell").alias("side"), qty.alias("qty"),
        F.round("value", 2).cast("decimal(20,8)").alias("price"), (qty * F.lit("0.25").cast("decimal(4,2)")).cast("decimal(20,8)").alias("commission"),
        (qty * F.lit("0.02").cast("decimal(4,2)")).cast("decimal(20,8)").alias("fees"),
    )


def bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    """Events as bars of a symbol."""
    from ..operators.bars import resample

    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.round("value", 2).alias("price"))
    one = ticks.select("symbol", "ts", F.col("event_id").alias("seq"), *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"))
    return resample(one, seconds)


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed trades, one row each: (trade_id, account, instrument, direction, opened_at, closed_at,
    session_date, net, costs, gross, risk, r_multiple, duration)."""
    from ..functions.exprs import r_multiple

    money = lambda c: F.col(c).cast("decimal(15,2)")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(money("l_extendedprice") * (F.lit("0.05").cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(20,8)").alias("net"),
        F.sum(money("l_extendedprice") * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(20,8)").alias("risk"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(20,8)").alias("quantity"),
        F.max(F.col("l_shipdate").cast("timestamp")).alias("shipped"),
    )
    o = table(spark, sf_dir, "orders").withColumn("opened_at", F.col("o_orderdate").cast("timestamp"))
    j = o.join(lines, o.o_orderkey == lines.l_orderkey)
    costs = (F.col("quantity") * F.lit("0.25").cast("decimal(4,2)")).cast("decimal(20,8)")
    return j.select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("instrument"),
        F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("direction"), "opened_at",
        F.greatest("opened_at", "shipped").alias("closed_at"), F.to_date("opened_at").alias("session_date"), "quantity", "net", costs.alias("costs"),
        (F.col("net") + costs).cast("decimal(20,8)").alias("gross"), "risk", r_multiple(F.col("net"), F.col("risk")).alias("r_multiple"),
    ).withColumn("duration", F.unix_timestamp("closed_at") - F.unix_timestamp("opened_at"))
