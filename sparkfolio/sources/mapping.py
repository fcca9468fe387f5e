"""Raw fills to fills: decimal-safe parsing, reference joins, deferral with a reason, and the cursor that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reasons in the order they are tested, seconds a fee may take to settle.
NO_ORDER, NO_CONTRACT, NO_FEE, GRACE = "order missing", "contract missing", "fee not settled", 300
RAW = "id long, order_id long, contract_id long, ts timestamp, action string, qty long, price decimal(20,8)"


def landed(spark: SparkSession, folder: str, after: int | None = None) -> DataFrame:
    """Fills of JSON lines, prices as decimals, behind the cursor."""
    f = spark.read.schema(RAW).option("prefersDecimal", "true").json(folder)
    return f if after is None else f.filter(F.col("id") > after)


def specs(contracts: DataFrame, products: DataFrame) -> DataFrame:
    """(contract_id, symbol, tick, tick_value, digits): a tick is worth the point value times its size, and prices have
    as many digits as the tick.  contracts: (contract_id, symbol, product_id); products: (product_id, point, tick)."""
    tick = F.col("tick").cast("decimal(20,8)")
    fraction = F.regexp_extract(tick.cast("string"), r"\.([0-9]*?)0*$", 1)
    return contracts.join(products, "product_id").select("contract_id", "symbol", tick.alias("tick"), (F.col("point").cast("decimal(12,2)") * tick).cast("decimal(28,8)").alias("tick_value"), F.length(fraction).alias("digits"))


def map_fills(fills: DataFrame, orders: DataFrame, spec: DataFrame, fees: DataFrame, now: str, accounts: DataFrame | None = None) -> DataFrame:
    """Every fill with its account, symbol, costs and ``reason``: NULL where it is a whole fill, else why it waits.

    orders: (order_id, account); fees: (id, commission, fees); accounts: (account), to map these only.  Equi-joins on
    identifiers; a fill without an order waits whatever accounts are asked for, since nobody knows whose it is.
    """
    f = fills.join(orders.select("order_id", "account"), "order_id", "left")
    if accounts is not None:
        f = f.join(accounts.select("account", F.lit(True).alias("_asked")), "account", "left").filter("account is null or _asked").drop("_asked")
    f = f.join(spec.select("contract_id", "symbol", "tick_value"), "contract_id", "left").join(fees.select("id", "commission", "fees", F.lit(True).alias("_fee")), "id", "left")
    young = F.col("ts") > F.to_timestamp(F.lit(now)) - F.expr(f"interval {GRACE} seconds")
    reason = F.when(F.col("account").isNull(), NO_ORDER).when(F.col("symbol").isNull(), NO_CONTRACT).when(F.col("_fee").isNull() & young, NO_FEE)
    return f.withColumn("reason", reason).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("commission", "fees")}).drop("_fee")


def next_cursor(mapped: DataFrame, current: int, known: DataFrame | None = None) -> DataFrame:
    """One row, cursor: as far as all is mapped.  Below the least waiting fill or the least of an account not in
    ``known`` (account), and never back."""
    m = mapped
    blocked = F.col("reason").isNotNull()
    if known is not None:
        m = m.join(known.select("account", F.lit(True).alias("_known")), "account", "left")
        blocked = blocked | F.col("_known").isNull()
    a = m.agg(F.max("id").alias("top"), F.min(F.when(blocked, F.col("id"))).alias("stop"))
    return a.select(F.greatest(F.lit(current), F.least(F.greatest("top", F.lit(current)), F.col("stop") - 1)).cast("long").alias("cursor"))
