"""FIFO round-turn reconstruction as running sums and one sweep over both legs' breakpoints.

A fill of sign s and quantity q meets a position ``bef``: it closes min(|bef|, q) if it goes against it and opens the
rest.  A trade runs from flat to flat, a flip closes one and opens the next.  Entry and exit slices are intervals of what a position
has opened and closed so far; both sums agree whenever it is flat, so both legs of a trade lie on one axis.  Where slices overlap, that
much is matched, oldest first: each overlap begins where some slice does, so a sweep over all beginnings, with the entry and the exit that
are under way carried forward, finds them all in one row a slice.  All running values go by operators/scan.py, so a position
of any number of fills is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio, segment, session_date
from . import scan

KEY = ["account", "symbol"]
NO_SIZE, NO_PRICE, BAD_COST, NO_SIDE, REPEATED = "quantity not positive", "price missing or negative", "cost negative", "side unknown", "repeated fill"


def screened(fills: DataFrame) -> DataFrame:
    """Every fill with ``reason``: NULL where it can be used, else why it is set aside, by the first fault in this order:
    quantity, price, side, costs (commission and, where there are any, fees), a fill_id that the account had before."""
    costs = [c for c in ("commission", "fees") if c in fills.columns]
    bad = F.lit(False)
    for c in costs:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    fault = F.when(~F.coalesce(F.col("qty") > 0, F.lit(False)), NO_SIZE).when(~F.coalesce(F.col("price") >= 0, F.lit(False)), NO_PRICE)
    fault = fault.when(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)), NO_SIDE).when(bad, BAD_COST)
    f = fills.withColumn("reason", fault)
    first = f.filter("reason is null").dropDuplicates(["account", "fill_id"])
    again = f.filter("reason is null").groupBy("account", "fill_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    repeats = first.join(again, ["account", "fill_id"]).withColumn("_copy", F.explode(F.sequence(F.lit(2), "_n"))).withColumn("reason", F.lit(REPEATED))
    return first.unionByName(f.filter("reason is not null")).unionByName(repeats.select(f.columns))


def usable_rows(fills: DataFrame) -> DataFrame:
    """Fills with a quantity, a price, a side and no negative cost; costs that are missing are none."""
    f = fills.filter("qty > 0 and price >= 0 and side in ('buy', 'sell')")
    for c in ("commission", "fees"):
        zero = F.lit(0).cast(fills.schema[c].dataType if c in fills.columns else "decimal(20,8)")
        f = f.withColumn(c, F.coalesce(F.col(c), zero) if c in fills.columns else zero).filter(F.col(c) >= 0)
    return f


def usable(fills: DataFrame) -> DataFrame:
    """usable_rows(), each fill_id of an account once."""
    return usable_rows(fills).dropDuplicates(["account", "fill_id"])


def slices(fills: DataFrame, **chunks: int) -> DataFrame:
    """Entry and exit slices: (account, symbol, tid, role, dir, fill_id, ts, price, qty, lo, hi, commission, fees).

    Fills go by ts, by the broker's ``sequence`` where there is one, and by fill_id.  lo and hi count what the position opened
    (entries) or closed (exits) since its first fill.
    """
    s = F.when(F.col("side") == "buy", 1).otherwise(-1)
    order = ["ts", *(["sequence"] if "sequence" in fills.columns else []), "fill_id"]
    f = scan.running(usable(fills).withColumn("s", s), KEY, order, {"aft": ("sum", F.col("s") * F.col("qty"))}, **chunks)
    f = f.withColumn("bef", F.col("aft") - F.col("s") * F.col("qty"))
    kind = fills.schema["qty"].dataType  # a part of a fill is no larger; wider types would cost the division digits
    f = f.withColumn("close_q", F.when(F.col("bef") * F.col("s") < 0, F.least(F.abs("bef"), F.col("qty"))).otherwise(0).cast(kind))
    f = f.withColumn("open_q", (F.col("qty") - F.col("close_q")).cast(kind))
    f = f.withColumn("starts", ((F.col("open_q") > 0) & ((F.col("bef") == 0) | (F.col("close_q") > 0))).cast("int"))
    f = scan.running(f, KEY, order, {"tid": ("sum", F.col("starts")), "opened": ("sum", F.col("open_q")), "closed": ("sum", F.col("close_q"))}, **chunks)
    # costs split between two slices: the close first, the open slice takes what is left
    share = {c: F.bround(F.col(c) * F.col("close_q") / F.col("qty"), 8).cast("decimal(20,8)") for c in ("commission", "fees")}

    def leg(role, tid, direction, qty, upto, costs):
        upto, qty = upto.cast("decimal(22,0)"), qty.cast("decimal(12,0)")
        return F.struct(
            F.lit(role).alias("role"), tid.alias("tid"), direction.alias("dir"), qty.alias("qty"), (upto - qty).cast("decimal(22,0)").alias("lo"),
            upto.alias("hi"), *(v.cast("decimal(20,8)").alias(c) for c, v in costs.items()),
        )

    parts = F.array(
        leg("exit", F.col("tid") - F.col("starts"), -F.col("s"), F.col("close_q"), F.col("closed"), share),
        leg("entry", F.col("tid"), F.col("s"), F.col("open_q"), F.col("opened"), {c: F.col(c) - v for c, v in share.items()}),
    )
    out = f.select(*KEY, "fill_id", "ts", "price", F.explode(F.filter(parts, lambda x: x["qty"] > 0)).alias("x"))
    return out.select(*KEY, "x.tid", "x.role", "x.dir", "fill_id", "ts", "price", "x.qty", "x.lo", "x.hi", "x.commission", "x.fees")


def matches(parts: DataFrame, **chunks: int) -> DataFrame:
    """Matched lots: one row per overlap of an entry and an exit slice, with the points gained per unit and in all."""
    now = F.struct("hi", "price", "fill_id", "ts", "dir")
    held = {f"_{r}": ("last", F.when(F.col("role") == r, now)) for r in ("entry", "exit")}
    swept = scan.running(parts.select(*KEY, "tid", "role", "lo", "hi", "price", "fill_id", "ts", "dir"), KEY, ["lo", "role"], held, **chunks)
    qty = (F.least("_entry.hi", "_exit.hi") - F.col("lo")).cast("decimal(12,0)")
    m = swept.filter("_entry is not null and _exit is not null").withColumn("qty", qty).filter("qty > 0")
    points = ((F.col("_exit.price") - F.col("_entry.price")).cast("decimal(20,8)") * F.col("_entry.dir") * F.col("qty")).cast("decimal(30,8)")
    return m.select(
        *KEY, "tid", F.col("_entry.dir").alias("dir"), F.col("_entry.fill_id").alias("entry_id"), F.col("_entry.price").alias("entry_price"),
        F.col("_exit.fill_id").alias("exit_id"), F.col("_exit.price").alias("exit_price"), F.col("_exit.ts").alias("exit_ts"), "qty", points.alias("points"),
    )


def measured(fills: DataFrame, **chunks: int) -> DataFrame:
    """Sums of each trade: dir, opened_at, last_exit, qty_opened, qty_closed, paid, got, commission, fees, entries, exits, points."""
    parts = slices(fills, **chunks)
    entry, exit_ = F.col("role") == "entry", F.col("role") == "exit"
    measure = parts.groupBy(*KEY, "tid").agg(
        F.max("dir").alias("dir"), F.min("ts").alias("opened_at"), F.max(F.when(exit_, F.col("ts"))).alias("last_exit"),
        F.sum(F.when(entry, F.col("qty"))).alias("qty_opened"), F.coalesce(F.sum(F.when(exit_, F.col("qty"))), F.lit(0)).alias("qty_closed"),
        F.sum(F.when(entry, F.col("price") * F.col("qty")).cast("decimal(30,8)")).alias("paid"),
        F.sum(F.when(exit_, F.col("price") * F.col("qty")).cast("decimal(30,8)")).alias("got"),
        F.sum("commission").alias("commission"), F.sum("fees").alias("fees"), F.count_if(entry).alias("entries"), F.count_if(exit_).alias("exits"),
    )
    gain = matches(parts, **chunks).groupBy(*KEY, "tid").agg(F.sum("points").alias("points"))
    return measure.join(gain, [*KEY, "tid"], "left")


def trades(fills: DataFrame, instruments: DataFrame, **chunks: int) -> DataFrame:
    """Round-turn trades, open ones too, with money by the instrument's point value and session by its exchange."""
    return priced(measured(fills, **chunks), instruments)


def priced(sums: DataFrame, instruments: DataFrame) -> DataFrame:
    """Trades of the sums that measured() or the stream makes."""
    t = sums.join(instruments, "symbol")
    closed = F.col("qty_opened") == F.col("qty_closed")
    local = F.from_utc_timestamp("opened_at", F.col("zone"))
    gross = (F.coalesce("points", F.lit(0)) * F.col("point")).cast("decimal(30,8)")
    return t.select(
        *KEY, "tid", F.when(F.col("dir") > 0, "long").otherwise("short").alias("direction"), F.when(closed, "closed").otherwise("open").alias("status"), "opened_at",
        F.when(closed, F.col("last_exit")).alias("closed_at"), "qty_opened", "qty_closed", ratio(F.col("paid"), F.col("qty_opened")).alias("avg_entry"),
        ratio(F.col("got"), F.col("qty_closed")).alias("avg_exit"), "points", gross.alias("gross"), "commission", "fees",
        (gross - F.col("commission") - F.col("fees")).cast("decimal(30,8)").alias("net"), (F.col("entries") > 1).alias("scaled_in"), (F.col("exits") > 1).alias("scaled_out"),
        F.when(closed, F.expr("(unix_micros(last_exit) - unix_micros(opened_at)) div 1000000")).alias("duration"), session_date(local, F.col("rollover")).alias("session_date"),
        segment(local).alias("segment"), F.hour(local).alias("entry_hour"), (F.weekday(local) + 1).alias("entry_weekday"),
    )


def closed_facts(fills: DataFrame, instruments: DataFrame) -> DataFrame:
    """Closed trades as statistics take them."""
    return trades(fills, instruments).filter("status = 'closed'").withColumn("trade_id", F.concat_ws("-", "account", "symbol", F.col("tid").cast("string")))


def max_position(parts: DataFrame, **chunks: int) -> DataFrame:
    """(account, symbol, tid, quantity): the greatest position that each trade of slices() held."""
    change = F.when(F.col("role") == "entry", F.col("qty")).otherwise(-F.col("qty"))
    held = scan.running(parts, [*KEY, "tid"], ["ts", "fill_id"], {"held": ("sum", change)}, **chunks)
    return held.groupBy(*KEY, "tid").agg(F.max("held").alias("quantity"))
