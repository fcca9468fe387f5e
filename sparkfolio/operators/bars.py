"""Bars: resampling, gaps, as-of lookups, excursions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranges, scan


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Epoch-anchored coarser bars stamped at their start: first open, max high, min low, last close, sum of the volumes
    that are given.  ``seq`` breaks ties of ts if there is one."""
    order = F.struct("ts", *([F.col("seq")] if "seq" in bars.columns else []))
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    return bars.groupBy("symbol", start.alias("ts")).agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))


def gaps(bars: DataFrame, seconds: int, **chunks: int) -> DataFrame:
    """Missing ranges between stored bars."""
    after = scan.running(bars.select("symbol", "ts"), ["symbol"], ["ts"], {"prev": ("last", F.col("ts"))}, before=True, **chunks)
    due = F.timestamp_seconds(F.unix_timestamp("prev") + seconds)
    return after.filter(F.unix_timestamp("ts") - F.unix_timestamp("prev") > seconds).select("symbol", due.alias("gap_start"), F.col("ts").alias("gap_end"))


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"))


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, right_ts: str, value: str, tolerance: int | None = None) -> DataFrame:
    """Adds ``value`` and ``value_ts`` of the latest right row at or before each left row's time.

    One sort of both sides by key and time; NULL if there is none or if it is ``tolerance`` seconds old or more.
    """
    names = left.columns
    both = left.select(by, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    order = W.partitionBy(by).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_v"), F.col("_t"))), ignorenulls=True).over(order)
    out = both.withColumn("_last", last).filter("_side = 1").select("_row.*", F.col("_last._v").alias(value), F.col("_last._t").alias("value_ts"))
    if tolerance is None:
        return out
    fresh = F.unix_timestamp(F.col(ts)) - F.unix_timestamp("value_ts") < tolerance
    return out.withColumn(value, F.when(fresh, F.col(value))).withColumn("value_ts", F.when(fresh, F.col("value_ts")))


def excursions(trades: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """(trade_id, mae, mfe, n_bars): worst and best move from the entry price over the covering bars, both >= 0.

    With ``risk`` (money) and ``point_value`` (money of a point at the trade's size) among the trades' columns also mae_r and mfe_r,
    the same in units of risk; NULL without a positive risk.
    """
    in_r = {"risk", "point_value"} <= set(trades.columns)
    keep = ["direction", "avg_entry", *(("risk", "point_value") if in_r else ())]
    c = ranges.over_bars(trades, bars, seconds, *keep)
    long = F.col("direction") == "long"
    down, up = F.col("avg_entry") - F.least("low", "avg_entry"), F.greatest("high", "avg_entry") - F.col("avg_entry")
    out = c.withColumns({"mae": F.when(long, down).otherwise(up), "mfe": F.when(long, up).otherwise(down)})
    if not in_r:
        return out.select("trade_id", "mae", "mfe", "n_bars")
    r = lambda c: F.when(F.col("risk") > 0, F.col(c) * F.col("point_value") / F.col("risk"))
    return out.select("trade_id", "mae", "mfe", r("mae").alias("mae_r"), r("mfe").alias("mfe_r"), "n_bars")


def first_touch(trades: DataFrame, bars: DataFrame, seconds: int, price: str) -> DataFrame:
    """(trade_id, touched_at): the first covering bar whose range holds ``price``; bars are read only in blocks whose range does."""
    asked = ranges.cover(trades.select("trade_id", "symbol", "opened_at", "closed_at", price), ranges.slot(F.col("opened_at"), seconds), ranges.slot(F.col("closed_at"), seconds))
    maybe = asked.join(ranges.pyramid(bars, seconds), ranges.BLOCK).filter(F.col(price).between(F.col("low"), F.col("high")))
    seen = ranges.bars_in_blocks(maybe.select("trade_id", price, *ranges.BLOCK), bars, seconds)
    return seen.filter(F.col(price).between(F.col("low"), F.col("high"))).groupBy("trade_id").agg(F.timestamp_seconds(F.min("_ts")).alias("touched_at"))


def atr(bars: DataFrame, periods: int = 14, **chunks: int) -> DataFrame:
    """Wilder's average true range at the last bar of each symbol; NULL with fewer than periods + 1 bars.

    The recursion is a weighted sum: a seed mean of the first true ranges, then (p-1)/p per step, so after each bar's number is
    known, it's an aggregation.
    """
    t = scan.running(bars.select("symbol", "ts", "high", "low", "close"), ["symbol"], ["ts"], {"prev": ("last", F.col("close")), "i": ("count", F.lit(1))}, before=True, **chunks)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))
    t = t.filter("prev is not null").withColumn("tr", tr)
    t = t.join(t.groupBy("symbol").agg(F.max("i").alias("n")), "symbol")  # a symbol a row
    keep = (periods - 1) / periods
    weight = F.when(F.col("i") <= periods, F.pow(F.lit(keep), F.col("n") - periods) / periods).otherwise(F.pow(F.lit(keep), F.col("n") - F.col("i")) / periods)
    return t.groupBy("symbol").agg(F.when(F.max("n") >= periods, F.sum(F.col("tr") * weight)).alias("atr"), F.max("n").alias("n_ranges"))


def invalid(bars: DataFrame) -> DataFrame:
    """Bars to set aside: a high under the low, or an open or close outside of both."""
    fits = (F.col("high") >= F.col("low")) & F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))
    return bars.filter(~F.coalesce(fits, F.lit(False)))


def shapes(bars: DataFrame) -> DataFrame:
    """Bars with their range, midpoint, whether they closed up, and whether which of high and low came first can't be told."""
    up = F.col("close") >= F.col("open")
    both = (F.col("high") > F.greatest("open", "close")) & (F.col("low") < F.least("open", "close"))
    return bars.withColumns({"range": F.col("high") - F.col("low"), "midpoint": (F.col("high") + F.col("low")) / 2, "is_up": up, "sequence_ambiguous": both})


def bar_at(left: DataFrame, bars: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Adds ``close`` and ``value_ts`` of the bar that is open at each row's time, NULL in a gap."""
    return as_of(left, bars, "symbol", ts, "ts", "close", seconds)


def latest_close(bars: DataFrame, at: str) -> DataFrame:
    """Per symbol the close of the last bar at or before a time."""
    some = bars.filter(F.col("ts") <= F.to_timestamp(F.lit(at)))
    return some.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.max("ts").alias("ts"))


def stored_timeframes(bars: DataFrame) -> DataFrame:
    """(symbol, seconds) that bars are stored at, finest first."""
    return bars.select("symbol", "seconds").distinct().orderBy("symbol", "seconds")


def at_resolution(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars of ``seconds`` of every symbol: the stored ones, or else made of the coarsest stored finer ones; none if there are
    only coarser ones.  bars: with their ``seconds``."""
    best = bars.filter(F.col("seconds") <= seconds).groupBy("symbol").agg(F.max("seconds").alias("_best"))  # a symbol a row
    own = bars.join(best, "symbol").filter(F.col("seconds") == F.col("_best"))
    return resample(own.drop("seconds", "_best"), seconds).withColumn("seconds", F.lit(seconds))


def partial_coverage(trades: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """(trade_id, n_bars, partial): whether bars leave part of a trade unseen: before the first, after the last, or in a gap."""
    a = ranges.over_bars(trades, bars, seconds, "opened_at", "closed_at")
    unix = lambda x: F.unix_micros(x) / 1e6
    holes = F.col("last") - F.col("first") > (F.col("n_bars") - 1) * seconds
    return a.select("trade_id", "n_bars", ((F.col("first") > unix("opened_at")) | (F.col("last") + seconds < unix("closed_at")) | holes).alias("partial"))


def has_bars(trades: DataFrame, bars: DataFrame, lead: int, trail: int) -> DataFrame:
    """Trades of which some bar lies within ``lead`` seconds before the opening and ``trail`` after the closing."""
    levels = 13  # of seconds: some two years
    asked = ranges.cover(trades.select("trade_id", "symbol", "opened_at", "closed_at"), F.unix_timestamp("opened_at") - lead, F.unix_timestamp("closed_at") + trail, levels)
    held = bars.select("symbol", F.unix_timestamp("ts").alias("at")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    held = held.select("symbol", "level", F.expr(ranges._up("at", "level")).alias("block")).distinct()
    return trades.join(asked.join(held, ranges.BLOCK, "left_semi").select("trade_id").distinct(), "trade_id", "left_semi")


def backfill(trades: DataFrame, bars: DataFrame, timeframes: list[tuple[int, int]]) -> DataFrame:
    """Excursions of all trades, each at the resolution for its duration; trades without bars are left out.

    timeframes: (least duration, seconds of a bar), ascending; bars: with their ``seconds``.
    """
    out = None
    for i, (least, seconds) in enumerate(timeframes):
        own = trades.filter(F.col("duration") >= least) if i + 1 == len(timeframes) else trades.filter((F.col("duration") >= least) & (F.col("duration") < timeframes[i + 1][0]))
        e = excursions(own, at_resolution(bars, seconds), seconds).withColumn("seconds", F.lit(seconds))
        out = e if out is None else out.unionByName(e)
    return out
