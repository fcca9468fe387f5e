"""Replays: the chart window of a trade, its markers, and the gaps of its bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bars shown before entry and after exit; seconds held at most, seconds of a bar.
BEFORE, AFTER = 120, 60
BAR_SECONDS = ((120, 15), (900, 60), (3600, 120), (14400, 300), (86400, 900), (604800, 3600))
LONGEST = 3600


def bar_seconds(held: Column) -> Column:
    """Seconds of the bars on which a trade held so long is shown."""
    out = F.lit(LONGEST)
    for most, seconds in reversed(BAR_SECONDS):
        out = F.when(F.greatest(held, F.lit(1)) <= most, F.lit(seconds)).otherwise(out)
    return out


def windows(trades: DataFrame) -> DataFrame:
    """(trade_id, symbol, bar_seconds, window_start, window_end); an open trade's window ends behind its entry."""
    end = F.coalesce("closed_at", "opened_at")
    t = trades.withColumn("bar_seconds", bar_seconds(F.coalesce("duration", F.lit(0))))
    shift = lambda c, bars: F.timestamp_micros(F.unix_micros(c) + F.col("bar_seconds").cast("long") * (bars * 1_000_000))
    return t.select("trade_id", "symbol", "bar_seconds", shift(F.col("opened_at"), -BEFORE).alias("window_start"), shift(end, AFTER).alias("window_end"))


def markers(slices: DataFrame) -> DataFrame:
    """(account, symbol, tid, kind, ts, price, qty): the first entry and the last exit of a trade, scaling between."""
    leg = W.partitionBy("account", "symbol", "tid", "role")
    s = slices.withColumn("_i", F.row_number().over(leg.orderBy("ts", "fill_id"))).withColumn("_n", F.count("*").over(leg))
    entry = F.when(F.col("_i") == 1, "entry").otherwise("scale_in")
    leave = F.when(F.col("_i") == F.col("_n"), "exit").otherwise("scale_out")
    return s.select("account", "symbol", "tid", F.when(F.col("role") == "entry", entry).otherwise(leave).alias("kind"), "fill_id", "ts", "price", "qty")


def excursion_markers(excursions: DataFrame) -> DataFrame:
    """(trade_id, kind, price) of the worst and the best price of each trade, as lines across it; none where it isn't known.

    excursions: (trade_id, direction, avg_entry, mae, mfe), both magnitudes."""
    way = F.when(F.col("direction") == "long", 1).otherwise(-1)
    both = F.array(
        F.struct(F.lit("mae").alias("kind"), (F.col("avg_entry") - way * F.col("mae")).alias("price")), F.struct(F.lit("mfe").alias("kind"), (F.col("avg_entry") + way * F.col("mfe")).alias("price"))
    )
    return excursions.select("trade_id", F.explode(both).alias("m")).select("trade_id", "m.*").filter("price is not null")


def risk_box(trades: DataFrame) -> DataFrame:
    """(trade_id, box_from, box_to, entry_price, stop_price, risk_points): from entry to stop; none without a stop or with one on the wrong side."""
    way = F.when(F.col("direction") == "long", 1).otherwise(-1)
    t = trades.withColumn("risk_points", (F.col("avg_entry") - F.col("stop_price")) * way).filter("risk_points > 0")
    return t.select("trade_id", F.col("opened_at").alias("box_from"), F.coalesce("closed_at", "opened_at").alias("box_to"), F.col("avg_entry").alias("entry_price"), "stop_price", "risk_points")


# What a frame shows before the entry and after the exit, in parts of the time held.
LEAD, TRAIL = 1.0, 1.0


def frames(trades: DataFrame) -> DataFrame:
    """(trade_id, symbol, bar_seconds, kind, frame_start, frame_end, highlight) of the four views of each closed trade.

    The view before the entry ends there: nothing on it tells the outcome."""
    held = F.unix_micros("closed_at") - F.unix_micros("opened_at")
    whole = lambda part: F.floor(held * part / 1_000_000) * 1_000_000
    at = lambda c: F.unix_micros(c)
    views = {
        "before_entry": (at("opened_at") - whole(LEAD), at("opened_at"), "opened_at"), "entry": (at("opened_at") - whole(LEAD), at("closed_at"), "opened_at"),
        "exit": (at("opened_at"), at("closed_at") + whole(TRAIL), "closed_at"), "after_exit": (at("closed_at"), at("closed_at") + F.col("bar_seconds").cast("long") * (AFTER * 1_000_000), "closed_at"),
    }
    rows = F.array(*(
        F.struct(F.lit(k).alias("kind"), F.timestamp_micros(a).alias("frame_start"), F.timestamp_micros(b).alias("frame_end"), F.col(h).alias("highlight")) for k, (a, b, h) in views.items()
    ))
    t = trades.filter("closed_at is not null").withColumn("bar_seconds", bar_seconds(F.coalesce("duration", F.lit(0))))
    return t.select("trade_id", "symbol", "bar_seconds", F.explode(rows).alias("f")).select("trade_id", "symbol", "bar_seconds", "f.*")


def frame_contents(shown: DataFrame, bars: DataFrame, events: DataFrame) -> DataFrame:
    """Frames with n_bars, the first and last bar, and n_markers: the events (trade_id, ts) between these two, and no others."""
    f = bar_spans(shown, bars, "frame_start", "frame_end")
    e = events.select("trade_id", F.col("ts").alias("_at"))
    n = f.select("trade_id", "kind", "first_bar", "last_bar").join(e, "trade_id").filter(F.col("_at").between(F.col("first_bar"), F.col("last_bar")))
    n = n.groupBy("trade_id", "kind").agg(F.count("*").alias("n_markers"))
    return f.join(n, ["trade_id", "kind"], "left").withColumn("n_markers", F.coalesce("n_markers", F.lit(0)))


#: Bars that a block of a time line has at most, if they stand on their resolution's grid.
BLOCK = 64


def bar_spans(shown: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """``shown`` with n_bars between ``start`` and ``end``, and the first_bar and last_bar of these.

    A time line (symbol and resolution) is cut into blocks that know their bars, how many come before, and the bars next to them, so each
    window meets two blocks, however many bars it holds.  bars: as in_windows() takes them."""
    each = "seconds" in bars.columns
    line = ["_symbol", *(["_seconds"] if each else [])]
    width = (F.col("_seconds").cast("long") if each else F.lit(60).cast("long")) * (BLOCK * 1_000_000)
    block = lambda t: F.floor(t / width)
    b = bars.filter("ts is not null").select(F.col("symbol").alias("_symbol"), *([F.col("seconds").alias("_seconds")] if each else []), F.unix_micros("ts").alias("_t"))
    k = b.withColumn("_block", block(F.col("_t"))).groupBy(*line, "_block").agg(F.array_sort(F.collect_list("_t")).alias("_in"))
    w = W.partitionBy(*line).orderBy("_block")  # blocks of a time line: its calendar, not its trades
    n = F.size("_in").cast("long")
    k = k.withColumns({"_n": F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_prior": F.lag(F.element_at("_in", -1)).over(w), "_then": F.lead(F.col("_in")[0]).over(w), "_to": F.coalesce(F.lead("_block").over(w) - 1, F.col("_block"))})
    own, gap = F.col("_at") == F.col("_block"), F.array().cast("array<bigint>")
    k = k.withColumn("_at", F.explode(F.sequence("_block", "_to"))).select(
        *line, F.col("_at").alias("_block"), F.when(own, F.col("_in")).otherwise(gap).alias("_in"), F.when(own, F.col("_n")).otherwise(F.col("_n") + n).alias("_n"),
        F.when(own, F.col("_prior")).otherwise(F.element_at("_in", -1)).alias("_prior"), "_then",
    )
    whole = b.groupBy(*line).agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    same = [F.col("symbol") == F.col("_symbol"), *([F.col("bar_seconds") == F.col("_seconds")] if each else [])]
    s = shown.join(F.broadcast(whole), same, "left")  # one row a time line
    s = s.withColumns({"_a": F.greatest(F.unix_micros(start), F.col("_low")), "_e": F.least(F.unix_micros(end), F.col("_high"))})
    inside = (F.unix_micros(start) <= F.col("_high")) & (F.unix_micros(end) >= F.col("_low"))
    s = s.withColumns({"_ba": F.when(inside, block(F.col("_a"))), "_be": F.when(inside, block(F.col("_e")))}).drop(*line)
    for side, at in (("a", "_ba"), ("e", "_be")):
        of = k.select(*(F.col(c).alias(f"{c}_{side}") for c in (*line, "_block", "_in", "_n", "_prior", "_then")))
        keys = [F.col("symbol") == F.col(f"_symbol_{side}"), F.col(at) == F.col(f"_block_{side}"), *([F.col("bar_seconds") == F.col(f"_seconds_{side}")] if each else [])]
        s = s.join(of, keys, "left")
        if side == "a":
            rest = F.filter("_in_a", lambda x: x >= F.col("_a"))
            s = s.withColumns({"_less": F.col("_n_a") + F.size("_in_a") - F.size(rest), "_first": F.coalesce(F.try_element_at(rest, F.lit(1)), F.col("_then_a"))})
        else:
            upto = F.filter("_in_e", lambda x: x <= F.col("_e"))
            s = s.withColumns({"_upto": F.col("_n_e") + F.size(upto), "_last": F.coalesce(F.try_element_at(upto, F.lit(-1)), F.col("_prior_e"))})
        s = s.drop(*of.columns)
    n_bars = F.coalesce(F.greatest(F.col("_upto") - F.col("_less"), F.lit(0)), F.lit(0)).cast("long")
    s = s.withColumn("n_bars", n_bars)
    some = lambda c: F.when(F.col("n_bars") > 0, F.timestamp_micros(c))
    return s.select(*shown.columns, "n_bars", some("_first").alias("first_bar"), some("_last").alias("last_bar"))


def in_windows(shown: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of ``shown`` with each bar of their resolution between ``start`` and ``end``, joined on (symbol, resolution, day).

    bars: (symbol, seconds, ts, open, high, low, close); without ``seconds`` they stand for every resolution."""
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    w = shown.withColumn("_day", F.explode(F.sequence(day(start), day(end))))
    own = F.col("seconds") if "seconds" in bars.columns else F.lit(None).cast("long")
    b = bars.select(F.col("symbol").alias("_symbol"), own.alias("_seconds"), day("ts").alias("_bday"), "ts", "open", "high", "low", "close")
    same = (F.col("symbol") == F.col("_symbol")) & (F.col("_day") == F.col("_bday"))
    if "seconds" in bars.columns:
        same = same & (F.col("bar_seconds") == F.col("_seconds"))
    return w.join(b, same & F.col("ts").between(F.col(start), F.col(end))).drop("_day", "_symbol", "_seconds", "_bday")


def window_bars(shown: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars inside each window at its own resolution, with gap: whether more than a bar lies behind the one before.

    shown: windows(); bars: of all resolutions that are shown, with their ``seconds``.
    """
    j = in_windows(shown, bars, "window_start", "window_end")
    before = F.lag("ts").over(W.partitionBy("trade_id").orderBy("ts"))  # a window's bars, some thousands at most
    gap = F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp(before) > F.col("bar_seconds"), F.lit(False))
    return j.select("trade_id", "ts", "open", "high", "low", "close", gap.alias("gap"))
