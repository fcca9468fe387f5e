"""State before each trade, as windows; behaviours; false-discovery adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from . import scan

REVENGE_MINUTES, OVERTRADING_INDEX = 10, 6


def session_state(trades: DataFrame, *by: str) -> DataFrame:
    """Adds, per session (NULL is one too): index, pnl_before, losses_before (scratches neutral), minutes_since_exit
    (whole, >= 0), prev_loss (a scratch keeps it).  by: further columns that part sequences, such as the account."""
    part = W.partitionBy(*by, "session_date").orderBy("opened_at", "trade_id")
    before = part.rowsBetween(W.unboundedPreceding, -1)
    t = trades.withColumn("index", F.row_number().over(part) - 1).withColumn("pnl_before", F.coalesce(F.sum("net").over(before), F.lit(0)))
    wins = F.coalesce(F.sum((F.col("net") > 0).cast("int")).over(before), F.lit(0))
    t = t.withColumn("_w", wins)
    # losses before this trade since the last win before it: the number of wins before marks the stretch
    t = t.withColumn("_loss", (F.col("net") < 0).cast("int"))
    run = W.partitionBy(*by, "session_date", "_w").orderBy("opened_at", "trade_id").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("losses_before", F.coalesce(F.sum("_loss").over(run), F.lit(0)))
    last_exit = F.last("closed_at", ignorenulls=True).over(before)
    gap = F.greatest(F.lit(0), F.expr("unix_micros(opened_at)") - F.expr("unix_micros(_exit)"))
    t = t.withColumn("_exit", last_exit).withColumn("minutes_since_exit", F.when(F.col("_exit").isNotNull(), F.floor(gap / 60_000_000)))
    prev = F.last(F.when(F.col("net") != 0, F.col("net") < 0), ignorenulls=True).over(before)
    return t.withColumn("prev_loss", F.when(F.col("index") > 0, F.coalesce(prev, F.lit(False)))).drop("_w", "_loss", "_exit")


def entry_snapshots(trades: DataFrame) -> DataFrame:
    """What is known at each entry of an account: session count, P&L and fractional minutes since the previous entry, and
    streaks over the whole history, where a scratch counts as a loss."""
    day, all_ = W.partitionBy("account", "session_date").orderBy("opened_at", "trade_id"), W.partitionBy("account").orderBy("opened_at", "trade_id")
    before = day.rowsBetween(W.unboundedPreceding, -1)
    t = trades.withColumn("won", F.col("net") > 0).withColumn("n_before", F.row_number().over(day) - 1).withColumn("pnl_before", F.coalesce(F.sum("net").over(before), F.lit(0)))
    t = t.withColumn("gap_minutes", (F.expr("unix_micros(opened_at)") - F.lag(F.expr("unix_micros(opened_at)")).over(day)) / 60_000_000)
    t = t.withColumn("_i", F.row_number().over(all_)).withColumn("_r", F.col("_i") - F.row_number().over(W.partitionBy("account", "won").orderBy("opened_at", "trade_id")))
    own = F.row_number().over(W.partitionBy("account", "won", "_r").orderBy("opened_at", "trade_id"))
    t = t.withColumn("_s", own).withColumn("_ps", F.lag("_s").over(all_)).withColumn("_pw", F.lag("won").over(all_))
    return t.withColumn("win_streak", F.when(F.col("_pw"), F.col("_ps")).otherwise(0)).withColumn("loss_streak", F.when(~F.col("_pw"), F.col("_ps")).otherwise(0)).drop("_i", "_r", "_s", "_ps", "_pw")


def detectors(typical: float | None = None, size: str = "qty_opened") -> dict[str, tuple[Column, Column]]:
    """Behaviours: (present, NULL to leave a trade out; value).  typical: the median position, without which growing
    positions while down can't be told."""
    net, first = F.col("net").cast("double"), F.col("index") == 0
    return {
        "revenge": (F.when(~first, F.col("prev_loss") & (F.col("minutes_since_exit") <= REVENGE_MINUTES)), net),
        "overtrading": (F.col("index") >= OVERTRADING_INDEX, net),
        "while_down": (F.col("pnl_before") < 0, net),
        "after_losing_streak": (F.col("losses_before") >= 2, net),
        "first_of_session": (first, net),
        "holding_losers": (F.when(F.col("net") != 0, F.col("net") < 0), F.col("duration").cast("double")),
    } | ({} if typical is None else {"size_escalation": ((F.col("pnl_before") < 0) & (F.col(size) > typical), net)})


def typical_size(state: DataFrame, size: str = "qty_opened") -> float | None:
    """The sample's median position, an aggregate of one row; None where positions aren't known."""
    if size not in state.columns:
        return None
    return state.agg(F.median(F.col(size).cast("double"))).first()[0]


def behaviours(state: DataFrame) -> DataFrame:
    """Per behaviour: number, mean and variance with and without it, the difference, and its cost in money."""
    found = detectors(typical_size(state))
    each = F.array(*(F.struct(F.lit(k).alias("behaviour"), p.alias("present"), v.alias("value")) for k, (p, v) in found.items()))
    x = state.select(F.explode(each).alias("e")).select("e.*").filter("present is not null and value is not null")
    a = x.groupBy("behaviour").agg(*(f(F.when(F.col("present") == F.lit(b), F.col("value"))).alias(f"{n}_{s}") for b, s in ((True, "with"), (False, "without")) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    diff = F.col("mean_with") - F.col("mean_without")
    return a.withColumn("difference", diff).withColumn("cost", F.when(F.col("behaviour") != "holding_losers", diff * F.col("n_with")))


def benjamini_hochberg(tests: DataFrame, p: str, *family: str, **chunks: int) -> DataFrame:
    """Adds q: p times family size over rank, made monotonous from the largest down, 1 at most; NULL stays NULL.

    Ranks and the minimum from above are running values in two levels, so one family of all tests is no single task."""
    some = tests.filter(F.col(p).isNotNull())
    ranked = scan.running(some, list(family), [p], {"_r": ("count", F.lit(1))}, **chunks)
    if family:
        sizes = some.groupBy(*family).agg(F.count("*").alias("_m")).select(*(F.col(c).alias(f"_f{i}") for i, c in enumerate(family)), "_m")
        same = F.lit(True)
        for i, c in enumerate(family):
            same = same & F.col(c).eqNullSafe(F.col(f"_f{i}"))
        ranked = ranked.join(sizes, same).drop(*(f"_f{i}" for i in range(len(family))))
    else:
        ranked = ranked.crossJoin(some.agg(F.count("*").alias("_m")))  # one row
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_r")).withColumn("_from", -F.col("_r"))
    out = scan.running(raw, list(family), ["_from"], {"q": ("min", F.col("_raw"))}, **chunks)
    out = out.withColumn("q", F.least(F.lit(1.0), "q")).select(*tests.columns, "q")
    return out.unionByName(tests.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def impact(outcomes: DataFrame) -> DataFrame:
    """Per rule: mean P&L where it was kept and broken and what breaking it cost; unevaluable ones left out."""
    x = F.col("net").cast("double")
    a = outcomes.filter("passed is not null").groupBy("rule").agg(F.count_if("passed").alias("n_kept"), F.count_if(~F.col("passed")).alias("n_broken"), F.avg(F.when(F.col("passed"), x)).alias("mean_kept"), F.avg(F.when(~F.col("passed"), x)).alias("mean_broken"))
    return a.withColumn("cost", (F.col("mean_broken") - F.col("mean_kept")) * F.col("n_broken")).withColumn("broken_share", ratio(F.col("n_broken"), F.col("n_broken") + F.col("n_kept")))
