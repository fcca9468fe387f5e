"""Further statistics of closed trades: edge and capture, streak states, daily drawdown, scores, and segments with their tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import MIN_RELIABLE, MIN_SAMPLE, duration_bucket, ratio, reliability
from . import scan
from .resample import bootstrap_mean, entry, intervals, permutation_tests, poisson, weighed_sums
from .sequences import benjamini_hochberg
from .stats import MIN_DAYS, TRADING_DAYS, daily, equity_curve

ALPHA = 0.05
#: Streaks from here on count as one state.
LONGEST = 3


def edge_ratio(trades: DataFrame, *by: str) -> DataFrame:
    """Mean favourable over mean adverse excursion in R; NULL without a mean adverse one.  n: of the fewer known ones."""
    a = trades.groupBy(*by).agg(F.avg("mfe_r").alias("mfe"), F.avg("mae_r").alias("mae"), F.least(F.count("mfe_r"), F.count("mae_r")).alias("n"))
    return a.select(*by, "n", ratio(F.col("mfe"), F.col("mae")).alias("edge_ratio"))


def max_daily_drawdown(trades: DataFrame, *by: str) -> DataFrame:
    """The greatest fall of the daily equity under its peak (from 0), as a magnitude, and the days it's taken over."""
    order = W.partitionBy(*by).orderBy("session_date").rowsBetween(W.unboundedPreceding, 0)
    d = daily(trades, *by).withColumn("equity", F.sum("net").over(order))
    d = d.withColumn("peak", F.greatest(F.lit(0), F.max("equity").over(order)))
    return d.groupBy(*by).agg(F.count("*").alias("days"), F.max(F.col("peak") - F.col("equity")).alias("max_daily_drawdown"))


def mar(trades: DataFrame, equity: float, *by: str) -> DataFrame:
    """Annual return over the deepest drawdown by trades, both in parts of ``equity``; NULL under MIN_DAYS days or without one."""
    days = daily(trades, *by).groupBy(*by).agg(F.count("*").alias("days"), F.sum("net").alias("net"))
    deep = equity_curve(trades, *by).groupBy(*by).agg((-F.min("drawdown")).alias("depth"))
    year = ratio(F.col("net"), F.lit(equity)) / (F.col("days") / TRADING_DAYS)
    good = (F.col("days") >= MIN_DAYS) & (F.col("depth") > 0) & F.lit(equity > 0)
    return days.join(deep, list(by)).select(*by, "days", F.when(good, year / ratio(F.col("depth"), F.lit(equity))).alias("mar"))


def streak_states(trades: DataFrame, *by: str) -> DataFrame:
    """(state, streak, n, expectancy, degradation): the mean result by the run of wins or losses before a trade.

    Trades stand in the order of closing.  Scratches are trades of a state, but neither lengthen nor end a run; LONGEST and
    more are one streak.  degradation: the mean less that of all trades.
    """
    order = W.partitionBy(*by).orderBy("closed_at", "opened_at", "trade_id")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    x = F.col("net").cast("double")
    t = trades.filter("closed_at is not null").withColumn("_won", F.when(F.col("net") != 0, F.col("net") > 0))
    # a decided trade starts a run where the decided one before it went the other way
    t = t.withColumn("_last", F.last("_won", ignorenulls=True).over(before))
    starts = (F.col("_won").isNotNull() & (F.col("_last").isNull() | (F.col("_won") != F.col("_last")))).cast("int")
    t = t.withColumn("_run", F.sum(starts).over(order.rowsBetween(W.unboundedPreceding, 0)))
    length = F.sum(F.col("_won").isNotNull().cast("int")).over(W.partitionBy(*by, "_run").orderBy("closed_at", "opened_at", "trade_id").rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("_len", F.when(F.col("_won").isNotNull(), length)).withColumn("_before", F.last("_len", ignorenulls=True).over(before))
    t = t.withColumn("_streak", F.when(F.col("_before").isNotNull(), F.least("_before", F.lit(LONGEST))))
    base = t.groupBy(*by).agg(F.avg(x).alias("_base"))
    state = F.when(F.col("_last"), "after_wins").otherwise("after_losses").alias("state")
    s = t.filter("_streak is not null").groupBy(*by, state, F.col("_streak").alias("streak")).agg(F.count("*").alias("n"), F.avg(x).alias("expectancy"))
    return s.join(base, list(by)).withColumn("degradation", F.col("expectancy") - F.col("_base")).withColumn("reliability", reliability(F.col("n"))).drop("_base")


def capture(trades: DataFrame, group: str, replicates: int = 10_000) -> DataFrame:
    """Of winners with a favourable excursion: mean excursion, mean result and mean share of it in R, the share's interval, and
    what was left.  An estimate, never a test."""
    t = trades.filter("net > 0 and mfe_r > 0 and r_multiple is not null").withColumn("share", ratio(F.col("r_multiple"), F.col("mfe_r")))
    a = t.groupBy(group).agg(F.avg("mfe_r").alias("mean_mfe_r"), F.avg("r_multiple").alias("mean_captured_r"))
    ci = bootstrap_mean(t, "share", group, replicates).select(group, F.col("n").alias("winners"), F.col("mean").alias("capture"), "low", "high")
    return ci.join(a, group).withColumn("forgone_r", F.col("mean_mfe_r") - F.col("mean_captured_r"))


def scores(predictions: DataFrame, *by: str) -> DataFrame:
    """Brier score and log loss of (predicted, actual 0 or 1); the latter NULL if any prediction isn't within (0, 1)."""
    p, y = F.col("predicted").cast("double"), F.col("actual").cast("double")
    inside = (p > 0) & (p < 1)
    loss = -F.when(inside, y * F.log(p) + (1 - y) * F.log(1 - p))
    a = predictions.groupBy(*by).agg(F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("_loss"), F.count_if(~inside).alias("_out"))
    return a.withColumn("log_loss", F.when(F.col("_out") == 0, F.col("_loss"))).drop("_loss", "_out")


def segment_dimensions() -> dict[str, Column]:
    """The ten single dimensions; NULL keeps a trade out of a dimension."""
    return {
        "hour_of_day": F.lpad(F.col("entry_hour").cast("string"), 2, "0"), "weekday": F.col("entry_weekday").cast("string"), "month": F.date_format("session_date", "yyyy-MM"),
        "session_segment": F.col("segment"), "direction": F.col("direction"), "instrument": F.col("instrument"), "strategy": F.col("strategy"), "setup": F.col("setup"),
        "market_condition": F.col("market_condition"), "duration_bucket": duration_bucket(F.col("duration")),
    }


def segments(trades: DataFrame, dims: dict[str, Column] | None = None, replicates: int = 2000, permutations: int = 1000) -> DataFrame:
    """Per dimension and key: number, net, expectancy with its interval, p against all other trades, q within the dimension
    and whether it is actionable: reliable, with an interval beyond zero and q under ALPHA.

    Dimensions are a fixed few, each tested by one draw of labels for all its keys.
    """
    dims = dims or segment_dimensions()
    # read several times: written once, so that trades aren't reconstructed again each
    rows = scan.written(trades.select("trade_id", "net", F.array(*(F.struct(F.lit(d).alias("dimension"), c.alias("key"), F.concat_ws("|", F.lit(d), c).alias("slice")) for d, c in dims.items())).alias("d")))
    t = rows.select("net", F.explode("d").alias("d")).select("net", "d.*").filter("key is not null")
    sums = t.groupBy("slice", "dimension", "key").agg(F.count_if(F.col("net") > 0).alias("winners"), F.sum("net").alias("net"))
    terms = lambda x: {"s": x.cast("double"), "w": F.lit(1.0)}
    with_net = t.filter("net is not null")
    whole = with_net.groupBy(F.col("slice").alias("g")).agg(F.count("*").alias("_n"), *(F.sum(c).alias(k) for k, c in terms(F.col("net")).items()))
    own = F.transform(F.filter("d", lambda x: x["key"].isNotNull()), lambda x: entry(x["slice"], terms(F.col("net"))))
    reps = weighed_sums(rows.filter("net is not null"), own, ["s", "w"], "boot", replicates, poisson)  # one hash serves all slices
    ci = intervals(whole, reps, "try_divide(s, w)", "slice", replicates).select("slice", "n", F.col("value").alias("expectancy"), "low", "high", "reliability")
    tests = permutation_tests(rows, "net", {d: F.col("d")[i]["key"] for i, d in enumerate(dims)}, permutations).select(F.concat_ws("|", "label", "key").alias("slice"), "p")
    out = benjamini_hochberg(sums.join(ci, "slice").join(tests, "slice", "left"), "p", "dimension").drop("slice")
    return out.withColumn("actionable", actionable(F.col("n"), F.col("low"), F.col("high"), F.col("q")))


def actionable(n: Column, low: Column, high: Column, q: Column) -> Column:
    """The strict bar: reliable, an interval that excludes zero, q under ALPHA."""
    return F.coalesce((n >= MIN_RELIABLE) & ((low > 0) | (high < 0)) & (q < ALPHA), F.lit(False))


def actionable_behaviour(n_with: Column, n_without: Column, q: Column) -> Column:
    """The weaker bar: enough trades on both sides, q under ALPHA."""
    return F.coalesce((F.least(n_with, n_without) >= MIN_SAMPLE) & (q < ALPHA), F.lit(False))


def top_segments(found: DataFrame, most: int = 3) -> DataFrame:
    """The first actionable segments of each dimension by key, as evidence cites them."""
    r = F.row_number().over(W.partitionBy("dimension").orderBy("key"))
    return found.filter("actionable").withColumn("rank", r).filter(F.col("rank") <= most)


def best_and_worst(found: DataFrame) -> DataFrame:
    """Per dimension the keys of best and worst expectancy among reliable segments."""
    good = found.filter(F.col("n") >= MIN_RELIABLE)
    return good.groupBy("dimension").agg(F.max_by("key", F.struct("expectancy", "key")).alias("best"), F.min_by("key", F.struct("expectancy", "key")).alias("worst"))


def annual_factor(trades: DataFrame, *by: str) -> DataFrame:
    """365 over the span in days, first and last session included; NULL with one session or a span under 30 days."""
    a = trades.groupBy(*by).agg((F.datediff(F.max("session_date"), F.min("session_date")) + 1).alias("span"), F.count_distinct("session_date").alias("days"))
    return a.select(*by, "span", F.when((F.col("days") >= 2) & (F.col("span") >= 30), ratio(F.lit(365.0), F.col("span"))).alias("factor"))
