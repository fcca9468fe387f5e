"""Performance, drawdown, streak and risk statistics of closed trades, grouped by any columns in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import duration_bucket, ratio, reliability
from . import scan

TRADING_DAYS, MIN_DAYS, SQN_CAP = 252, 20, 100


def _when(c: Column, x: Column) -> Column:
    return F.when(c, x)


def summary(trades: DataFrame, *by: str) -> DataFrame:
    """Counts, P&L, ratios and distribution of net P&L per group in one aggregation."""
    net, r = F.col("net"), F.col("r_multiple")
    win, loss = net > 0, net < 0
    x = net.cast("double")
    a = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(win).alias("winners"), F.count_if(loss).alias("losers"), F.count_if(net == 0).alias("scratches"),
        F.sum(net).alias("net"), F.sum("gross").alias("gross"), F.sum("costs").alias("costs"), F.coalesce(F.sum(_when(win, net)), F.lit(0)).alias("gross_profit"), F.coalesce(-F.sum(_when(loss, net)), F.lit(0)).alias("gross_loss"),
        F.max(_when(win, net)).alias("largest_win"), F.min(_when(loss, net)).alias("largest_loss"), F.avg(_when(win, x)).alias("avg_win"), F.avg(_when(loss, x)).alias("avg_loss"), F.median(_when(win, x)).alias("median_win"), F.median(_when(loss, x)).alias("median_loss"),
        F.avg(x).alias("expectancy"), F.avg(r).alias("expectancy_r"), F.count(r).alias("n_r"), F.stddev_samp(r).alias("sd_r"), F.median(x).alias("median"), F.stddev_samp(x).alias("stdev"), F.skewness(x).alias("_skew"), F.kurtosis(x).alias("_kurt"),
        F.percentile(x, [0.05, 0.25, 0.75, 0.95]).alias("_p"), F.avg("duration").alias("hold"), F.avg(_when(win, F.col("duration"))).alias("hold_winners"), F.avg(_when(loss, F.col("duration"))).alias("hold_losers"),
    )
    n = F.col("n").cast("double")
    spread = F.col("stdev") > 0
    decided = F.col("winners") + F.col("losers")
    return a.withColumns({
        "reliability": reliability(F.col("n")), "win_rate": ratio(F.col("winners"), decided), "profit_factor": ratio(F.col("gross_profit"), F.col("gross_loss")), "payoff": ratio(F.col("avg_win"), F.abs("avg_loss")),
        "cost_ratio": ratio(F.col("costs"), F.col("gross_profit")), "sqn": F.when((F.col("n_r") >= 2) & (F.col("sd_r") > 0), F.sqrt(F.least("n_r", F.lit(SQN_CAP))) * F.col("expectancy_r") / F.col("sd_r")),
        "skew": F.when((F.col("n") >= 3) & spread, F.col("_skew") * F.sqrt(n * (n - 1)) / (n - 2)), "kurtosis": F.when((F.col("n") >= 4) & spread, F.col("_kurt")),
        "p5": F.col("_p")[0], "p25": F.col("_p")[1], "p75": F.col("_p")[2], "p95": F.col("_p")[3],
    }).drop("_skew", "_kurt", "_p")


def daily(trades: DataFrame, *by: str) -> DataFrame:
    return trades.filter("session_date is not null").groupBy(*by, "session_date").agg(F.sum("net").alias("net"))


def risk_adjusted(trades: DataFrame, *by: str, equity: float | None = None, risk_free: float = 0.0) -> DataFrame:
    """Sharpe and Sortino of daily results (of returns if equity is given), NULL under MIN_DAYS days or without spread."""
    x = F.col("net").cast("double") / (equity if equity else 1.0) - risk_free / TRADING_DAYS
    a = daily(trades, *by).groupBy(*by).agg(F.count("*").alias("days"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.sum(F.when(x < 0, x * x).otherwise(0.0)).alias("below"))
    year = float(TRADING_DAYS) ** 0.5
    down = F.sqrt(F.col("below") / (F.col("days") - 1))
    enough = F.col("days") >= MIN_DAYS
    return a.select(*by, "days", F.when(enough & (F.col("sd") > 0), F.col("mean") / F.col("sd") * year).alias("sharpe"), F.when(enough & (F.col("below") > 0), F.col("mean") / down * year).alias("sortino"))


def kelly(trades: DataFrame, *by: str) -> DataFrame:
    """Kelly fraction W - (1 - W) / payoff, its half, its warnings and, where it is undefined, the reason."""
    s = summary(trades, *by)
    k = F.col("win_rate") - (1 - F.col("win_rate")) / F.col("payoff")
    reason = F.when(F.col("winners") + F.col("losers") == 0, "no decided trades").when(F.col("winners") == 0, "no winners").when(F.col("losers") == 0, "no losers")
    return s.select(*by, "n", F.when(reason.isNull(), k).alias("kelly"), reason.alias("reason")).withColumn("half_kelly", F.col("kelly") / 2).withColumn(
        "warnings", F.concat_ws(",", F.when(F.col("n") < 100, "small sample"), F.when(F.col("kelly") > 0.25, "aggressive"), F.when(F.col("kelly") <= 0, "no edge"))
    )


def equity_curve(trades: DataFrame, *by: str, **chunks: int) -> DataFrame:
    """Running net, peak (from 0), drawdown (<= 0) and running R, NULL for good after the first NULL R."""
    order = ["closed_at", "opened_at", "trade_id"]
    sums = {
        "i": ("count", F.lit(1)), "cum_net": ("sum", F.col("net")), "_no_r": ("sum", F.col("r_multiple").isNull().cast("long")), "cum_r": ("sum", F.col("r_multiple")),
    }
    t = scan.running(trades.select(*by, "trade_id", "opened_at", "closed_at", "net", "r_multiple"), list(by), order, sums, **chunks)
    t = scan.running(t.withColumn("cum_r", F.when(F.col("_no_r") == 0, F.col("cum_r"))).drop("_no_r"), list(by), order, {"peak": ("max", F.col("cum_net"))}, **chunks)
    return t.withColumn("peak", F.greatest(F.lit(0), "peak")).withColumn("drawdown", F.col("cum_net") - F.col("peak"))


def drawdown_periods(curve: DataFrame, *by: str, **chunks: int) -> DataFrame:
    """Maximal runs under the peak: first and last place, depth, place of the trough, place of recovery or NULL."""
    t = curve.withColumn("under", F.col("drawdown") < 0)
    t = scan.running(t, list(by), ["i"], {"run": ("sum", (~F.col("under")).cast("long"))}, **chunks)
    # the row behind a run is the first of the next number, so only runs of a key's last number may be unrecovered
    runs = t.groupBy(*by, "run").agg(
        F.min(F.when(F.col("under"), F.col("i"))).alias("first_i"), F.max(F.when(F.col("under"), F.col("i"))).alias("last_i"), F.min("drawdown").alias("depth"),
        F.min(F.when(F.col("under"), F.struct("drawdown", "i"))).alias("_t"), F.max("i").alias("_end"),
    )
    ends = runs.groupBy(*by).agg(F.max("_end").alias("_last"))
    p = runs.filter("first_i is not null").join(ends, list(by)) if by else runs.filter("first_i is not null").crossJoin(ends)  # one row
    recovered = F.when(F.col("last_i") < F.col("_last"), F.col("last_i") + 1)
    return p.select(*by, "first_i", "last_i", "depth", F.col("_t.i").alias("trough_i"), recovered.alias("recovered_i"))


def drawdown_summary(trades: DataFrame, *by: str, **chunks: int) -> DataFrame:
    """Deepest and mean drawdown, how many, share of trades under the peak, the current one, and net over the deepest."""
    curve = equity_curve(trades, *by, **chunks)
    p = drawdown_periods(curve, *by, **chunks).groupBy(*by).agg(F.count("*").alias("periods"), F.min("depth").alias("deepest"), F.avg(F.col("depth").cast("double")).alias("mean_depth"), F.max(F.col("last_i") - F.col("first_i") + 1).alias("longest"))
    c = curve.groupBy(*by).agg(F.avg((F.col("drawdown") < 0).cast("double")).alias("underwater"), F.max_by("drawdown", "i").alias("current"), F.max_by("cum_net", "i").alias("net"))
    return c.join(p, list(by), "left").withColumn("recovery_factor", ratio(F.col("net"), -F.col("deepest")))


def streaks(trades: DataFrame, *by: str, **chunks: int) -> DataFrame:
    """Longest and mean runs of wins and losses and the current one (losses negative); scratches don't count."""
    order = ["closed_at", "opened_at", "trade_id"]
    t = trades.filter("net <> 0").withColumn("won", F.col("net") > 0).select(*by, *order, "won")
    t = scan.running(t, list(by), order, {"i": ("count", F.lit(1)), "_wins": ("sum", F.col("won").cast("long"))}, **chunks)
    # a run of wins has seen equally many losses, and a run of losses equally many wins
    t = t.withColumn("run", F.when(F.col("won"), F.col("i") - F.col("_wins")).otherwise(F.col("_wins")))
    runs = t.groupBy(*by, "won", "run").agg(F.count("*").alias("len"), F.max("i").alias("last_i"))
    won = F.col("won")
    return runs.groupBy(*by).agg(
        F.max(F.when(won, F.col("len"))).alias("longest_win"), F.max(F.when(~won, F.col("len"))).alias("longest_loss"), F.avg(F.when(won, F.col("len"))).alias("mean_win"),
        F.avg(F.when(~won, F.col("len"))).alias("mean_loss"), F.max_by(F.when(won, F.col("len")).otherwise(-F.col("len")), "last_i").alias("current"),
    )


def dimensions() -> dict[str, Column]:
    """Single dimensions of the segment cube; NULL keeps a trade out of a dimension."""
    return {
        "month": F.date_format("session_date", "yyyy-MM"), "weekday": (F.weekday("session_date") + 1).cast("string"), "direction": F.col("direction"), "instrument": F.col("instrument"),
        "duration_bucket": duration_bucket(F.col("duration")),
    }


def cube(trades: DataFrame, dims: dict[str, Column] | None = None) -> DataFrame:
    """Per dimension and key: counts, P&L, expectancy, and Cohen's d against all other trades (also those without a key).

    One aggregation over exploded keys; the rest of the sample is the totals less the segment, never a join of rows.
    """
    dims = dims or dimensions()
    x = F.col("net").cast("double")
    keys = F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("key")) for k, v in dims.items()))
    total = trades.agg(F.count("*").alias("tn"), F.sum("net").alias("tnet"), F.sum(x).alias("ts"), F.sum(x * x).alias("tq"))
    s = trades.select("net", F.explode(keys).alias("d")).filter("d.key is not null").groupBy("d.dimension", "d.key").agg(F.count("*").alias("n"), F.count_if(F.col("net") > 0).alias("winners"), F.sum("net").alias("net"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).withColumn("expectancy", ratio(F.col("net"), F.col("n")))
    j = s.crossJoin(F.broadcast(total))  # one row
    rn, rs, rq = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    pooled = (F.col("q") - F.col("s") ** 2 / F.col("n") + rq - rs**2 / rn) / (F.col("tn") - 2)
    d = F.when((F.col("n") >= 2) & (rn >= 2) & (pooled > 0), (F.col("expectancy") - rs / rn) / F.sqrt(pooled))
    return j.select("dimension", "key", "n", "winners", "net", "expectancy", ratio(F.col("tnet") - F.col("net"), rn).alias("rest_expectancy"), d.alias("cohens_d"), reliability(F.col("n")).alias("reliability"))
