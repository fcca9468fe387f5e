"""Counterfactual scenarios: which trades a plan would have taken, at what result, and whether the change is established."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import MIN_RELIABLE, MIN_SAMPLE, ratio, reliability
from . import scan
from .resample import replicate_sums, two_tails
from .sequences import benjamini_hochberg

# The default sweep, the most scenarios of a custom one, least coverage, significance.
SCENARIOS = [
    {"name": "Take profit at 1R", "target_r": 1.0},
    {"name": "Take profit at 2R", "target_r": 2.0},
    {"name": "Take profit at 3R", "target_r": 3.0},
    {"name": "Tighten the stop to 0.5R", "stop_r": 0.5},
    {"name": "Widen the stop to 1.5R", "stop_r": 1.5},
    {"name": "Stop at 1R, target at 2R", "stop_r": 1.0, "target_r": 2.0},
    {"name": "At most 3 trades a session", "max_trades": 3},
    {"name": "At most 6 trades a session", "max_trades": 6},
    {"name": "Stop after 2 consecutive losses", "after_losses": 2},
]
MOST, COVERAGE, ALPHA = 12, 0.5, 0.05
FIELDS = {"stop_r": "double", "target_r": "double", "max_trades": "int", "after_losses": "int", "hours": "array<int>"}


def _exits(s: dict) -> bool:
    return s.get("stop_r") is not None or s.get("target_r") is not None


def _filters(s: dict) -> bool:
    return any(s.get(k) is not None for k in ("max_trades", "after_losses", "hours"))


def _alone(s: dict) -> tuple[Column, Column]:
    """What a scenario makes of a trade by itself: kind (unchanged, repriced, inapplicable) and result."""
    net = F.col("net").cast("double")
    if not _exits(s):
        return F.lit("unchanged"), net
    stop, target = _literal(s.get("stop_r"), FIELDS["stop_r"]), _literal(s.get("target_r"), FIELDS["target_r"])
    known = F.col("r_multiple").isNotNull() & (F.col("r_multiple") != 0) & F.col("mae_r").isNotNull() & F.col("mfe_r").isNotNull()
    stopped, reached = F.coalesce(F.col("mae_r") >= stop, F.lit(False)), F.coalesce(F.col("mfe_r") >= target, F.lit(False))
    level = F.when(stopped, -stop).when(reached, target)
    priced = F.rint(level * ratio(F.col("net"), F.col("r_multiple")) * 100) / 100
    kind = F.when(~known, "inapplicable").when(level.isNotNull(), "repriced").otherwise("unchanged")
    return kind, F.when(known, F.when(level.isNotNull(), priced).otherwise(net))


def _skipped(trades: DataFrame, scenarios: list[dict], *by: str) -> DataFrame:
    """Trades with ``_skip<i>`` for each scenario that filters: windows of all scenarios over one order of the trades."""
    order = W.partitionBy(*by, "session_date").orderBy("opened_at", "trade_id")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    of = {i: s for i, s in enumerate(scenarios) if _filters(s)}
    in_ = {i: F.lit(True) if s.get("hours") is None else F.coalesce(F.array_contains(_literal(s["hours"], FIELDS["hours"]), F.col("entry_hour")), F.lit(False)) for i, s in of.items()}
    streaks = [i for i, s in of.items() if s.get("after_losses") is not None]
    where = lambda i, c: F.coalesce(in_[i] & c, F.lit(False))
    t = trades.withColumns({f"_n{i}": F.count_if(in_[i]).over(before) for i, s in of.items() if s.get("max_trades") is not None} | {f"_l{i}": F.count_if(where(i, _alone(of[i])[1] < 0)).over(before) for i in streaks})
    # losses in a row are those since the last win, or all
    t = t.withColumns({f"_w{i}": F.coalesce(F.max(F.when(where(i, _alone(of[i])[1] > 0), F.col(f"_l{i}"))).over(before), F.lit(0)) for i in streaks})
    ended = {}
    for i, s in of.items():
        over = F.lit(False)
        if s.get("max_trades") is not None:
            over = over | (F.col(f"_n{i}") >= _literal(s["max_trades"], FIELDS["max_trades"]))
        if i in streaks:
            over = over | (F.col(f"_l{i}") - F.col(f"_w{i}") >= _literal(s["after_losses"], FIELDS["after_losses"]))
        ended[f"_skip{i}"] = ~in_[i] | F.max(in_[i] & over).over(upto)
    return t.withColumns(ended).select(*trades.columns, *ended)


def _results(scenarios: list[dict]) -> list[tuple[Column, Column, Column]]:
    """Outcome, simulated and delta of each scenario over _skipped()."""
    out, net = [], F.col("net").cast("double")
    for i, s in enumerate(scenarios):
        kind, sim = _alone(s)
        skip = F.col(f"_skip{i}") if _filters(s) else F.lit(False)
        out.append((F.when(skip, "skipped").otherwise(kind), F.when(~skip, sim), F.when(skip, -net).otherwise(sim - net)))
    return out


def simulate(trades: DataFrame, scenarios: list[dict], *by: str) -> DataFrame:
    """A row for each trade and scenario: outcome (unchanged, repriced, skipped, inapplicable), simulated and delta.

    trades: (trade_id, session_date, opened_at, net, entry_hour, r_multiple, mae_r, mfe_r; excursions as magnitudes).  by:
    columns that part sequences, such as the account.  A scenario is a name with some of FIELDS.  With a stop or a target a
    trade is repriced where it went that far, the stop before the target; without R or excursions it's inapplicable.  In
    the order of opening, a trade is skipped once a session has its most trades, or as many losses in a row (scratches
    count for nothing) as end it, or outside the hours; a skipped trade changes nothing for later ones, so a session that
    has ended stays so, and windows find where that is.
    """
    t = _skipped(trades.select("trade_id", *by, "session_date", "opened_at", "net", "entry_hour", "r_multiple", "mae_r", "mfe_r"), scenarios, *by)
    each = [
        F.struct(F.lit(i).alias("i"), F.lit(s["name"]).alias("scenario"), outcome.alias("outcome"), simulated.alias("simulated"), delta.alias("delta"))
        for i, (s, (outcome, simulated, delta)) in enumerate(zip(scenarios, _results(scenarios)))
    ]
    t = t.select("trade_id", *by, "session_date", "net", F.explode(F.array(*each)).alias("s"))
    return t.select("s.i", "s.scenario", "trade_id", *by, "session_date", "net", "s.outcome", "s.simulated", "s.delta")


def _literal(value, kind: str):
    if value is None:
        return F.lit(None).cast(kind)
    return F.array(*map(F.lit, value)).cast(kind) if isinstance(value, list | tuple) else F.lit(value).cast(kind)


def what_if(trades: DataFrame, *by: str, max_trades: int | None = None, stop_after_losses: int | None = None, hours: list[int] | None = None) -> DataFrame:
    """Which trades a plan without stops and targets would have taken: ``taken`` and ``delta`` beside the trade's columns."""
    plain = trades.withColumns({c: F.lit(None).cast("double") for c in ("r_multiple", "mae_r", "mfe_r") if c not in trades.columns})
    s = simulate(plain, [{"name": "plan", "max_trades": max_trades, "after_losses": stop_after_losses, "hours": hours}], *by)
    return trades.join(s.select("trade_id", (F.col("outcome") != "skipped").alias("taken"), "delta"), "trade_id")


def sweep(trades: DataFrame, *by: str, scenarios: list[dict] | None = None, replicates: int = 10_000) -> DataFrame:
    """A row for each scenario: how many trades of each outcome, coverage, P&L before and after, the mean change with its
    interval, p, q over all scenarios, and whether it is actionable: reliable, covering half of the trades, with an
    interval beyond zero and q under ALPHA.  All NULL tests under MIN_SAMPLE trades.

    One hash of a trade serves all scenarios: their deltas are the terms of one bootstrap.
    """
    scenarios = scenarios or SCENARIOS
    if len(scenarios) > max(MOST, len(SCENARIOS)):
        raise ValueError(f"at most {MOST} scenarios")
    kept = ["trade_id", "r_multiple", "mae_r", "mfe_r", *(f"_skip{i}" for i, s in enumerate(scenarios) if _filters(s))]
    # a row a trade, read twice: once for the totals, once for the draws
    t = scan.written(_skipped(trades, scenarios, *by).select(F.col("net").cast("double").alias("net"), *kept))
    results = _results(scenarios)
    numbers = ["n", "repriced", "unchanged", "skipped", "inapplicable", "baseline", "simulated", "mean_delta"]
    sums, terms, counted = [], {}, {}
    for i, (s, (outcome, simulated, delta)) in enumerate(zip(scenarios, results)):
        of = [F.count("*"), *(F.count_if(outcome == k) for k in numbers[1:5]), F.coalesce(F.sum(F.when(outcome != "inapplicable", F.col("net"))), F.lit(0.0)), F.coalesce(F.sum(simulated), F.lit(0.0)), F.avg(delta)]
        sums += [c.alias(f"{k}{i}") for k, c in zip(numbers, of)]
        # deltas are known of the same trades where scenarios filter alone, and where they price exits alone
        known = counted.setdefault((_exits(s), i if _exits(s) and _filters(s) else None), f"n{i}")
        terms |= {f"s{i}": delta} | ({known: delta.isNotNull().cast("double")} if known == f"n{i}" else {})
    number = dict(enumerate(counted[_exits(s), i if _exits(s) and _filters(s) else None] for i, s in enumerate(scenarios)))
    one = t.agg(*sums).select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s["name"]).alias("scenario"), *(F.col(f"{k}{i}").alias(k) for k in numbers)) for i, s in enumerate(scenarios)))).alias("e"))
    total = one.select("e.*")
    reps = replicate_sums(t.withColumn("g", F.lit(0)), terms, "g", "sweep", replicates)
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("s"), F.try_divide(f"s{i}", number[i]).alias("m")) for i in number))
    tails = reps.select(F.explode(each).alias("e")).select("e.*").groupBy("i").agg(
        F.count_if(F.col("s") <= 1e-9).alias("lo"), F.count_if(F.col("s") >= -1e-9).alias("hi"), F.percentile("m", [0.025, 0.975]).alias("p")
    )
    t = total.join(tails, "i")
    used = F.col("n") - F.col("inapplicable")
    enough = used >= MIN_SAMPLE
    t = t.withColumns({
        "coverage": ratio(used, F.col("n")), "difference": F.col("simulated") - F.col("baseline"), "low": F.when(enough, F.col("p")[0]), "high": F.when(enough, F.col("p")[1]),
        "p": F.when(enough, two_tails(F.col("lo"), F.col("hi"), replicates)), "evaluated": F.col("repriced") + F.col("unchanged"),
    }).drop("lo", "hi")
    # a row a scenario, which the ranks read more than once
    t = benjamini_hochberg(scan.written(t), "p").withColumn("reliability", reliability(F.col("evaluated")))
    apart = (F.col("low") > 0) | (F.col("high") < 0)
    good = (F.col("evaluated") >= MIN_RELIABLE) & (F.col("coverage") >= COVERAGE) & apart & (F.col("q") < ALPHA)
    return t.withColumn("actionable", F.coalesce(good, F.lit(False)))


def recommendation(swept: DataFrame) -> DataFrame:
    """One row: the actionable scenario of the greatest improvement, or the plain reason why there is none."""
    good = F.col("actionable") & (F.col("difference") > 0)
    best = F.max_by(F.struct("scenario", "difference", "q"), F.when(good, F.struct("difference", (-F.col("i")).alias("i"))))
    one = swept.agg(F.count("*").alias("tested"), F.count_if("actionable").alias("actionable"), F.max("n").alias("n"), F.count_if(F.col("coverage") < COVERAGE).alias("thin"), best.alias("b"))
    why = F.when(F.col("b").isNotNull(), None).when(F.coalesce("n", F.lit(0)) < MIN_SAMPLE, "too few trades").when(F.col("thin") == F.col("tested"), "too little coverage").otherwise("no established improvement")
    return one.select("tested", "actionable", "thin", F.col("b.scenario").alias("best"), F.col("b.difference").alias("difference"), F.col("b.q").alias("q"), why.alias("reason"))
