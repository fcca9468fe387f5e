"""Models in force: training leaves append-only rows, and a trade is scored by the one that stood when it was opened.

A head is a name, its features and its label.  At the first session of each fold a model of all sessions before is fitted, and what earlier
models said of the trades that they hadn't seen decides whether it may be served; its row keeps the coefficients, the scales behind them and
the first reason against serving.  Scoring never looks at a later model, and says nothing where none is deployable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models as M
from .bars import as_of

# Trades that must have been scored out of sample, and the skill that must be exceeded.
SCORED, SKILL = M.SERVED, 0.0
FEW, NO_SKILL = "too few scored trades", "no skill"
ROWS = (
    "head string, trained_at date, fold int, features array<string>, beta array<double>, penalty double, trained long, skipped long, "
    "scored long, skill double, reason string, deployable boolean"
)
#: Days up to which a table of one row a day is broadcast: some thousand years.
BROADCAST_DAYS = 400_000


def design(rows: DataFrame, columns: list[str], label: str, session: str = "session_date") -> tuple[DataFrame, DataFrame]:
    """The complete rows, and by session how many there are (``complete``) and how many lack a feature or the label (``skipped``)."""
    whole = F.lit(True)
    for c in (*columns, label):
        whole = whole & F.col(c).isNotNull()
    counts = rows.groupBy(session).agg(F.count_if(whole).alias("complete"), F.count_if(~whole).alias("skipped"))
    return rows.filter(whole), counts


def gated(scored: int, error: float, base: float) -> tuple[float | None, str | None]:
    """Skill against the mean that was known at the time, and the first reason against serving."""
    skill = 1 - error / base if scored >= 2 and base > 1e-12 else None
    return skill, FEW if scored < SCORED else NO_SKILL if skill is None or skill <= SKILL else None


def train(rows: DataFrame, head: str, columns: list[str], label: str, session: str = "session_date", first: int = M.MODEL_FOLDS[0], step: int = M.MODEL_FOLDS[1]) -> DataFrame:
    """Model rows of a head, one a fold and a last one of all sessions (trained_at: the day after the last session); none without
    enough sessions.  Append them to a table: later runs add rows, and rows don't change."""
    spark = rows.sparkSession
    rows = rows.filter(F.col(session).isNotNull())
    full, counts = design(rows, columns, label, session)
    per = dict(M.moments(full, columns, label, session))
    lost = {r[session]: r["skipped"] for r in counts.collect()}  # one row a day
    days = [(d, f) for d, _, f in M.calendar(rows, session, first, step)]
    if len(days) < first + 1:
        return spark.createDataFrame([], ROWS)
    last = max(f for _, f in days) + 1
    begins = {}
    for d, f in days:
        begins.setdefault(f, d)
    made = M.fold_models([*days, (None, last)], per, len(columns) + 1)
    table = spark.createDataFrame([(m["fold"], m["beta"], m["mean"]) for m in made], "_fold int, beta array<double>, mean double")
    dates = spark.createDataFrame([(d, f) for d, f in days if f], f"_day {rows.schema[session].dataType.simpleString()}, _fold int")
    seen = full.join(F.broadcast(dates), F.col(session) == F.col("_day")).join(F.broadcast(table), "_fold")  # one row a day, one a fold
    y, off = F.col(label).cast("double"), F.col(label).cast("double") - M.linear(columns)
    sums = seen.groupBy("_fold").agg(F.count("*").alias("n"), F.sum(off * off).alias("e"), F.sum((y - F.col("mean")) * (y - F.col("mean"))).alias("b"))
    tested = {r["_fold"]: r for r in sums.collect()}  # one row a fold
    out, scored, error, base = [], 0, 0.0, 0.0
    skipped, at = 0, 0
    for m in made:
        for f in range(1, m["fold"]):
            if (r := tested.pop(f, None)) is not None:
                scored, error, base = scored + r["n"], error + r["e"], base + r["b"]
        while at < len(days) and days[at][1] < m["fold"]:
            skipped, at = skipped + lost.get(days[at][0], 0), at + 1
        skill, reason = gated(scored, error, base)
        out.append((head, begins.get(m["fold"]), m["fold"], columns, m["beta"], m["penalty"], m["rows"], skipped, scored, skill, reason, reason is None))
    end = F.date_add(F.lit(days[-1][0]).cast("date"), 1)
    return spark.createDataFrame(out, ROWS).withColumn("trained_at", F.coalesce("trained_at", end))


def serve(trades: DataFrame, models: DataFrame, head: str, columns: list[str], session: str = "session_date") -> DataFrame:
    """Trades with predicted, trained_at and reason of the head's model in force in their session: the last one trained by then.

    predicted is NULL unless that model is deployable and the trade has all features; trades before the first model have no model.
    Models and sessions meet as-of on a row a day, then trades join their day.
    """
    own = models.filter(F.col("head") == head).withColumn("_at", F.col("trained_at").cast("timestamp")).withColumn("_model", F.struct("trained_at", "beta", "reason", "deployable"))
    days = trades.select(session).distinct().filter(F.col(session).isNotNull()).select(F.col(session).alias("_day"), F.lit(head).alias("head"), F.col(session).cast("timestamp").alias("_ts"))
    force = as_of(days, own.select("head", "_at", "_model"), "head", "_ts", "_at", "_model").select("_day", "_model")  # one row a day
    force = F.broadcast(force) if trades.select(session).distinct().count() <= BROADCAST_DAYS else force
    out = trades.join(force, F.col(session) == F.col("_day"), "left")
    said = M.linear(columns, "_model.beta")
    return out.withColumns({
        "predicted": F.when(F.col("_model.deployable"), said), "trained_at": F.col("_model.trained_at"), "reason": F.col("_model.reason"),
    }).drop("_day", "_model")
