"""The report store: immutable rows in a versioned table, and what schedulers and readers ask of it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import Store

TABLE = "reports"
#: Type, status and period; findings and evidence as JSON, as they were when the report was made.
SCHEMA = "account long, report_type string, status string, period_start date, period_end date, headline string, findings string, evidence string, generated_at timestamp"


def save(store: Store, reports: DataFrame) -> int:
    """Appends reports.  Those of an (account, type, period) that has one already are left out: a record doesn't change."""
    base = store.version()
    key = ["account", "report_type", "period_start"]
    have = store.read(TABLE, SCHEMA, base).select(*(F.col(k).alias(f"_{k}") for k in key))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    once = reports.select(names).groupBy(*key).agg(F.min_by(F.struct(names), F.struct("generated_at", "headline")).alias("r")).select("r.*")
    return store.commit(append={TABLE: once.join(have, same, "left_anti").select(names)}, base=base)


def session_bounds(trades: DataFrame, by: str = "account") -> DataFrame:
    """(account, first, last): the sessions between which reports make sense."""
    return trades.filter("session_date is not null").groupBy(by).agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))


def existing_periods(reports: DataFrame, by: str = "account") -> DataFrame:
    """(account, report_type, period_start) that have a report: what the scheduler leaves out."""
    return reports.select(by, "report_type", "period_start").distinct()


def latest(reports: DataFrame, by: str = "account") -> DataFrame:
    """Each account's newest report of each type, by period and then by when it was made."""
    own = [c for c in reports.columns if c not in (by, "report_type")]
    newest = F.max_by(F.struct(*own), F.struct("period_start", "generated_at")).alias("r")
    return reports.groupBy(by, "report_type").agg(newest).select(by, "report_type", "r.*")


def listing(reports: DataFrame, account: int | None = None, report_type: str | None = None, limit: int = 50) -> DataFrame:
    """Newest periods first, without findings and evidence."""
    r = reports if account is None else reports.filter(F.col("account") == account)
    r = r if report_type is None else r.filter(F.col("report_type") == report_type)
    return r.drop("findings", "evidence").orderBy(F.desc("period_start"), F.desc("generated_at"), "account", "report_type").limit(limit)


def missing(bounds: DataFrame, existing: DataFrame, today: date, by: str = "account") -> DataFrame:
    """(account, period_start) of whole months inside the bounds that have no monthly report, up to ``today``."""
    first = F.trunc("first", "month")
    last = F.least(F.trunc("last", "month"), F.add_months(F.trunc(F.lit(today), "month"), -1))
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    due = bounds.select(by, F.explode(months).alias("period_start"))
    return due.join(existing.filter("report_type = 'monthly'").select(by, "period_start"), [by, "period_start"], "left_anti")
