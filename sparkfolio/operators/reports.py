"""Periods, comparisons and leak attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Least sessions of a report by type.
MIN_SESSIONS = {"daily": 1, "weekly": 3, "monthly": 8, "quarterly": 20, "yearly": 60}
UNITS = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


def due_periods(trades: DataFrame, today: str, generated: DataFrame | None = None) -> DataFrame:
    """(account, report_type, period_start, period_end, sessions): completed periods with sessions enough that no
    report covers yet.  generated: (account, report_type, period_start)."""
    days = trades.filter("session_date is not null").select("account", "session_date").distinct()
    each = F.array(F.struct(F.lit("daily").alias("report_type"), F.col("session_date").alias("period_start")), *(F.struct(F.lit(k).alias("report_type"), F.to_date(F.date_trunc(u, "session_date")).alias("period_start")) for k, u in UNITS.items()))
    p = days.select("account", F.explode(each).alias("e")).groupBy("account", "e.report_type", "e.period_start").agg(F.count("*").alias("sessions"))
    end = F.col("period_start")
    for k, step in (("weekly", "7 days"), ("monthly", "1 month"), ("quarterly", "3 months"), ("yearly", "1 year")):
        end = F.when(F.col("report_type") == k, F.expr(f"date_sub(cast(period_start + interval {step} as date), 1)")).otherwise(end)
    least = F.element_at(F.create_map(*(F.lit(x) for kv in MIN_SESSIONS.items() for x in kv)), F.col("report_type"))
    p = p.withColumn("period_end", end).filter((F.col("period_end") < F.to_date(F.lit(today))) & (F.col("sessions") >= least))
    return p if generated is None else p.join(generated, ["account", "report_type", "period_start"], "left_anti")


def next_reports(due: DataFrame, most: int = 25) -> DataFrame:
    """The oldest of the due periods, as many as one run builds."""
    return due.orderBy("period_end", "period_start", "account", "report_type").limit(most)


def compose(sections: dict[str, tuple[DataFrame, str]], sessions: int, report_type: str) -> DataFrame:
    """(section, key, value, reason): every number of a report, or one row with the reason for which a section is withheld.

    sections: name to (summary, the column that names its rows).
    """
    out = None
    for name, (summary, by) in sections.items():
        why = "too few sessions" if sessions < MIN_SESSIONS[report_type] else "nothing found" if summary.isEmpty() else None
        if why:
            part = summary.sparkSession.range(1).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
        else:
            part = evidence(summary, by).select("key", "value")
        part = part.select(F.lit(name).alias("section"), "key", "value", F.lit(why).cast("string").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def attribute_leaks(claims: DataFrame) -> DataFrame:
    """Per pattern: its naive cost and the exclusive one, when each trade counts for its largest claim only.

    claims: (pattern, cost, trade_id), one row a trade; a pattern's cost is shared evenly among its trades.
    """
    n = F.count("*").over(W.partitionBy("pattern"))
    c = claims.withColumn("share", F.col("cost") / n)
    best = W.partitionBy("trade_id").orderBy(F.abs("share").desc(), "pattern")
    c = c.withColumn("first", F.row_number().over(best) == 1)
    return c.groupBy("pattern").agg(F.sum("share").alias("naive"), F.sum(F.when(F.col("first"), F.col("share")).otherwise(0.0)).alias("exclusive"), F.count("*").alias("n_trades"), F.count_if("first").alias("n_exclusive"))


def ranked_leaks(attributed: DataFrame) -> DataFrame:
    """Attributions with ``place``: most negative exclusive cost first, as the money that no other leak claims is the first to save;
    unknown costs last, equal ones by name."""
    cost = F.when(F.col("naive").isNotNull(), F.col("exclusive"))
    return attributed.withColumn("exclusive", cost).withColumn("place", F.row_number().over(W.orderBy(F.col("exclusive").asc_nulls_last(), "pattern")))  # a row a pattern


# Compared means, least reported significance.
METRICS = {"net": "net", "win_rate": "cast(net > 0 as int)", "r_multiple": "r_multiple", "duration": "duration", "quantity": "quantity"}
ALPHA = 0.05


def compare_periods(trades: DataFrame, current: tuple[str, str], previous: tuple[str, str], permutations: int = 1000) -> DataFrame:
    """Per metric: both periods' means and numbers, p of a permutation test, q over the family, and the direction:
    up, down or flat only where q is at most ALPHA, else unchanged.

    Each permutation calls the first n rows of a hashed order the current period; metrics are tests of their own.
    """
    from .resample import two_sample
    from .sequences import benjamini_hochberg

    within = lambda p: F.col("session_date").between(F.to_date(F.lit(p[0])), F.to_date(F.lit(p[1])))
    t = trades.withColumn("now", F.when(within(current), True).when(within(previous), False)).filter("now is not null")
    each = F.array(*(F.struct(F.lit(k).alias("metric"), F.expr(e).cast("double").alias("x")) for k, e in METRICS.items()))
    v = t.select("trade_id", "now", F.explode(each).alias("e")).select("trade_id", "now", "e.metric", "e.x").filter("x is not null")
    tests = two_sample(v.withColumnRenamed("metric", "test"), "period", permutations).withColumnsRenamed({"test": "metric", "n_in": "n_current", "n_out": "n_previous", "mean_in": "current", "mean_out": "previous"})
    q = benjamini_hochberg(tests, "p")
    diff = F.col("current") - F.col("previous")
    way = F.when(~F.coalesce(F.col("q") <= ALPHA, F.lit(False)), "unchanged").when(diff > 0, "up").when(diff < 0, "down").otherwise("flat")
    return q.select("metric", "n_current", "n_previous", "current", "previous", "p", "q", way.alias("direction"))


def evidence(summary: DataFrame, by: str) -> DataFrame:
    """(key, value, gap): every number of a summary under ``by.column``; an undefined one has a NULL value and is a gap."""
    names = [f.name for f in summary.schema if f.name != by and f.dataType.simpleString().split("(")[0] in ("int", "bigint", "double", "decimal")]
    each = F.array(*(F.struct(F.lit(n).alias("k"), F.col(n).cast("double").alias("v")) for n in names))
    return summary.select(F.col(by).cast("string").alias("_b"), F.explode(each).alias("e")).select(F.concat_ws(".", "_b", "e.k").alias("key"), F.col("e.v").alias("value"), F.col("e.v").isNull().alias("gap"))


def check_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(claim_id, problems): uncited, unknown, undefined and unsupported, sorted; empty for a sound claim.

    claims: (claim_id, text, cites array<string>).  A numeral is supported when it equals a cited value at the digits
    it is written with, as such or as a percentage.
    """
    cited = claims.select("claim_id", F.explode_outer("cites").alias("key")).join(known, "key", "left")
    a = cited.groupBy("claim_id").agg(F.count("key").alias("n"), F.count_if(F.col("key").isNotNull() & F.col("gap").isNull()).alias("unknown"), F.count_if("gap").alias("undefined"), F.collect_list("value").alias("values"))
    c = claims.select("claim_id", F.coalesce("text", F.lit("")).alias("text")).join(a, "claim_id")
    digits = lambda s: F.length(F.regexp_extract(s, r"\.([0-9]+)", 1))
    near = lambda s: F.exists("values", lambda v: (F.abs(F.abs(v) - s.cast("double")) <= F.pow(F.lit(10.0), -digits(s)) / 2 + 1e-9) | (F.abs(F.abs(v) * 100 - s.cast("double")) <= F.pow(F.lit(10.0), -digits(s)) / 2 + 1e-9))
    bad = F.exists(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), lambda s: ~near(s))
    found = F.array(F.when(F.col("n") == 0, "uncited"), F.when(F.col("undefined") > 0, "undefined"), F.when(F.col("unknown") > 0, "unknown"), F.when(bad, "unsupported"))
    return c.select("claim_id", F.array_sort(F.filter(found, lambda x: x.isNotNull())).alias("problems"))
