"""Queries of rules and strategies, beside their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import rules
from ..operators import sequences as Q
from ..sources import views
from .analytics import bare
from .oracle import _STATE, r
from .queries import rounded, state

TABLE: dict = {}


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


#: strategy_id, name, version, deleted: the first version of one is superseded by the next.
STRATEGIES = [(0, "open drive", 1, False), (1, "open drive", 2, False), (2, "fade", 1, False), (3, "old", 1, True)]
#: Strategy 0 has three starter rules, 1 all of them with weights, 2 one that is switched off, 3 is deleted.
RULES = [(0, *rules.STARTERS[i], 1.0, True) for i in (0, 5, 6)] + [(1, *s, float(i + 1), True) for i, s in enumerate(rules.STARTERS)] + [(2, *rules.STARTERS[0], 1.0, False), (3, *rules.STARTERS[0], 1.0, True)]


def strategies(spark):
    return spark.createDataFrame(STRATEGIES, "strategy_id long, name string, version int, deleted boolean")


def rule_table(spark):
    rows = [(sid, code, severity, json.dumps(expression), weight, active) for sid, code, severity, expression, weight, active in RULES]
    return spark.createDataFrame(rows, "strategy_id long, code string, severity string, expression string, weight double, is_active boolean")


def compliance_facts(spark, sf):
    """Every field a rule may name; those that fills don't tell are made up from the trade's number."""
    tid, stop = F.col("tid"), F.col("tid") % 5 != 0
    s = state(spark, sf).withColumn("strategy_id", F.when(F.col("account") % 5 != 4, F.col("account") % 5))
    risk = F.when(stop, F.col("qty_opened").cast("double") * 40)
    return s.select(
        "trade_id", "strategy_id", "direction", F.col("symbol").alias("instrument"), F.col("qty_opened").alias("quantity"), F.col("avg_entry").alias("entry_price"), F.col("avg_exit").alias("exit_price"),
        F.date_format("opened_at", "HH:mm").alias("entry_time"), "entry_hour", F.col("entry_weekday").alias("weekday"), F.col("segment").alias("session_segment"), F.col("duration").alias("duration_seconds"),
        stop.alias("has_stop"), (tid % 2 == 0).alias("has_target"), risk.alias("risk_amount"), (risk / 10000).alias("risk_pct_of_equity"), F.when(stop & (tid % 2 == 0), (tid % 4) * 0.75).alias("planned_r_multiple"),
        F.when(stop, tid % 3 == 0).alias("stop_moved"), F.when(stop, tid % 7 == 0).alias("stop_widened"), F.col("net").alias("net_pnl"), F.lit(None).cast("double").alias("r_multiple"), F.lit(None).cast("double").alias("mae_r"),
        F.lit(None).cast("double").alias("mfe_r"), F.when(tid % 4 != 0, F.concat(F.lit("u"), (tid % 4).cast("string"))).alias("setup"), F.lit(None).cast("string").alias("market_condition"), (tid % 5 + 1).cast("int").alias("confidence"),
        F.lit(None).cast("string").alias("emotion"), F.col("index").alias("trades_today"), F.col("pnl_before").alias("session_pnl_before"), F.col("losses_before").alias("consecutive_losses"),
        F.col("minutes_since_exit").alias("minutes_since_last_trade"), (F.col("pnl_before") < -500).alias("is_after_daily_loss_limit"), "net",
    )


_FACTS = f"""{_STATE}, cf AS (SELECT *, CASE WHEN account % 5 <> 4 THEN account % 5 END AS strategy_id, tid % 5 <> 0 AS stop FROM state),
 pas AS (SELECT trade_id, strategy_id, net, [stop, CASE WHEN stop THEN NOT tid % 7 = 0 END, CASE WHEN stop THEN qo * 40 / 10000 <= 0.01 END, CASE WHEN stop AND tid % 2 = 0 THEN (tid % 4) * 0.75 >= 1.5 END, NOT pnl_before < -500, index < 6, (losses_before < 2 OR minutes_since_exit >= 10), (pnl_before >= 0 OR qo <= 2)] AS v FROM cf),
 rr(strategy_id, i, code, severity, w) AS (VALUES """
_FACTS += ", ".join(f"({sid}, {[c for c, *_ in rules.STARTERS].index(code) + 1}, '{code}', '{sev}', {rules.SEVERITY[sev] * w}::DOUBLE)" for sid, code, sev, _, w, active in RULES if active and sid != 3) + ")"
_OUT = "out AS (SELECT pas.*, code, severity, w, v[i] AS passed FROM pas JOIN rr USING (strategy_id))"
_SCORED = f"""{_FACTS}, {_OUT}, sc AS (SELECT trade_id, count(*) AS rules, sum(w) FILTER (passed IS NOT NULL) AS known, coalesce(sum(w) FILTER (passed), 0) AS won, bool_or(severity = 'critical' AND NOT coalesce(passed, true)) AS crit, count(passed) AS told, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (NOT passed AND severity = 'critical') AS broken FROM out GROUP BY 1),
 fin AS (SELECT pas.trade_id, strategy_id, rules, CASE WHEN crit THEN least(won / known, 0.5) ELSE won / known END AS score, told / rules AS coverage, coalesce(failed, 0) AS failed, coalesce(broken, 0) AS broken FROM pas LEFT JOIN sc USING (trade_id))"""


def judged(spark, sf):
    own = rules.current_rules(strategies(spark), rule_table(spark))
    return rules.score(rules.evaluate_by_strategy(compliance_facts(spark, sf), own))


@query(f"WITH {_SCORED} SELECT trade_id, strategy_id, {r('score')}, {r('coverage')}, failed FROM fin")
def a30_compliance(spark, sf):
    e = judged(spark, sf)
    return rounded(e.select("trade_id", "strategy_id", "score", "coverage", F.size(F.filter("verdicts", lambda v: ~v["passed"])).cast("long").alias("failed")))


@query(f"WITH {_SCORED} SELECT count(*) FILTER (rules IS NOT NULL) AS evaluated, count(score) AS scored, CAST(sum(failed) AS BIGINT) AS violations, CAST(sum(broken) AS BIGINT) AS critical, count(*) FILTER (strategy_id IS NULL) AS without_strategy, count(*) FILTER (strategy_id IS NOT NULL AND rules IS NULL) AS without_rules, {bare('avg(score)')} AS mean_score FROM fin")
def a34_run_totals(spark, sf):
    return rounded(rules.run_totals(judged(spark, sf)))


@query(f"WITH {_FACTS}, {_OUT} SELECT code AS rule, severity, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS unevaluable FROM out GROUP BY 1, 2")
def c04_rule_outcomes(spark, sf):
    return rounded(rules.rule_outcomes(judged(spark, sf)))


_IMPACT = f"WITH {_FACTS}, {_OUT}, a AS (SELECT code AS rule, count(*) FILTER (passed) AS n_kept, count(*) FILTER (NOT passed) AS n_broken, avg(net) FILTER (passed) AS mk, avg(net) FILTER (NOT passed) AS mb FROM out WHERE passed IS NOT NULL GROUP BY 1), im AS (SELECT *, (mb - mk) * n_broken AS cost FROM a)"


@query(f"{_IMPACT} SELECT rule, n_kept, n_broken, {r('mk', 'mean_kept')}, {r('mb', 'mean_broken')}, {r('cost', None, 4)}, {r('n_broken / (n_broken + n_kept)', 'broken_share')}, row_number() OVER (ORDER BY round(cost, 4) ASC NULLS LAST, rule) AS place FROM im")
def a29_rule_impact(spark, sf):
    """What breaking each rule cost, the costliest first (T06)."""
    from pyspark.sql import Window as W

    v = judged(spark, sf).select("net", F.explode("verdicts").alias("v")).select("net", "v.rule", "v.passed")
    i = Q.impact(v).withColumn("cost", F.round("cost", 4))
    return rounded(i.withColumn("place", F.row_number().over(W.orderBy(F.col("cost").asc_nulls_last(), "rule"))))  # a row a rule


@query(f"WITH {_STATE} SELECT trade_id, hour(opened_at) * 60 + minute(opened_at) >= 570 AS p03, CASE WHEN tid % 4 <> 0 THEN tid % 4 IN (1, 2) END AS p04, CASE WHEN tid % 4 <> 0 THEN 'u' || (tid % 4) LIKE '%%2%%' END AS p05, qo BETWEEN 2 AND 3 AS p06, tid % 4 <> 0 AS p07, NOT (direction = 'long' OR tid % 5 + 1 > 3) AS p08, CAST(NULL AS BOOLEAN) AS p09, NOT tid % 5 <> 0 AS p10, direction <> 'long' AS p11 FROM state")
def p03_operators(spark, sf):
    """One rule for each operator and combinator, coerced values among them."""
    f = compliance_facts(spark, sf)
    each = {
        "p03": {"field": "entry_time", "op": "gte", "value": "09:30"}, "p04": {"field": "setup", "op": "in", "value": ["u1", "u2", 3]}, "p05": {"field": "setup", "op": "contains", "value": "2"},
        "p06": {"field": "quantity", "op": "between", "value": ["2", 3]}, "p07": {"field": "setup", "op": "is_set"}, "p08": {"none": [{"field": "direction", "value": "long"}, {"field": "confidence", "op": "gt", "value": "3"}]},
        "p09": {"field": "risk_amount", "op": "lt", "value": "a lot"}, "p10": {"field": "has_stop", "op": "eq", "value": "no"}, "p11": {"field": "direction", "op": "ne", "value": "long"},
    }
    return f.select("trade_id", *(rules.compile_rule(x, f.schema).alias(k) for k, x in each.items()))


def strategies_of(spark, sf):
    """Suppliers as strategies: those of a nation are versions of one, and a debt stands for a deleted one."""
    from pyspark.sql import Window as W

    s = views.table(spark, sf, "supplier").join(views.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    version = F.row_number().over(W.partitionBy("n_name").orderBy("s_suppkey"))
    return s.select(F.col("s_suppkey").alias("strategy_id"), F.col("n_name").alias("name"), version.alias("version"), (F.col("s_acctbal") < 0).alias("deleted"))


def rules_of(spark, sf):
    """What suppliers deliver as their rules: one of the eight starter rules by the part, active unless a third of its lines says no."""
    starters = spark.createDataFrame([(i, code, severity, json.dumps(e)) for i, (code, severity, e) in enumerate(rules.STARTERS)], "k long, code string, severity string, expression string")
    n = views.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("strategy_id"), (F.col("l_partkey") % 8).alias("k")).agg(F.count("*").alias("n"))
    return n.join(starters, "k").select("strategy_id", "code", "severity", "expression", (F.col("k") + 1.0).alias("weight"), (F.col("n") % 3 != 0).alias("is_active"))


_STRATEGIES = "st AS (SELECT s_suppkey AS strategy_id, n_name AS name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS BIGINT) AS version, s_acctbal < 0 AS deleted FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_CODES = "codes(k, code, severity) AS (VALUES " + ", ".join(f"({i}, '{code}', '{severity}')" for i, (code, severity, _) in enumerate(rules.STARTERS)) + ")"


@query(f"""WITH {_STRATEGIES}, ch AS (SELECT 1000000 + n_nationkey AS strategy_id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 2000000 + r_regionkey, r_name FROM region),
v AS (SELECT * FROM st UNION ALL SELECT strategy_id, ch.name, coalesce((SELECT max(version) FROM st WHERE st.name = ch.name), 0) + 1, FALSE FROM ch)
SELECT strategy_id, name, version, deleted, version < max(version) OVER (PARTITION BY name) AS superseded FROM v""")
def c05_versions(spark, sf):
    """Every second nation gets a next version, and regions come as new strategies."""
    nation, region = views.table(spark, sf, "nation"), views.table(spark, sf, "region")
    changed = nation.filter("n_nationkey % 2 = 0").select((F.col("n_nationkey").cast("long") + 1000000).alias("strategy_id"), F.col("n_name").alias("name"))
    changed = changed.unionByName(region.select((F.col("r_regionkey").cast("long") + 2000000).alias("strategy_id"), F.col("r_name").alias("name")))
    return rounded(rules.supersede(strategies_of(spark, sf), changed.withColumn("deleted", F.lit(False))))


@query(f"""WITH {_STRATEGIES}, {_CODES}, ru AS (SELECT l_suppkey AS strategy_id, l_partkey % 8 AS k, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT strategy_id, code, severity, CAST(k + 1 AS DOUBLE) AS weight, name, version FROM ru JOIN codes USING (k) JOIN st USING (strategy_id) WHERE n % 3 <> 0 AND NOT deleted""")
def s07_rules(spark, sf):
    """Active rules of strategies that aren't deleted, superseded versions among them."""
    return rounded(rules.current_rules(strategies_of(spark, sf), rules_of(spark, sf)).select("strategy_id", "code", "severity", "weight", "name", "version"))
