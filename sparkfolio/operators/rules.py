"""Declarative three-valued rules: JSON trees compiled to columns, where NULL is unevaluable; strategies hold them by version."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weight factors by severity, ceiling of a score with a critical failure, depth limit, fields and operators.
SEVERITY = {"advisory": 0.5, "minor": 1.0, "major": 3.0, "critical": 8.0}
CEILING, DEPTH = 0.5, 12
FIELDS = (
    "direction", "instrument", "quantity", "entry_price", "exit_price", "entry_time", "entry_hour", "weekday", "session_segment", "duration_seconds", "has_stop", "has_target",
    "risk_amount", "risk_pct_of_equity", "planned_r_multiple", "stop_moved", "stop_widened", "net_pnl", "r_multiple", "mae_r", "mfe_r", "setup", "market_condition", "confidence",
    "emotion", "trades_today", "session_pnl_before", "consecutive_losses", "minutes_since_last_trade", "is_after_daily_loss_limit",
)
COMPARE = {"eq": "=", "ne": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
OPERATORS = (*COMPARE, "in", "not_in", "contains", "between", "is_set", "is_not_set")
COMBINE = {"all": "and", "any": "or", "none": "nor"}

#: The starter rules: code, severity, expression.
STARTERS = [
    ("always_use_a_stop", "critical", {"field": "has_stop", "op": "eq", "value": True}),
    ("never_widen_a_stop", "critical", {"field": "stop_widened", "op": "eq", "value": False}),
    ("risk_at_most_1_percent", "major", {"field": "risk_pct_of_equity", "op": "lte", "value": "0.01"}),
    ("minimum_reward_to_risk", "minor", {"field": "planned_r_multiple", "op": "gte", "value": "1.5"}),
    ("stop_after_daily_loss_limit", "critical", {"field": "is_after_daily_loss_limit", "op": "eq", "value": False}),
    ("max_trades_per_session", "major", {"field": "trades_today", "op": "lt", "value": 6}),
    ("pause_after_two_losses", "major", {"any": [{"field": "consecutive_losses", "op": "lt", "value": 2}, {"field": "minutes_since_last_trade", "op": "gte", "value": 10}]}),
    ("no_revenge_sizing", "major", {"any": [{"field": "session_pnl_before", "op": "gte", "value": 0}, {"field": "quantity", "op": "lte", "value": 2}]}),
]


def coerced(value, kind: T.DataType) -> Column:
    """A literal of the field's type; NULL if it can't be one.  Times of day are text HH:MM."""
    try:
        if value is None:
            return F.lit(None).cast(kind)
        if isinstance(kind, T.BooleanType):
            return F.lit(value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes"))
        if isinstance(kind, T.IntegralType):
            return F.lit(int(str(value)))
        if isinstance(kind, T.NumericType):
            number = Decimal(str(value))
            return F.lit(str(number)).cast("decimal(38,10)" if isinstance(kind, T.DecimalType) else "double") if number.is_finite() else F.lit(None).cast(kind)
        return F.lit(str(value)).cast(kind)
    except (InvalidOperation, ValueError):
        return F.lit(None).cast(kind)


def parsed(rule: dict | str, fields: tuple[str, ...] | list[str] = FIELDS, depth: int = 1) -> dict:
    """The rule with every default written out; a ValueError says what is wrong with it."""
    rule = json.loads(rule) if isinstance(rule, str) else rule
    if depth > DEPTH:
        raise ValueError(f"rule is deeper than {DEPTH}")
    if not isinstance(rule, dict):
        raise ValueError(f"a rule is an object, not {rule!r}")
    for name in COMBINE:
        if name in rule:
            if not isinstance(rule[name], list) or not rule[name]:
                raise ValueError(f"{name} needs conditions")
            return {name: [parsed(part, fields, depth + 1) for part in rule[name]]}
    field, op = rule.get("field"), rule.get("op", "eq")
    if field not in fields:
        raise ValueError(f"unknown field {field}")
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    if op in ("in", "not_in") and not isinstance(rule.get("value"), list):
        raise ValueError(f"{op} needs a list")
    return {"field": field, "op": op, "value": rule.get("value")}


def compile_rule(rule: dict | str, schema: T.StructType) -> Column:
    """The rule's verdict as a boolean column: true, false, or NULL where a field it needs is absent."""
    return _compiled(parsed(rule, schema.names), schema)


def _compiled(rule: dict, schema: T.StructType) -> Column:
    for name in COMBINE:
        if name in rule:
            out = None
            for c in (_compiled(part, schema) for part in rule[name]):
                out = c if out is None else (out & c if name == "all" else out | c)
            return ~out if name == "none" else out
    field, op, value = rule["field"], rule["op"], rule["value"]
    c, kind = F.col(field), schema[field].dataType
    if op in ("is_set", "is_not_set"):
        return c.isNotNull() if op == "is_set" else c.isNull()
    if op in ("in", "not_in"):  # no coercion: values of another type never match
        text = isinstance(kind, T.StringType)
        same = [v for v in value if isinstance(v, str) == text and isinstance(v, bool) == isinstance(kind, T.BooleanType)]
        hit = F.when(c.isNotNull(), c.isin(*same) if same else F.lit(False))
        return ~hit if op == "not_in" else hit
    if op == "contains":
        return F.array_contains(c, value) if isinstance(kind, T.ArrayType) else c.contains(F.lit(str(value)))
    if op == "between":
        if not isinstance(value, list) or len(value) != 2:
            return F.lit(None).cast("boolean")
        return c.between(*(coerced(v, kind) for v in value))
    x = coerced(value, kind)
    if op == "eq":
        return c == x
    if op == "ne":
        return c != x
    if op in ("lt", "lte"):
        return c < x if op == "lt" else c <= x
    return c > x if op == "gt" else c >= x


def describe(rule: dict | str) -> str:
    """The rule in words."""
    rule = parsed(rule)
    for name, word in COMBINE.items():
        if name in rule:
            return ("none of " if name == "none" else "") + "(" + f" {'or' if word == 'nor' else word} ".join(describe(part) for part in rule[name]) + ")"
    op, value = rule["op"], rule["value"]
    if op in ("is_set", "is_not_set"):
        return f"{rule['field']} is {'' if op == 'is_set' else 'not '}set"
    return f"{rule['field']} {COMPARE.get(op, op.replace('_', ' '))} {json.dumps(value)}"


def weight_of(severity: str, weight: float = 1.0) -> float:
    if severity not in SEVERITY:
        raise ValueError(f"unknown severity {severity}")
    return SEVERITY[severity] * float(weight)


VERDICT = "array<struct<rule: string, severity: string, weight: double, passed: boolean>>"


def _verdict(code: str, severity: str, weight: float, passed: Column) -> Column:
    return F.struct(F.lit(code).alias("rule"), F.lit(severity).alias("severity"), F.lit(weight_of(severity, weight)).alias("weight"), passed.cast("boolean").alias("passed"))


def evaluate(facts: DataFrame, rules: list[tuple]) -> DataFrame:
    """Facts with ``verdicts``: per rule (code, severity, expression, weight or 1) its name, severity, effective weight and
    three-valued ``passed``; one pass, no join."""
    each = [_verdict(code, severity, *(more or (1.0,)), compile_rule(rule, facts.schema)) for code, severity, rule, *more in rules]
    return facts.withColumn("verdicts", F.array(*each).cast(VERDICT))


def current_rules(strategies: DataFrame, rules: DataFrame) -> DataFrame:
    """Active rules of strategies that aren't deleted, of superseded versions too, as trades keep the version they were taken under."""
    return rules.filter("is_active").join(strategies.filter("not deleted").select("strategy_id", "name", "version"), "strategy_id")


def evaluate_by_strategy(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """As evaluate(), with each trade's verdicts on the rules of its own strategy_id.

    rules: (strategy_id, code, severity, weight, expression), a table that people write; it is compiled to columns, so
    trades are never joined with it.  A trade without a strategy or whose strategy has no rules has no verdict.
    """
    rows = rules.select("strategy_id", "code", "severity", "weight", "expression").orderBy("strategy_id", "code").collect()
    own: dict = {}
    for r in rows:
        own.setdefault(r["strategy_id"], []).append(_verdict(r["code"], r["severity"], r["weight"], compile_rule(r["expression"], facts.schema)))
    out = F.array().cast(VERDICT)
    for strategy, verdicts in own.items():
        out = F.when(F.col("strategy_id") == strategy, F.array(*verdicts).cast(VERDICT)).otherwise(out)
    return facts.withColumn("verdicts", out)


def score(evaluated: DataFrame) -> DataFrame:
    """Adds score (weighted share of passes among evaluable rules, at most CEILING after a critical failure; NULL if none
    is evaluable) and coverage (the share of rules that are evaluable; NULL without any)."""
    total = lambda keep: F.aggregate(F.filter("verdicts", keep), F.lit(0.0), lambda a, v: a + v["weight"])
    known, passed = total(lambda v: v["passed"].isNotNull()), total(lambda v: F.coalesce(v["passed"], F.lit(False)))
    critical = F.exists("verdicts", lambda v: (v["severity"] == "critical") & ~F.coalesce(v["passed"], F.lit(True)))
    raw = F.try_divide(passed, known)
    share = F.try_divide(F.size(F.filter("verdicts", lambda v: v["passed"].isNotNull())).cast("double"), F.size("verdicts").cast("double"))
    return evaluated.withColumn("score", F.when(critical, F.least(raw, F.lit(CEILING))).otherwise(raw)).withColumn("coverage", share)


def run_totals(scored: DataFrame) -> DataFrame:
    """One row: trades evaluated, scored, violations, critical ones, trades without a strategy or rules, and the mean score."""
    failed = lambda v: ~F.coalesce(v["passed"], F.lit(True))
    some = F.size("verdicts") > 0
    return scored.agg(
        F.count_if(some).alias("evaluated"), F.count("score").alias("scored"), F.sum(F.size(F.filter("verdicts", failed))).alias("violations"),
        F.sum(F.size(F.filter("verdicts", lambda v: failed(v) & (v["severity"] == "critical")))).alias("critical"), F.count_if(F.col("strategy_id").isNull()).alias("without_strategy"),
        F.count_if(F.col("strategy_id").isNotNull() & ~some).alias("without_rules"), F.avg("score").alias("mean_score"),
    )


def rule_outcomes(evaluated: DataFrame) -> DataFrame:
    """Per rule how often it passed, failed and couldn't be told."""
    v = evaluated.select(F.explode("verdicts").alias("v")).select("v.*")
    return v.groupBy("rule", "severity").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("unevaluable"))


def supersede(strategies: DataFrame, changed: DataFrame) -> DataFrame:
    """Versions with new ones appended: a change is never an edit.

    changed: (name, ...) as strategies, without version; each gets the next version of its name, and versions before the
    latest are superseded.
    """
    last = strategies.groupBy("name").agg(F.max("version").alias("_v"))
    new = changed.join(last, "name", "left").withColumn("version", F.coalesce(F.col("_v"), F.lit(0)) + 1).drop("_v")
    every = strategies.select("strategy_id", "name", "version", "deleted").unionByName(new.select("strategy_id", "name", F.col("version").cast(strategies.schema["version"].dataType), "deleted"))
    latest = F.max("version").over(W.partitionBy("name"))
    return every.withColumn("superseded", F.col("version") < latest)
