"""Logistic folds, the gate, the pattern scan, reports and replays against plain Python."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from sparkfolio.operators import discovery, models, replay, reports, sequences

DAY = dt.date(2026, 3, 2)
T0 = dt.datetime(2026, 3, 5, 14, 0)


def newton(x, y, penalty):
    x, d = np.column_stack([np.ones(len(x)), x]), penalty * np.diag([0] + [1] * x.shape[1])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + d, x.T @ (y - p) - d @ b)
    return b


def test_logistic_walk_forward_is_fold_by_fold(spark):
    rng, raw = random.Random(9), []
    for i in range(156):
        a, b = rng.gauss(3, 2), rng.gauss(-1, 0.5)
        raw.append((i, DAY + dt.timedelta(days=i // 6), None if i % 31 == 7 else a, b, int(0.5 * a + b + rng.gauss(0, 1) > 0.5)))
    df = spark.createDataFrame(raw, "trade_id long, session_date date, a double, b double, y int")
    got = {r.trade_id: (r.fold, r.penalty, r.predicted) for r in models.walk_forward_logistic(df, ["a", "b"], "y", first=20, step=5).collect()}
    days, want = sorted({r[1] for r in raw}), {}
    for fold, at in enumerate(range(20, len(days), 5), 1):
        rows = lambda ds: np.array([r[2:] for r in raw if r[1] in ds and r[2] is not None], dtype=float)
        cut = int(at * 0.7)
        inner, rest, whole = rows(days[:cut]), rows(days[cut:at]), rows(days[:at])

        def chance(train, x, penalty):
            mean, sd = train[:, :2].mean(0), train[:, :2].std(0, ddof=1)
            b = newton((train[:, :2] - mean) / sd, train[:, 2], penalty)
            return 1 / (1 + np.exp(-b[0] - (x[:, :2] - mean) / sd @ b[1:]))

        penalty = min((np.mean((rest[:, 2] - chance(inner, rest, p)) ** 2), p) for p in models.PENALTIES)[1]
        for r in raw:
            if r[1] in days[at : at + 5] and r[2] is not None:
                want[r[0]] = (fold, penalty, chance(whole, np.array([r[2:]], dtype=float), penalty)[0])
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-6 for k in got)
    assert models.walk_forward_logistic(df.filter("trade_id < 100"), ["a", "b"], "y") is None
    one = models.walk_forward_logistic(df.withColumn("y", F.lit(1)), ["a", "b"], "y")
    assert one.isEmpty()


def predictions(spark, skill, n=240):
    rng, out = random.Random(3), []
    for i in range(n):
        p = 0.15 if i % 2 else 0.85
        out.append((i, DAY + dt.timedelta(days=i // 8), p, int(rng.random() < (p if skill else 0.5))))
    return spark.createDataFrame(out, "trade_id long, session date, predicted double, actual int")


def test_gate_names_the_first_reason(spark):
    good = predictions(spark, True)
    assert models.gate(good, True, 50, 50).first().reason is None
    assert models.gate(predictions(spark, False), True, 50, 50).first().reason == "no skill"
    assert models.gate(good.limit(40), True, 50, 50).first().reason == "too few scored trades"
    assert models.gate(good.filter("trade_id < 60"), True, 50, 50).first().reason == "too few sessions"
    wide = good.withColumn("predicted", F.when(F.col("predicted") > 0.5, 0.6).otherwise(0.4))
    assert models.gate(wide, True, 50, 50).first().reason == "miscalibrated"
    assert models.gate(wide, False, 50, 50).first().reason is None
    assert models.gate(good.limit(0), True, 50, 50).first().reason == "too few scored trades"


def test_scan_finds_a_planted_cluster(spark):
    rng, rows = random.Random(2), []
    for i in range(120):
        rows.append((i, DAY + dt.timedelta(days=i // 4), T0 + dt.timedelta(minutes=30 * i), T0 + dt.timedelta(minutes=30 * i + 5), rng.gauss(-200 if i % 3 == 0 else 40, 30), 300))
    t = spark.createDataFrame(rows, "trade_id long, session_date date, opened_at timestamp, closed_at timestamp, net double, duration long")
    clustered = t.select("trade_id", F.when(F.col("trade_id") % 3 == 0, 0).otherwise(1).alias("cluster"), F.lit(0.5).alias("confidence"))
    got = {r.test: r for r in discovery.scan(sequences.session_state(t), clustered, 99).collect()}
    assert got["cluster_0"].found and got["cluster_0"].mean_in < -150 and (got["cluster_0"].n_in, got["cluster_0"].n_out) == (40, 80)
    known = sorted((r.p, r.q) for r in got.values() if r.p is not None)
    m = len(known)
    assert all(abs(q - min(1, min(p * m / i for i, (p, _) in enumerate(known, 1) if i >= k))) < 1e-9 for k, (_, q) in enumerate(known, 1))
    assert got["overtrading"].p is None and not got["overtrading"].found  # four trades a session
    assert discovery.scan(sequences.session_state(t.limit(0)), clustered.limit(0), 9).isEmpty()


def test_only_sure_members_are_proposed(spark):
    c = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.55), (3, 0, 0.54), (4, 1, 0.5)], "trade_id long, cluster int, confidence double")
    assert sorted((r.cluster, r.size, r.trade_id) for r in discovery.proposals(c).collect()) == [(0, 3, 1), (0, 3, 2)]


def test_sections_are_withheld_with_a_reason(spark):
    s = spark.createDataFrame([("ES", 4, None)], "symbol string, n long, kelly double")
    full = {(r.section, r.key, r.value, r.reason) for r in reports.compose({"performance": (s, "symbol"), "leaks": (s.limit(0), "symbol")}, 8, "monthly").collect()}
    assert full == {("performance", "ES.n", 4.0, None), ("performance", "ES.kelly", None, None), ("leaks", None, None, "nothing found")}
    assert [r.reason for r in reports.compose({"performance": (s, "symbol")}, 7, "monthly").collect()] == ["too few sessions"]


def test_replay_windows_and_gaps(spark):
    t = spark.createDataFrame([("a", "ES", T0, T0 + dt.timedelta(seconds=120), 120), ("b", "ES", T0, None, None)], "trade_id string, symbol string, opened_at timestamp, closed_at timestamp, duration long")
    w = {r.trade_id: r for r in replay.windows(t).collect()}
    assert w["a"].bar_seconds == 15 and w["a"].window_start == T0 - dt.timedelta(minutes=30) and w["a"].window_end == T0 + dt.timedelta(minutes=17)
    assert w["b"].window_end == T0 + dt.timedelta(minutes=15)
    at = [-1801, -1800, -1785, 0, 15, 1020, 1021]
    bars = spark.createDataFrame([("ES", T0 + dt.timedelta(seconds=s), 1.0, 2.0, 0.5, 1.5) for s in at], "symbol string, ts timestamp, open double, high double, low double, close double")
    got = replay.window_bars(replay.windows(t.filter("trade_id = 'a'")), bars).orderBy("ts").collect()
    assert [((r.ts - T0).total_seconds(), r.gap) for r in got] == [(-1800, False), (-1785, False), (0, True), (15, False), (1020, True)]
