"""Models, clusters, exits, mapping and claims against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import models, reports, resample
from sparkfolio.sources import mapping

DAY = dt.date(2026, 3, 2)
ROWS = "trade_id long, session_date date, a double, b double, y double"


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(5), []
    for i in range(180):
        a, b = rng.gauss(3, 2), rng.gauss(-1, 0.5)
        out.append((i, DAY + dt.timedelta(days=i // 6), None if i % 31 == 7 else a, b, 0.4 * a - 0.8 * b + rng.gauss(0, 0.3)))
    return spark.createDataFrame(out, ROWS), out


def ridge(x, y, penalty):
    x = np.column_stack([np.ones(len(x)), x])
    return np.linalg.solve(x.T @ x + penalty * np.diag([0] + [1] * (x.shape[1] - 1)), x.T @ y)


def test_linear_fit_is_the_normal_equations(rows):
    df, raw = rows
    full = np.array([r[2:] for r in raw if r[2] is not None])
    assert np.allclose(models.fit_linear(df, ["a", "b"], "y", 3.0), ridge(full[:, :2], full[:, 2], 3.0))


def test_walk_forward_is_fold_by_fold(rows):
    df, raw = rows
    got = {r.trade_id: (r.fold, r.penalty, r.predicted) for r in models.walk_forward(df, ["a", "b"], "y", first=20, step=5).collect()}
    days, want = sorted({r[1] for r in raw}), {}
    for fold, at in enumerate(range(20, len(days), 5), 1):
        train = [np.array([r[2:] for r in raw if r[1] == d and r[2] is not None]) for d in days[:at]]
        cut = int(at * 0.7)

        def scaled(x, by):
            return (x - by.mean(0)) / by.std(0, ddof=1)

        inner, rest = np.vstack(train[:cut]), np.vstack(train[cut:])
        errors = []
        for p in models.PENALTIES:
            beta = ridge(scaled(inner[:, :2], inner[:, :2]), inner[:, 2], p)
            errors.append((np.mean((rest[:, 2] - beta[0] - scaled(rest[:, :2], inner[:, :2]) @ beta[1:]) ** 2), p))
        whole, penalty = np.vstack(train), min(errors)[1]
        beta = ridge(scaled(whole[:, :2], whole[:, :2]), whole[:, 2], penalty)
        for r in raw:
            if r[1] in days[at : at + 5] and r[2] is not None:
                want[r[0]] = (fold, penalty, beta[0] + scaled(np.array(r[2:4]), whole[:, :2]) @ beta[1:])
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9 for k in got)


def test_walk_forward_refuses_short_histories(rows):
    assert models.walk_forward(rows[0].filter("trade_id < 100"), ["a", "b"], "y") is None


def test_logistic_fit_solves_the_penalised_score(rows):
    df, raw = rows
    df = df.withColumn("won", (F.col("y") > 2).cast("int"))
    fitted = models.fit_logistic(df, ["a", "b"], "won", 2.0)
    x = np.array([r[2:4] for r in raw if r[2] is not None])
    y = np.array([float(r[4] > 2) for r in raw if r[2] is not None])
    beta = np.array([fitted.intercept, *fitted.coefficients])
    design = np.column_stack([np.ones(len(x)), x])
    score = design.T @ (y - 1 / (1 + np.exp(-design @ beta))) - 2.0 * np.array([0, *beta[1:]])
    assert np.abs(score).max() < 1e-3
    p = models.probability(df, ["a", "b"], fitted)
    assert p.filter("a is null and predicted is not null").isEmpty() and p.filter("predicted < 0.001 or predicted > 0.999").isEmpty()
    assert models.fit_logistic(df.filter("won = 1"), ["a", "b"], "won") is None


def test_features_are_dropped_by_coverage_and_variation(rows):
    m, scales = models.feature_matrix(rows[0], {"a": F.col("a"), "const": F.lit(2), "rare": F.when(F.col("trade_id") % 2 == 0, F.col("b"))})
    assert list(scales) == ["a"] and m.count() == sum(r[2] is not None for r in rows[1])
    empty, none = models.feature_matrix(rows[0].limit(0), {"a": F.col("a")})
    assert none == {} and empty.isEmpty()


def test_clusters_are_found_only_where_they_are(spark):
    rng = random.Random(1)
    apart = [(i, rng.gauss(8 * (i % 3), 0.4), rng.gauss(5 * (i % 3 == 1), 0.4)) for i in range(90)]
    m = spark.createDataFrame(apart, "trade_id long, a double, b double")
    c, s, p = models.choose_clusters(m, ["a", "b"], range(3, 4), references=2, alpha=0.34)
    assert s > 0.7 and p <= 0.34 and c.groupBy("cluster").agg(F.count_distinct(F.col("trade_id") % 3).alias("n")).filter("n > 1").isEmpty()
    assert c.filter("confidence < 0.5 or confidence > 1").isEmpty()
    assert models.choose_clusters(m, ["a", "b"], references=3) is None  # too few references to reach alpha
    x = models.shuffled(m, ["a", "b"], 0)
    assert sorted(r.a for r in x.collect()) == sorted(r[1] for r in apart)


def test_paths_end_at_ruin(spark):
    t = spark.createDataFrame([(i, "g", -10.0) for i in range(6)], "trade_id long, g string, net double")
    p = resample.paths(t, "net", "g", 4, 50, 35.0).collect()
    assert [(float(r.final), float(r.max_drawdown), r.ruined) for r in p] == [(-40.0, 40.0, True)] * 4
    assert resample.paths(t.limit(4), "net", "g", 4, 50).isEmpty()


def test_no_change_is_no_evidence(spark):
    t = spark.createDataFrame([(i, "g", 0.0) for i in range(9)], "trade_id long, g string, delta double")
    r = resample.paired_test(t, "delta", "g", 50).first()
    assert (r.p, r.effect) == (1.0, None)


def test_few_sessions_have_no_interval(spark):
    t = spark.createDataFrame([(DAY + dt.timedelta(days=i % 5), 0.5 + 0.1 * (i % 3), i % 2) for i in range(20)], "session date, predicted double, actual int")
    r = resample.block_skill(t, 10).first()
    assert r.skill is not None and r.low is None and not r.established


def test_fills_wait_with_a_reason_and_hold_the_cursor(spark):
    now = "2026-03-05 14:00:00"
    raw = [(1, 10, 5, "2026-03-05 13:00:00"), (2, 99, 5, "2026-03-05 13:00:00"), (3, 10, 6, "2026-03-05 13:00:00"), (4, 11, 5, "2026-03-05 13:58:00"), (5, 11, 5, "2026-03-05 13:00:00")]
    fills = spark.createDataFrame(raw, "id long, order_id long, contract_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    orders = spark.createDataFrame([(10, 1), (11, 2)], "order_id long, account long")
    spec = mapping.specs(spark.createDataFrame([(5, "ESZ5", 7)], "contract_id long, symbol string, product_id long"), spark.createDataFrame([(7, 50, "0.25")], "product_id long, point long, tick string"))
    s = spec.first()
    assert (float(s.tick_value), s.digits) == (12.5, 2)
    fees = spark.createDataFrame([(1, 1.0, 0.5)], "id long, commission double, fees double")
    m = mapping.map_fills(fills, orders, spec, fees, now)
    assert {r.id: r.reason for r in m.collect()} == {1: None, 2: mapping.NO_ORDER, 3: mapping.NO_CONTRACT, 4: mapping.NO_FEE, 5: None}
    assert mapping.next_cursor(m, 0).first()[0] == 1 and mapping.next_cursor(m, 3).first()[0] == 3
    assert mapping.next_cursor(m.filter("id = 5"), 4, orders.filter("account = 1")).first()[0] == 4
    assert {r.id for r in mapping.map_fills(fills, orders, spec, fees, now, orders.filter("account = 1").select("account")).collect()} == {1, 2, 3}
    assert mapping.next_cursor(m.limit(0), 7).first()[0] == 7


def test_claims_are_held_against_evidence(spark):
    known = spark.createDataFrame([("n", 42.0, False), ("rate", 0.537, False), ("kelly", None, True)], "key string, value double, gap boolean")
    claims = [(1, "42 trades, 53.7% won", ["n", "rate"]), (2, "about 44 trades", ["n"]), (3, "it went well", []), (4, "see this", ["kelly"]), (5, "see that", ["nothing"]), (6, None, None)]
    got = reports.check_claims(spark.createDataFrame(claims, "claim_id long, text string, cites array<string>"), known)
    assert {r.claim_id: r.problems for r in got.collect()} == {1: [], 2: ["unsupported"], 3: ["uncited"], 4: ["undefined"], 5: ["unknown"], 6: ["uncited"]}


def plain_logistic(x, y, penalty):
    """Newton's method on standardised columns, intercept unpenalised; coefficients in the columns' units."""
    m, s = x.mean(axis=0), x.std(axis=0, ddof=1)
    z, b = np.column_stack([np.ones(len(x)), (x - m) / s]), np.zeros(x.shape[1] + 1)
    d = penalty * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        move = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + d, z.T @ (y - p) - d @ b)
        b = b + move
        if np.abs(move).max() < 1e-9:
            break
    return np.concatenate([[b[0] - (b[1:] * m / s).sum()], b[1:] / s])


def test_logistic_walk_forward_against_plain_fits(spark):
    rng = np.random.default_rng(8)
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(33)]
    x = rng.normal(size=(400, 2)) * [2.0, 0.5] + [1.0, 3.0]
    day = np.sort(rng.integers(0, len(days), len(x)))
    won = (rng.random(len(x)) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, days[d], float(a), float(b), int(w)) for i, (d, (a, b), w) in enumerate(zip(day, x, won))], "trade_id int, session_date date, a double, b double, won int")
    got = {r.trade_id: (r.fold, r.penalty, r.predicted) for r in models.walk_forward_logistic(df, ["a", "b"], "won", first=20, step=5).repartition(3).collect()}
    tested = sorted(set(day.tolist()))
    number = {d: i + 1 for i, d in enumerate(tested)}
    fold = np.array([0 if number[d] <= 20 else (number[d] - 21) // 5 + 1 for d in day])
    for f in sorted(set(fold) - {0}):
        train = fold < f
        size = 20 + (f - 1) * 5
        inner = train & np.array([number[d] <= int(size * 0.7) for d in day])
        rest = train & ~inner
        errors = []
        for p in models.PENALTIES:
            b = plain_logistic(x[inner], won[inner], p)
            errors.append((((won[rest] - 1 / (1 + np.exp(-(b[0] + x[rest] @ b[1:])))) ** 2).mean(), p))
        penalty = min(errors)[1]
        b = plain_logistic(x[train], won[train], penalty)
        for i in np.flatnonzero(fold == f):
            said = min(0.999, max(0.001, 1 / (1 + np.exp(-(b[0] + x[i] @ b[1:])))))
            assert got[i][:2] == (f, penalty) and abs(got[i][2] - said) < 1e-6
    assert set(got) == set(np.flatnonzero(fold).tolist())


def test_serving_takes_the_model_in_force(spark):
    from sparkfolio.operators import serving

    rng = np.random.default_rng(2)
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [(i, days[i // 4], float(a), None if i % 9 == 0 else float(b), float(a - b + rng.normal() * 0.1)) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "trade_id int, session_date date, a double, b double, y double")
    made = serving.train(df, "h", ["a", "b"], "y")
    m = made.orderBy("fold").collect()
    assert [r.fold for r in m] == list(range(1, 10)) and m[-1].trained_at == dt.date(2026, 3, 2) and m[0].trained_at == days[20]
    assert m[0].reason == serving.FEW and m[-1].deployable and m[-1].skill > 0.9
    assert m[-1].trained + m[-1].skipped == 240 and m[0].trained + m[0].skipped == 80
    other = made.withColumn("head", F.lit("other")).withColumn("beta", F.array(*[F.lit(1e9)] * 3)).withColumn("deployable", F.lit(True))
    got = {r.trade_id: r for r in serving.serve(df, made.unionByName(other), "h", ["a", "b"]).collect()}
    for i, day, a, b, _ in rows:
        force = [r for r in m if r.trained_at <= day]
        if not force:
            assert got[i].trained_at is None and got[i].predicted is None
            continue
        assert got[i].trained_at == force[-1].trained_at
        if b is None or not force[-1].deployable:
            assert got[i].predicted is None
        else:
            assert abs(got[i].predicted - (force[-1].beta[0] + force[-1].beta[1] * a + force[-1].beta[2] * b)) < 1e-9
    # a later session changes nothing that was said before
    early = serving.train(df.filter("trade_id < 160"), "h", ["a", "b"], "y").orderBy("fold").collect()
    assert [tuple(r) for r in early[:-1]] == [tuple(r) for r in m[: len(early) - 1]]
    assert serving.train(df.filter("trade_id < 40"), "h", ["a", "b"], "y").count() == 0
