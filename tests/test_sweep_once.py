"""A sweep orders its trades once for all scenarios and draws once for all its readers."""

from sparkfolio.operators import whatif


def trades(spark):
    return spark.range(60).selectExpr(
        "id trade_id", "date_add(date'2024-01-01', cast(id / 10 as int)) session_date", "timestamp_seconds(1704067200 + id * 60) opened_at", "cast(id % 7 - 3 as double) net",
        "9 entry_hour", "if(id % 5 = 0, null, (id % 7 - 3) / 2D) r_multiple", "id % 4 * 0.4D mae_r", "id % 3 * 1D mfe_r",
    )


def test_scenarios_share_one_order_of_the_trades(spark):
    physical = whatif.simulate(trades(spark), whatif.SCENARIOS)._jdf.queryExecution().sparkPlan().toString()
    windows = [line.split("], [", 1)[1] for line in physical.split("\n") if "Window [" in line]
    assert windows and len({w.split("], [")[0] for w in windows}) == 1  # rows were multiplied by scenarios and parted twice
    assert all(w.startswith("session_date") for w in windows)


def test_draws_are_taken_once(spark):
    swept = whatif.sweep(trades(spark), replicates=40)
    assert "MapInArrow" not in swept._jdf.queryExecution().optimizedPlan().toString()  # ranks read the draws again
    got = {r.scenario: r for r in swept.collect()}
    wide = whatif.simulate(trades(spark), whatif.SCENARIOS).collect()
    for name, row in got.items():
        mine = [r for r in wide if r.scenario == name]
        assert (row.n, row.skipped, row.inapplicable) == (60, sum(r.outcome == "skipped" for r in mine), sum(r.outcome == "inapplicable" for r in mine))
        assert abs(row.difference - sum(r.delta for r in mine if r.delta is not None)) < 1e-9
    assert len(got) == len(whatif.SCENARIOS)


def test_a_recommendation_reads_a_sweep_once(spark):
    row = "scenario string, i int, n long, coverage double, actionable boolean, difference double, q double"
    swept = spark.createDataFrame([("a", 0, 9, 0.6, True, 5.0, 0.01), ("b", 1, 9, 0.6, True, 7.0, 0.02), ("c", 2, 9, 0.6, True, 7.0, 0.03), ("d", 3, 9, 0.4, False, 8.0, 0.2), ("e", 4, 9, 0.6, True, -1.0, 0.01)], row)
    best = whatif.recommendation(swept)
    assert tuple(best.first()) == (5, 4, 1, "b", 7.0, 0.02, None)
    assert best._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    reasons = [whatif.recommendation(swept.filter(f)).first() for f in ("i = 4", "i = 3", "i > 9")]
    assert [(r.best, r.reason) for r in reasons] == [(None, "no established improvement"), (None, "too little coverage"), (None, "too few trades")]
