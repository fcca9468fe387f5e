"""Hand-computed cases and a sequential matcher for the trading operators."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import exprs
from sparkfolio.operators import bars, fifo, ranges, rules, scan, sequences, stats
from sparkfolio.sources import stores, views

T0 = dt.datetime(2026, 3, 5, 14, 0)
FILLS = "fill_id long, account long, symbol string, ts timestamp, side string, qty decimal(6,0), price decimal(20,8), commission decimal(20,8)"


def fills(spark, rows, account=1):
    return spark.createDataFrame([(i, account, "click", T0 + dt.timedelta(minutes=10 * i), s, Decimal(q), Decimal(str(p)), Decimal(str(c))) for i, (s, q, p, c) in enumerate(rows)], FILLS)


GOLDEN = [
    ("long", [("buy", 1, 5000, 0), ("sell", 1, 5004, 0)], [("long", "closed", 200.0)]),
    ("short", [("sell", 2, 5010, 0), ("buy", 2, 5000, 0)], [("short", "closed", 1000.0)]),
    ("loser", [("buy", 1, 5000, 0), ("sell", 1, 4997.75, 0)], [("long", "closed", -112.5)]),
    ("scale in", [("buy", 1, 5000, 0), ("buy", 3, 5004, 0), ("sell", 4, 5010, 0)], [("long", "closed", 1400.0)]),
    ("scale out", [("buy", 1, 5000, 0), ("buy", 1, 5002, 0), ("sell", 1, 5006, 0), ("sell", 1, 5008, 0)], [("long", "closed", 600.0)]),
    ("partial", [("buy", 3, 5000, 0), ("sell", 1, 5004, 0)], [("long", "open", 200.0)]),
    ("flip", [("buy", 2, 5000, 0), ("sell", 5, 5004, 0)], [("long", "closed", 400.0), ("short", "open", 0.0)]),
]


@pytest.mark.parametrize("name, rows, expected", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_fifo_golden(spark, name, rows, expected):
    got = fifo.trades(fills(spark, rows), views.instruments(spark)).orderBy("tid").collect()
    assert [(r.direction, r.status, float(r.gross)) for r in got] == expected


def test_fifo_costs_sum_to_the_charge(spark):
    t = fifo.trades(fills(spark, [("buy", 2, 10, "0.33333333"), ("sell", 5, 11, "0.77777777"), ("buy", 3, 9, "0.1")]), views.instruments(spark))
    assert t.agg(F.sum("commission")).first()[0] == Decimal("1.2111111")


def sequential(rows):
    """Gross points by trade of one position, one fill after another."""
    lots, out, points = [], [], Decimal(0)
    for side, q, p, _ in rows:
        s, q, p = (1 if side == "buy" else -1), Decimal(q), Decimal(str(p))
        while q and lots and lots[0][0] == -s:
            n = min(q, lots[0][1])
            points += (p - lots[0][2]) * -s * n
            q, lots[0][1] = q - n, lots[0][1] - n
            if not lots[0][1]:
                lots.pop(0)
                if not lots:
                    out.append(points)
                    points = Decimal(0)
        if q:
            lots.append([s, q, p])
    return out + ([points] if lots else [])


def test_fifo_against_a_sequential_matcher_and_any_order(spark):
    rng, frames, expected = random.Random(5), None, {}
    for account in range(12):
        rows = [(rng.choice(["buy", "sell"]), rng.randint(1, 5), rng.randint(100, 200) / 4, 0) for _ in range(40)]
        expected[account] = sequential(rows)
        f = fills(spark, rows, account)
        frames = f if frames is None else frames.unionByName(f)
    for parts in (1, 7):
        got = fifo.trades(frames.orderBy(F.rand(3)).repartition(parts), views.instruments(spark)).orderBy("account", "tid").collect()
        assert {a: [r.points or 0 for r in got if r.account == a] for a in expected} == expected


def test_sessions(spark):
    rows = [("2026-03-01 23:30:00", "2026-03-02"), ("2026-03-06 23:30:00", "2026-03-09"), ("2026-03-08 22:30:00", "2026-03-09"), ("2026-03-05 15:00:00", "2026-03-05")]
    local = F.from_utc_timestamp(F.col("t").cast("timestamp"), "America/Chicago")
    got = spark.createDataFrame(rows, "t string, d string").select(exprs.session_date(local, F.lit(17 * 3600)).cast("string").alias("x"), "d").collect()
    assert all(r.x == r.d for r in got)


def test_bars(spark):
    base = dt.datetime(2026, 3, 2, 14, 30)
    one = spark.createDataFrame([("ES", base + dt.timedelta(minutes=n), 5000.0 + n, 5000.75 + n, 4999.75 + n, 5000.5 + n, 100.0) for n in range(60)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    five = bars.resample(one, 300).orderBy("ts").collect()
    assert len(five) == 12 and (five[0].open, five[0].high, five[0].low, five[0].close, five[0].volume) == (5000.0, 5004.75, 4999.75, 5004.5, 500.0)
    assert bars.gaps(one.filter("minute(ts) <> 40"), 60).count() == 1
    assert bars.atr(one.limit(5)).first().atr is None


def test_as_of_tolerance(spark):
    e = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), 0.0), ("a", dt.datetime(2026, 1, 3), 7.0)], "k string, at timestamp, equity double")
    t = spark.createDataFrame([("a", dt.datetime(2025, 12, 31)), ("a", dt.datetime(2026, 1, 2)), ("a", dt.datetime(2026, 1, 10, 23)), ("a", dt.datetime(2026, 1, 11))], "k string, ts timestamp")
    assert [r.equity for r in bars.as_of(t, e, "k", "ts", "at", "equity", 8 * 86400).orderBy("ts").collect()] == [None, 0.0, 7.0, None]


def facts(spark, nets, r=None):
    rows = [(i, "s", Decimal(n), Decimal(0), Decimal(n), r[i] if r else None, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i, minutes=5), 300, T0.date()) for i, n in enumerate(nets)]
    return spark.createDataFrame(rows, "trade_id long, account string, net decimal(20,8), costs decimal(20,8), gross decimal(20,8), r_multiple double, opened_at timestamp, closed_at timestamp, duration long, session_date date")


def test_summary(spark):
    s = stats.summary(facts(spark, [100, -50, 200, -50, 100], [2.0, -1.0, 3.0, -1.0, 1.0])).first()
    assert (s.net, s.winners, s.losers, s.profit_factor, s.expectancy_r, s.reliability) == (300, 3, 2, 4.0, 0.8, "provisional")
    assert stats.summary(facts(spark, [10, 20])).first().profit_factor is None
    assert stats.kelly(facts(spark, [-100, -50, 50, -75, -25])).first().kelly < 0


def test_drawdown(spark):
    c = stats.equity_curve(facts(spark, [100, -50, -20, 100, -10]), "account")
    p = stats.drawdown_periods(c, "account").orderBy("first_i").collect()
    assert [(x.first_i, x.last_i, float(x.depth), x.trough_i, x.recovered_i) for x in p] == [(2, 3, -70.0, 3, 4), (5, 5, -10.0, 5, None)]


def test_rules_are_three_valued(spark):
    d = spark.createDataFrame([(1, None, "x"), (5, 2.0, None), (None, None, None)], "a int, b double, c string")
    of = lambda r: [x[0] for x in d.select(rules.compile_rule(r, d.schema)).collect()]
    lt = {"field": "a", "op": "lt", "value": 3}
    assert of(lt) == [True, False, None]
    assert of({"all": [lt, {"field": "b", "op": "gt", "value": "1"}]}) == [None, False, None]
    assert of({"any": [lt, {"field": "b", "op": "gt", "value": "1"}]}) == [True, True, None]
    assert of({"none": [lt]}) == [False, True, None]
    assert of({"field": "c", "op": "is_set"}) == [True, False, False]
    assert of({"field": "a", "op": "in", "value": ["1"]}) == [False, False, None]
    assert of({"field": "a", "op": "eq", "value": "junk"}) == [None, None, None]
    with pytest.raises(ValueError):
        rules.compile_rule({"field": "z", "op": "eq", "value": 1}, d.schema)


def test_benjamini_hochberg(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    assert [r.q and round(r.q, 6) for r in sequences.benjamini_hochberg(d, "p").orderBy("i").collect()] == [0.03, 0.04, 0.04, None]
    rng = random.Random(1)
    many = spark.createDataFrame([(i, rng.choice(["a", None]), rng.choice([None, *[round(rng.random(), 2) for _ in range(4)]])) for i in range(300)], "i int, f string, p double")
    for family in ((), ("f",)):
        plain = sequences.benjamini_hochberg(many, "p", *family).orderBy("i").collect()
        assert plain == sequences.benjamini_hochberg(many, "p", *family, rows=30, small=0).orderBy("i").collect()
        for r in plain:
            own = sorted(x.p for x in plain if x.p is not None and (not family or x.f == r.f))
            assert (r.q is None) == (r.p is None) and (r.p is None or abs(r.q - min(1.0, *(own[k] * len(own) / (k + 1) for k in range(own.index(r.p), len(own))))) < 1e-9)


def test_fresh_keeps_each_key_once(spark):
    f = fills(spark, [("buy", 1, 1, 0), ("sell", 1, 2, 0)])
    assert stores.fresh(f.unionByName(f), f.limit(1), "account", "fill_id").count() == 1


def test_scans_in_two_levels(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(50), i, None if rng.random() < 0.2 else rng.randint(-9, 9)) for k in ("a", "b", None) for i in range(60 if k == "a" else 5)]
    d = spark.createDataFrame(rows, "k string, at int, i int, x int").withColumn("at", F.timestamp_seconds("at"))
    values = {"s": ("sum", F.col("x")), "n": ("count", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}
    for before in (False, True):
        plain = scan.running(d, ["k"], ["at", "i"], values, before)
        cut = scan.running(d, ["k"], ["at", "i"], values, before, rows=7, small=0)
        assert "/scan-" in cut.inputFiles()[0] and cut.columns == plain.columns and cut.dtypes == plain.dtypes
        assert cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()


def test_one_position_that_never_goes_flat(spark):
    n = 100_000
    f = spark.range(n).select(
        F.col("id").alias("fill_id"), F.lit(1).cast("long").alias("account"), F.lit("click").alias("symbol"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"),
        F.when(F.col("id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.when(F.col("id") % 2 == 0, 2).otherwise(1).cast("decimal(6,0)").alias("qty"),
        (F.col("id") % 97).cast("decimal(20,8)").alias("price"), F.lit(0).cast("decimal(20,8)").alias("commission"),
    )
    chunks = {"rows": 20_000, "small": 0}
    m = fifo.matches(fifo.slices(f, **chunks), **chunks)
    assert m.agg(F.count("*"), F.sum("qty")).first() == (n // 2, n // 2)
    # the k-th unit sold was bought in fill 2 * (k // 2)
    points = sum((2 * k + 1) % 97 - (2 * (k // 2)) % 97 for k in range(n // 2))
    t = fifo.trades(f, views.instruments(spark), **chunks).collect()
    assert [(r.status, int(r.points), int(r.qty_closed)) for r in t] == [("open", points, n // 2)]


def test_hot_keys_give_the_same_statistics(spark):
    rng = random.Random(6)
    t = facts(spark, [rng.randint(-40, 45) for _ in range(200)])
    b = spark.createDataFrame([("s", T0 + dt.timedelta(minutes=i + i // 50), 5.0, 6.0 + rng.random(), 4.0 - rng.random(), 5 + rng.random()) for i in range(200)], "symbol string, ts timestamp, open double, high double, low double, close double")
    chunks = {"rows": 20, "small": 0}
    for f in (
        lambda **c: stats.drawdown_summary(t, "account", **c), lambda **c: stats.drawdown_periods(stats.equity_curve(t, "account", **c), "account", **c), lambda **c: stats.streaks(t, "account", **c),
        lambda **c: bars.gaps(b, 60, **c), lambda **c: bars.atr(b, **c).select("n_ranges", F.round("atr", 9)),
    ):
        plain, cut = f().collect(), f(**chunks).collect()
        assert plain and sorted(map(str, plain)) == sorted(map(str, cut))


def test_excursions_over_blocks(spark):
    rng = random.Random(12)
    b = [("s", T0 + dt.timedelta(minutes=i), 50 - rng.random() * 9, 50 + rng.random() * 9) for i in range(900) if rng.random() < 0.8]
    bars_ = spark.createDataFrame([(s, t, 50.0, h, lo, 50.0) for s, t, lo, h in b], "symbol string, ts timestamp, open double, high double, low double, close double")
    trades, expected, touched = [], {}, {}
    for i in range(40):
        a = T0 + dt.timedelta(seconds=rng.randrange(50000))
        z = a + dt.timedelta(seconds=rng.choice([0, 30, 600, 20000]))
        trades.append((i, "s", rng.choice(["long", "short"]), a, z, 50.0, 100.0, 2.0))
        own = [(t, lo, h) for _, t, lo, h in b if a.replace(second=0) <= t <= z]
        if own:
            down, up = 50 - min(50, *(x[1] for x in own)), max(50, *(x[2] for x in own)) - 50
            expected[i] = tuple(round(x, 9) for x in ((down, up) if trades[-1][2] == "long" else (up, down))) + (len(own),)
            if first := [t for t, lo, h in own if lo <= 55 <= h]:
                touched[i] = first[0]
    t = spark.createDataFrame(trades, "trade_id int, symbol string, direction string, opened_at timestamp, closed_at timestamp, avg_entry double, risk double, point_value double")
    got = bars.excursions(t, bars_, 60).collect()
    assert {r.trade_id: (round(r.mae, 9), round(r.mfe, 9), r.n_bars) for r in got} == expected
    assert all(abs(r.mae_r - r.mae / 50) < 1e-9 for r in got)
    assert {r.trade_id: r.touched_at for r in bars.first_touch(t.withColumn("p", F.lit(55.0)), bars_, 60, "p").collect()} == touched
    long = spark.createDataFrame([(1, "s", T0, T0 + dt.timedelta(days=400))], "trade_id int, symbol string, opened_at timestamp, closed_at timestamp")
    assert ranges.cover(long, ranges.slot(F.col("opened_at"), 60), ranges.slot(F.col("closed_at"), 60)).count() <= 6 * ranges.LEVELS


def test_fills_set_aside_with_a_reason(spark):
    d = fills(spark, [("buy", 1, 1, 0), ("sell", 0, 1, 0), ("buy", 1, -1, 0), ("hold", 1, 1, 0), ("buy", 1, 1, -1)])
    got = fifo.screened(d.unionByName(d.filter("fill_id = 0")).unionByName(d.filter("fill_id = 0")))
    assert sorted((r.fill_id, r.reason or "") for r in got.collect()) == [(0, ""), (0, fifo.REPEATED), (0, fifo.REPEATED), (1, fifo.NO_SIZE), (2, fifo.NO_PRICE), (3, fifo.NO_SIDE), (4, fifo.BAD_COST)]
    assert fifo.usable(d).count() == 1


def test_queries_have_sql():
    from sparkfolio.plans.registry import ORACLE, QUERIES

    assert QUERIES.keys() - ORACLE.keys() == {"e06_report"} and ORACLE.keys() <= QUERIES.keys()


def test_payload_trees(spark):
    from pyspark.sql import types as T

    from sparkfolio.functions import payload

    kind = "struct<a:int,b:struct<c:string,d:array<double>>,m:map<string,struct<x:int>>,l:array<struct<y:int,z:array<int>>>>"
    rows = [
        (1, (1, ("é", [1.5, None]), {"k": (7,), "j": (None,)}, [(1, [2, 3]), (4, [])])), (2, (None, (None, None), None, None)), (3, (3, ("", []), {}, [])),
    ]
    d = spark.createDataFrame(rows, f"id int, t {kind}")
    paths = {(r.id, r.path): r.value for r in payload.dotted(d, "t", "id").collect()}
    assert paths[1, "b.d[1]"] is None and paths[1, "m.k.x"] == "7" and paths[1, "l[0].z[1]"] == "3" and paths[1, "l[1].y"] == "4" and (2, "a") in paths
    assert len([k for k in paths if k[0] == 1]) == 10 and len([k for k in paths if k[0] == 2]) == 2
    back = payload.rebuilt(payload.dotted(d, "t", "id"), T._parse_datatype_string(kind), "t", "id").orderBy("id").collect()
    assert back[0].t == d.first().t
    assert [(r.t.a, r.t.b.c, r.t.b.d, r.t.m, r.t.l) for r in back[1:]] == [(None, None, [], {}, []), (3, "", [], {}, [])]
