"""Positions resumed from keyed state, and stores whose tables change together, with failures between the writes."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import fifo
from sparkfolio.sources import reports, sync, versions, views
from sparkfolio.streaming import positions

T0 = dt.datetime(2026, 3, 5, 14, 0)


def random_fills(spark, n, seed, accounts=4):
    rng = random.Random(seed)
    rows = [
        (rng.randrange(accounts), rng.choice(["click", "view"]), i, T0 + dt.timedelta(minutes=i // 2), rng.choice(["buy", "sell"]), Decimal(rng.randint(1, 5)),
         Decimal(rng.randint(100, 200)) / 4, Decimal(rng.randint(0, 99)) / 100, Decimal(rng.randint(0, 9)) / 100)
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, positions.FILL)


def land(spark, rows, folder):
    """One file, and so one micro-batch, behind those that are there."""
    spark.createDataFrame(rows, positions.FILL).coalesce(1).write.mode("append").parquet(str(folder))


def follow(spark, tmp, store, **more):
    name = more.get("stream", "fills")
    source = spark.readStream.schema(positions.FILL).option("maxFilesPerTrigger", 1).parquet(str(tmp / "in"))
    query = positions.run(spark, source, store, str(tmp / f"ck-{name}"), instruments=views.instruments(spark), **more)
    query.awaitTermination(300)
    return query


def same(a, b):
    """Whether the rows are equal, numbers whatever their scale."""
    plain = lambda df: sorted(str([x.normalize() if isinstance(x, Decimal) else x for x in r]) for r in df.select(b.columns).collect())
    return plain(a) == plain(b)


def test_any_split_with_a_restart_between(spark, tmp_path):
    rows, fills = random_fills(spark, 90, 3)
    store = versions.Store(spark, str(tmp_path / "store"))
    cuts = [0, 7, 8, 40, 90]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        land(spark, rows[a:b], tmp_path / "in")
        if i in (1, 3):  # two queries over one checkpoint
            query = follow(spark, tmp_path, store)
    assert same(positions.trades(store, views.instruments(spark)), fifo.trades(fills, views.instruments(spark)))
    # what is open, and three values a position: nothing else is in the state
    lots = fifo.slices(fills).filter("role = 'entry'").count()
    held = positions.opening(fills).count()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= held + 3 * 8 < lots


def test_late_and_repeated_fills_then_a_new_stream(spark, tmp_path):
    rows, fills = random_fills(spark, 60, 5)
    store = versions.Store(spark, str(tmp_path / "store"))
    for part in (rows[30:50], rows[:30], rows[20:40]):  # the later half first, then the earlier, then repeats of both
        land(spark, part, tmp_path / "in")
        follow(spark, tmp_path, store)
    some = fills.filter("fill_id < 50")
    assert same(positions.trades(store, views.instruments(spark)), fifo.trades(some, views.instruments(spark)))
    assert store.read("stale").count() > 0 and store.read("fills").count() == 50
    land(spark, rows[50:], tmp_path / "in")
    follow(spark, tmp_path, store, stream="second", restart=True)
    assert store.read("stale").count() == 0
    assert same(positions.trades(store, views.instruments(spark)), fifo.trades(fills, views.instruments(spark)))


def test_a_crash_between_the_writes_changes_nothing(spark, tmp_path, monkeypatch):
    rows, fills = random_fills(spark, 40, 8)
    store = versions.Store(spark, str(tmp_path / "store"))
    land(spark, rows[:20], tmp_path / "in")
    follow(spark, tmp_path, store)
    before = store.version(), store.read("fills").count()
    land(spark, rows[20:], tmp_path / "in")

    def lost(self, version, manifest):
        raise OSError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(versions.Store, "_publish", lost)
        with pytest.raises(Exception, match="lost before the commit"):
            follow(spark, tmp_path, store)
    assert (store.version(), store.read("fills").count()) == before
    assert store.vacuum() != []  # what the crash left
    follow(spark, tmp_path, store)
    assert same(positions.trades(store, views.instruments(spark)), fifo.trades(fills, views.instruments(spark)))
    # the same micro-batch again, as after a crash behind the commit
    version = store.version()
    out = spark.createDataFrame([], positions.OUT)
    positions.sink(out, store.value("batch fills"), store, "fills")
    assert store.version() == version


def test_unknown_instruments_are_refused(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "store"))
    odd = spark.createDataFrame([(1, "nothing", 1, T0, "buy", Decimal(1), Decimal(1), Decimal(0), Decimal(0))], positions.FILL)
    with pytest.raises(ValueError, match="nothing"):
        positions.ingest(store, odd, views.instruments(spark))
    assert store.version() == 0


def test_catch_up_then_the_same_fills_by_stream(spark, tmp_path):
    rows, fills = random_fills(spark, 50, 11)
    store = versions.Store(spark, str(tmp_path / "store"))
    positions.ingest(store, fills.filter("fill_id < 30"), views.instruments(spark))
    land(spark, rows[20:], tmp_path / "in")  # overlaps the catch-up
    follow(spark, tmp_path, store, restart=True)
    assert store.read("fills").count() == 50
    assert same(positions.trades(store, views.instruments(spark)), fifo.trades(fills, views.instruments(spark)))


def test_store_versions_conflicts_and_compaction(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read("a", "x long").count() == 0
    one = spark.range(3).withColumnRenamed("id", "x")
    assert store.commit({"a": one}, {"b": one}, cursor=7) == 1
    assert store.commit({"a": one}, {"b": one.limit(1)}) == 2
    assert (store.read("a").count(), store.read("b").count(), store.value("cursor")) == (6, 1, 7)
    assert (store.read("a", version=1).count(), store.read("b", version=1).count()) == (3, 3)
    with pytest.raises(versions.Conflict):
        store.commit({"a": one}, base=1)
    assert store.read("a").count() == 6
    assert store.compact("a") == 3 and store.read("a").count() == 6 and len(store.manifest()["tables"]["a"]["parts"]) == 1
    with pytest.raises(KeyError):
        store.read("c")


def test_report_store(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "store"))
    made = lambda account, kind, start, at, head: (account, kind, "ready", start, start + dt.timedelta(days=27), head, "{}", "{}", at)
    jan, feb = dt.date(2026, 1, 1), dt.date(2026, 2, 1)
    rows = [made(1, "monthly", jan, T0, "first"), made(1, "monthly", feb, T0, "second"), made(2, "weekly", jan, T0, "other"), made(None, "monthly", jan, T0, "whole")]
    reports.save(store, spark.createDataFrame(rows, reports.SCHEMA))
    reports.save(store, spark.createDataFrame([made(1, "monthly", jan, T0 + dt.timedelta(days=9), "changed"), made(None, "monthly", jan, T0, "again")], reports.SCHEMA))
    held = store.read("reports")
    assert held.count() == 4 and held.filter("headline in ('changed', 'again')").isEmpty()
    assert {(r.account, r.report_type): r.headline for r in reports.latest(held).collect()} == {(1, "monthly"): "second", (2, "weekly"): "other", (None, "monthly"): "whole"}
    assert [r.headline for r in reports.listing(held, 1).collect()] == ["second", "first"] and "findings" not in reports.listing(held).columns
    bounds = spark.createDataFrame([(1, jan, dt.date(2026, 4, 9)), (2, feb, feb)], "account long, first date, last date")
    due = reports.missing(bounds, reports.existing_periods(held), dt.date(2026, 4, 2)).orderBy("account", "period_start").collect()
    assert [(r.account, r.period_start.month) for r in due] == [(1, 3), (2, 2)]


def test_sync_runs(spark, tmp_path, monkeypatch):
    store = versions.Store(spark, str(tmp_path / "store"))
    raw = spark.createDataFrame(
        [(1, 10, 7, T0, "Buy", 2, Decimal(5)), (2, 10, 7, T0 + dt.timedelta(hours=1), "Sell", 2, Decimal(6)), (3, 11, 7, T0, "Buy", 1, Decimal(5)), (4, 10, 8, T0, "Buy", 1, Decimal(5))],
        "id long, order_id long, contract_id long, ts timestamp, action string, qty long, price decimal(20,8)",
    )
    orders = spark.createDataFrame([(10, 1), (11, 2)], "order_id long, account long")
    spec = spark.createDataFrame([(7, "click", 1.0)], "contract_id long, symbol string, tick_value double")
    fees = spark.createDataFrame([(i, Decimal("0.5"), Decimal("0.1")) for i in (1, 2, 3, 4)], "id long, commission decimal(20,8), fees decimal(20,8)")
    run = lambda known: sync.sync(store, raw, orders, spec, fees, spark.createDataFrame([(k,) for k in known], "account long"), "2026-03-09 00:00:00", views.instruments(spark))
    run([1])
    assert sync.cursor(store) == 2  # account 2 isn't known, so 3 holds the cursor
    t = positions.trades(store, views.instruments(spark)).collect()
    assert [(r.account, r.status, float(r.net)) for r in t] == [(1, "closed", 2 * 50 - 1 - 0.2)]
    run([1, 2])
    assert sync.cursor(store) == 3 and store.read("fills").count() == 3  # 4 has no contract
    with monkeypatch.context() as m:
        m.setattr(positions, "ingest", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run([1, 2])
    lines = store.read("runs").orderBy("run").collect()
    assert [(r.run, r.status, r.received, r.mapped, r.waiting, r.unknown, r.cursor_to) for r in lines] == [(1, "done", 4, 2, 1, 1, 2), (2, "done", 2, 1, 1, 0, 3), (3, "failed", None, None, None, None, 3)]
    assert sync.by_account(spark.createDataFrame([(1, "x", None), (2, "x", "why")], "account long, symbol string, reason string"), orders.select("account")).count() == 2
    store.commit(replace={}, cursor="junk")
    assert sync.cursor(store) == 0
