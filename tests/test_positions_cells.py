"""Positions in cells of one state: calls a batch makes, and starts whose rows come in parts."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd

from sparkfolio.operators import fifo
from sparkfolio.sources import versions, views
from sparkfolio.streaming import positions

T0 = dt.datetime(2026, 3, 5, 14, 0)


class Cells:
    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_a_cell_is_read_and_written_once_a_batch():
    state, run = Cells(), positions.Resume()
    run.init(state)
    rows = [(0, str(i % 300), "click", str(i), i, "buy" if i < 600 else "sell", Decimal(1), Decimal(5), Decimal(0), Decimal(0)) for i in range(900)]
    columns = ["cell", *positions._FILL]
    kinds = []
    for part in (rows[:600], rows[600:], rows[:1]):
        out = next(run.handleInputRows((0,), iter([pd.DataFrame(part, columns=columns)]), None))
        kinds.append(out["kind"].value_counts().to_dict())
    assert kinds == [{"fill": 600, "open": 300}, {"fill": 300, "open": 300}, {"late": 1, "open": 1}]
    assert state.calls == 5 and len(state.held) == 1  # the late fill changes nothing


def test_a_start_with_more_lots_than_a_batch_of_rows(spark, tmp_path):
    rng = random.Random(4)
    row = lambda i, side: (2**60 + i % 2, "click", i, T0 + dt.timedelta(minutes=i), side, Decimal(1), Decimal(rng.randint(100, 200)) / 4, Decimal("0.25"), Decimal("0.02"))
    rows = [row(i, "buy") for i in range(60)] + [row(i, "sell") for i in range(60, 90)]
    fills = spark.createDataFrame(rows, positions.FILL)
    store = versions.Store(spark, str(tmp_path / "store"))
    positions.ingest(store, fills.filter("fill_id < 60"), views.instruments(spark))
    spark.createDataFrame(rows[60:], positions.FILL).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(positions.FILL).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        positions.run(spark, source, store, str(tmp_path / "ck"), instruments=views.instruments(spark), restart=True).awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = lambda df: sorted(str([x.normalize() if isinstance(x, Decimal) else x for x in r]) for r in df.collect())
    assert store.value("batch fills") == 0
    assert plain(positions.trades(store, views.instruments(spark))) == plain(fifo.trades(fills, views.instruments(spark)))
