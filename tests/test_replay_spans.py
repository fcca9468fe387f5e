"""Windows meet two blocks of bars each, and see what a join with every bar would."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkfolio.operators import replay

T0 = dt.datetime(2026, 3, 5, 14, 0)


def test_spans_equal_those_of_a_join_with_every_bar(spark):
    rng = random.Random(7)
    at = lambda top: T0 + dt.timedelta(seconds=rng.randrange(-5000, top))
    bars = [("x", s, T0 + dt.timedelta(seconds=s * i), 1.0, 1.0, 1.0, 1.0) for s in (15, 60) for i in sorted(rng.sample([*range(300), *range(4000, 4100)], 150))]
    rows = [(f"t{i}", rng.choice(["x", "x", "y"]), rng.choice([15, 60, 120]), "entry", *sorted([at(70000), at(70000)])) for i in range(300)]
    rows += [(f"on{i}", "x", s, "entry", t, t) for i, (_, s, t, *_) in enumerate(bars[::20])] + [("back", "x", 15, "entry", bars[9][2], bars[2][2])]
    b = spark.createDataFrame(bars, "symbol string, seconds int, ts timestamp, open double, high double, low double, close double")
    shown = spark.createDataFrame(rows, "trade_id string, symbol string, bar_seconds int, kind string, frame_start timestamp, frame_end timestamp")
    for given in (b, b.filter("seconds = 15").drop("seconds")):
        j = replay.in_windows(shown, given, "frame_start", "frame_end").groupBy("trade_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        plain = {r.trade_id: (r.n, r.lo, r.hi) for r in j.collect()}
        found = {r.trade_id: (r.n_bars, r.first_bar, r.last_bar) for r in replay.bar_spans(shown, given, "frame_start", "frame_end").collect()}
        assert len(found) == len(rows) and found == {r[0]: plain.get(r[0], (0, None, None)) for r in rows}
