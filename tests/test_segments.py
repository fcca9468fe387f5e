"""Segments with their tests: one pass over the trades."""

from pyspark.sql import functions as F

from sparkfolio.operators import analytics as A


def test_segments_reconstruct_trades_once(spark):
    rows = [(f"t{i}", float(i % 9 - 3), "ab"[i % 2], "xyz"[i % 3] if i % 4 else None) for i in range(200)]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    t = spark.createDataFrame(rows, "trade_id string, net double, g string, k string")
    seen = t.mapInArrow(counted, t.schema)
    out = A.segments(seen, {"one": F.col("g"), "two": F.col("k")}, 1000, 100).collect()
    assert len(out) == 5 and reads.value == 200  # each part of the result computed all trades again
