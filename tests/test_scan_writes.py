"""A large input without a large key: running values write no table of it."""

from pyspark.sql import functions as F

from sparkfolio.operators import scan


def test_nothing_is_written_without_a_large_key(spark, monkeypatch):
    t = spark.range(300).select((F.col("id") % 30).alias("k"), "id", (F.col("id") % 7).alias("x"))
    writes, real = [], scan.written
    monkeypatch.setattr(scan, "written", lambda df: writes.append(1) or real(df))
    plain = scan.running(t, ["k"], ["id"], {"s": ("sum", F.col("x"))}, small=1 << 40)
    got = scan.running(t, ["k"], ["id"], {"s": ("sum", F.col("x"))}, rows=100, small=0)
    assert not writes and sorted(got.collect()) == sorted(plain.collect())
    cut = scan.running(t, ["k"], ["id"], {"s": ("sum", F.col("x"))}, rows=5, small=0)
    assert writes and sorted(cut.collect()) == sorted(plain.collect())
