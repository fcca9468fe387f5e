"""Numbers as texts, rounded as the SQL rounds doubles."""

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import exprs as X


def test_halves_are_those_of_the_double(spark):
    # round_even() of DuckDB gives these; rounding a double's shortest text made 1.015 to 1.02
    rows = [(1.015, "1.01"), (0.125, "0.12"), (2.675, "2.68"), (-1.015, "-1.01"), (0.0, "0.00")]
    got = spark.createDataFrame(rows, "x double, text string").withColumn("made", X.plain(F.col("x"), 2)).collect()
    assert [r["made"] for r in got] == [r["text"] for r in got]


def test_repriced_results_are_rounded_likewise(spark):
    from sparkfolio.operators import whatif

    # 1.015 is a little under the half as a double: 1.01, as the SQL has it, where its shortest text made it 1.02
    t = spark.sql("select 1 trade_id, date'2024-01-01' session_date, timestamp'2024-01-01' opened_at, 1.015D net, 1 entry_hour, 1.0D r_multiple, 0.0D mae_r, 2.0D mfe_r")
    assert [r["simulated"] for r in whatif.simulate(t, [{"name": "a", "target_r": 1.0}]).collect()] == [1.01]


def test_small_and_missing_values_are_shown_as_the_sql_shows_them(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from sparkfolio.plans.registry import ORACLE, QUERIES

    # nets just under 0 (trimmed is -0), logistic values on halves of the ninth place, unknown nets, no risk, halves of R, sums beyond 2^53 in 10^-8
    lines = [[(0.01, 0.06)], [(0.14, 0.06)], [(0.33, 0.04)], [(None, 0.01)], [(0.0, 0.01)], [(5.0, None)], [(1.0, 0.01), (1999.0, 0.02)], [(98765432109.87, 0.04)], [(1000.0, 0.05)]]
    rows = [(i, p, d) for i, of in enumerate(lines) for p, d in of]
    t = spark.createDataFrame(rows, "l_orderkey long, l_extendedprice double, l_discount double")
    t = t.withColumns({"l_quantity": F.lit(1.0), "l_shipdate": F.lit("1996-01-05").cast("timestamp_ntz")})
    o = spark.range(len(lines)).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("1996-01-02").cast("timestamp_ntz").alias("o_orderdate"))
    for name, df in (("lineitem", t), ("orders", o)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, QUERIES["f_s3_texts"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        for name in ("lineitem", "orders"):
            c.execute(f"CREATE VIEW {name} AS FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        assert got == sorted(c.execute(ORACLE["f_s3_texts"]).fetchall())
    assert got[0][-1] == "-0" and got[3][3:6] == (None, None, None)
