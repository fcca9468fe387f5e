"""Draws of the resampling operators: the hashes they are, and that rows aren't multiplied by replicates in Spark."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sparkfolio.operators import resample as R
from sparkfolio.operators.draws import draws, in_order


def by_hand(kind, rep, trade_id):
    h = hashlib.md5(f"{R.SEED}:{kind}:{rep // 4}:{trade_id}".encode()).hexdigest()
    return int(h[8 * (rep % 4) : 8 * (rep % 4) + 8], 16)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_are_lanes_of_md5():
    ids = ["", ":1", ":22", ":é", *(":" + "x" * n for n in (29, 30, 31, 47, 48, 60, 200))]
    got = {}
    for rows, u in draws("20260731:boot:", ids, 4403):
        got |= {int(r): x for r, x in zip(rows, in_order(u, 4403))}
    assert sorted(got) == list(range(len(ids)))
    for r, text in enumerate(ids):
        for rep in (0, 3, 4, 39, 40, 399, 400, 3999, 4000, 4402):
            h = hashlib.md5(f"20260731:boot:{rep // 4}{text}".encode()).hexdigest()
            assert int(h[8 * (rep % 4) : 8 * (rep % 4) + 8], 16) == got[r][rep]


def test_bootstrap_sums_without_a_row_for_each_block(spark):
    rows = [(f"t{i}", "ab"[i % 2] if i % 7 else None, float(i % 5 - 2)) for i in range(90)]
    t = spark.createDataFrame(rows, "trade_id string, g string, x double")
    sums = R.replicate_sums(t, {"s": F.col("x"), "w": F.lit(1.0)}, "g", "boot", 41)
    got = {(r["g"], r["rep"]): (r["s"], r["w"]) for r in sums.collect()}
    weight = lambda u: sum(u >= k for k in R.POISSON)
    for g in ("a", "b", None):
        for rep in range(41):
            w = [(weight(by_hand("boot", rep, i)), x) for i, k, x in rows if k == g]
            assert np.allclose(got[g, rep], (sum(a * x for a, x in w), sum(a for a, _ in w)))
    assert len(got) == 3 * 41 and "Generate" not in plan(sums)  # rows times blocks were rows of Spark


def test_permutations_of_several_labels_are_those_of_each(spark):
    rows = [(i, "abc"[i % 3] if i % 11 else None, "xy"[i * i % 5 // 3], float(i % 13)) for i in range(120)]
    t = spark.createDataFrame(rows, "trade_id int, g string, k string, v double")
    both = {(r["label"], r["key"]): (r["n"], round(r["p"], 9)) for r in R.permutation_tests(t, "v", {"g": F.col("g"), "k": F.col("k")}, 200).collect()}
    each = {(c, r[c]): (r["n"], round(r["p"], 9)) for c in "gk" for r in R.permutation_test(t, "v", c, 200).collect()}
    assert both == each and len(both) == 5
