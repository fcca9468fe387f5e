"""The scan for patterns: behaviours and clusters, tested as one family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import two_sample
from .sequences import benjamini_hochberg, detectors, typical_size

# Least confidence of a proposed member, significance.
CONFIDENCE, ALPHA = 0.55, 0.05


def scan(state: DataFrame, clustered: DataFrame | None = None, permutations: int = 1000) -> DataFrame:
    """(test, n_in, n_out, mean_in, mean_out, p, q, found) of every behaviour and cluster; found: q is at most ALPHA.

    state: session_state() of the trades; clustered: (trade_id, cluster), at most a handful of clusters.  Each cluster's
    P&L is held against that of all other clustered trades.
    """
    each = F.array(*(F.struct(F.lit(k).alias("test"), p.alias("now"), v.alias("x")) for k, (p, v) in detectors(typical_size(state)).items()))
    v = state.select("trade_id", F.explode(each).alias("e")).select("trade_id", "e.test", "e.now", "e.x")
    if clustered is not None:
        names = [r["cluster"] for r in clustered.select("cluster").distinct().orderBy("cluster").collect()]  # one row a cluster
        if names:
            tests = F.array(*(F.struct(F.lit(f"cluster_{c}").alias("test"), (F.col("cluster") == c).alias("now")) for c in names))
            own = clustered.select("trade_id", "cluster").join(state.select("trade_id", F.col("net").cast("double").alias("x")), "trade_id")
            v = v.unionByName(own.select("trade_id", "x", F.explode(tests).alias("e")).select("trade_id", "e.test", "e.now", "x"))
    q = benjamini_hochberg(two_sample(v, "scan", permutations), "p")
    return q.withColumn("found", F.coalesce(F.col("q") <= ALPHA, F.lit(False)))


def proposals(clustered: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """(cluster, size, trade_id, confidence): a row for each member sure enough to be offered as a set-up's trade."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("size"))
    return clustered.filter(F.col("confidence") >= least).join(F.broadcast(sizes), "cluster").select("cluster", "size", "trade_id", "confidence")  # one row a cluster
