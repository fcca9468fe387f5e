"""Seeded resampling: draws are hashes of (seed, replicate, row or draw), so results don't depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import MIN_SAMPLE, ratio, reliability
from . import scan
from .draws import draws, in_order

SEED = 20260731


def draw(*parts: Column | str) -> Column:
    """A 32-bit integer from the md5 of the seed and the parts."""
    key = F.concat_ws(":", F.lit(str(SEED)), *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


#: 2^32 times the chance of a Poisson weight (mean 1) of at most 0, 1, 2, ...
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]


#: Sums by group that a task holds before it hands them on.
HELD_BYTES = 64 << 20


def poisson(u: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The Poisson weights that 32-bit integers draw."""
    w = np.zeros(u.shape, np.int8)
    for t in POISSON:
        w += u >= np.uint32(t)
    return w.astype(np.float64)


def between(u: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """1 where a row's draws are from low to high, both included, else 0."""
    w = u <= high[:, None]
    if low.any():
        w &= u >= low[:, None]
    return w.astype(np.float64)


def entry(g: Column, terms: dict[str, Column], low: Column | None = None, upto: Column | None = None) -> Column:
    """What a row adds to a group: its terms (a NULL counts as 0), in replicates whose draw is low or more and under upto."""
    low, high = F.lit(0) if low is None else low, F.lit(2**32 - 1) if upto is None else upto - 1
    return F.struct(g.alias("g"), low.cast("long").alias("low"), high.cast("long").alias("high"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(t) for t, c in terms.items()))


def weighed_sums(rows: DataFrame, entries: Column, terms: list[str], kind: str, replicates: int, weight: Callable = between) -> DataFrame:
    """(g, rep, a sum for each term): rows' terms times the weights that their draws have in each replicate.

    rows: with a trade_id; entries: an array of entry() for each of them.  A draw is a lane of the md5 of (seed, kind, block, trade_id), so draws need no
    numbering of rows and no join: tasks add up their rows by matrix products (see draws.py), and only their sums are shuffled.
    The rows are dealt out first: few small partitions would leave most cores idle while rows multiply.
    """
    spark = rows.sparkSession
    many = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(many, "trade_id").select(F.coalesce(F.concat(F.lit(":"), F.col("trade_id").cast("string")), F.lit("")).alias("_id"), entries.alias("entries"))
    prefix, reps = f"{SEED}:{kind}:", np.arange(replicates, dtype=np.int64)

    def handed(parts: dict, of: pa.DataType) -> Iterator[pa.RecordBatch]:
        for g, sums in parts.items():
            columns = [pa.array([g], of).take(pa.array(np.zeros(replicates, np.int64))), pa.array(reps), *map(pa.array, in_order(sums, replicates))]
            yield pa.RecordBatch.from_arrays(columns, ["g", "rep", *terms])
        parts.clear()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, of = {}, None
        for batch in batches:
            lists = batch.column("entries")
            each, of = lists.flatten(), lists.type.value_type.field("g").type
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            g = each.field("g").dictionary_encode("encode")
            code, keys = g.indices.to_numpy(), g.dictionary.to_pylist()
            low, high = each.field("low").to_numpy(), each.field("high").to_numpy()
            x = np.stack([each.field(t).to_numpy() for t in terms])
            some = np.flatnonzero(high >= low)
            some = some[np.argsort(code[some], kind="stable")]
            low, high = low.astype(np.uint32), high.astype(np.uint32)
            place = np.full(batch.num_rows, -1)
            for rows, u in draws(prefix, batch.column("_id").to_pylist(), replicates):
                place[:] = -1
                place[rows] = np.arange(len(rows))
                mine = some[place[row[some]] >= 0]
                for e in np.split(mine, np.flatnonzero(np.diff(code[mine])) + 1) if len(mine) else ():
                    its = place[row[e]]
                    # one entry for each row, in the rows' order: nothing to pick
                    all_rows = len(its) == len(u) and bool((its == np.arange(len(its))).all())
                    sums = x[:, e] @ weight(u if all_rows else u[its], low[e], high[e])
                    key = keys[code[e[0]]]
                    if key in parts:
                        parts[key] += sums
                    else:
                        parts[key] = sums
                if len(parts) * len(terms) * u.shape[1] * 8 > HELD_BYTES:
                    yield from handed(parts, of)
        yield from handed(parts, of)

    kind_of = dealt.schema["entries"].dataType.elementType["g"].dataType.simpleString()
    parts = dealt.mapInArrow(add, f"g {kind_of}, rep long, {', '.join(f'{t} double' for t in terms)}")
    return parts.groupBy("g", "rep").agg(*(F.sum(t).alias(t) for t in terms))


def replicate_sums(values: DataFrame, terms: dict[str, Column], group: str, kind: str, replicates: int) -> DataFrame:
    """(g, rep, a sum for each term) of a Poisson bootstrap: a row's weight in a replicate is drawn from its own hash.

    A replicate has about as many draws as there are rows, not exactly.  A NULL term counts as 0.
    """
    return weighed_sums(values, F.array(entry(F.col(group), terms)), list(terms), kind, replicates, poisson)


def bootstrap_statistic(values: DataFrame, terms: dict[str, Column], statistic: str, group: str, replicates: int = 2000, level: float = 0.95, kind: str = "boot") -> DataFrame:
    """(group, n, value, low, high, share_not_above, reliability) of any statistic that is an expression of sums of terms.

    The interval takes percentiles over replicates; it's NULL under MIN_SAMPLE rows, or if the statistic is defined in
    fewer than half of the replicates.  share_not_above: of the replicates in which it's 0 or less.
    """
    whole = values.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("_n"), *(F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).alias(t) for t, c in terms.items()))
    return intervals(whole, replicate_sums(values, terms, group, kind, replicates), statistic, group, replicates, level)


def intervals(whole: DataFrame, reps: DataFrame, statistic: str, group: str, replicates: int, level: float = 0.95) -> DataFrame:
    """bootstrap_statistic() of sums that are there: whole has (g, _n, terms), reps replicate_sums()."""
    whole = whole.select("g", "_n", F.expr(statistic).alias("value"))
    reps = reps.select("g", F.expr(statistic).alias("m"))
    tail = (1 - level) / 2
    ci = reps.groupBy("g").agg(F.percentile("m", [tail, 1 - tail]).alias("p"), F.count("m").alias("k"), F.count_if(F.col("m") <= 0).alias("below"))
    good = (F.col("_n") >= MIN_SAMPLE) & (F.col("k") * 2 >= replicates)
    return whole.join(ci, "g", "left").select(
        F.col("g").alias(group), F.col("_n").alias("n"), "value", F.when(good, F.col("p")[0]).alias("low"), F.when(good, F.col("p")[1]).alias("high"),
        F.when(good, ratio(F.col("below"), F.col("k"))).alias("share_not_above"), reliability(F.col("_n")).alias("reliability"),
    )


def bootstrap_mean(values: DataFrame, value: str, group: str, replicates: int = 10_000, level: float = 0.95) -> DataFrame:
    """bootstrap_statistic of the mean; rows without a value are left out."""
    v = values.filter(F.col(value).isNotNull())
    out = bootstrap_statistic(v, {"s": F.col(value), "w": F.lit(1.0)}, "try_divide(s, w)", group, replicates, level)
    return out.withColumnRenamed("value", "mean")


def edge_test(values: DataFrame, value: str, group: str, replicates: int = 10_000) -> DataFrame:
    """bootstrap_mean, and whether the interval lies above 0, which shows an edge; NULL where too few rows tell."""
    return bootstrap_mean(values, value, group, replicates).withColumn("edge", F.col("low") > 0).withColumnRenamed("share_not_above", "p")


def _scaled(s: str, m: str, total: str, n: str) -> Column:
    """The distance of two parts' means in units that don't depend on the parts' sizes; 0 if one part is empty."""
    rest = F.col(n) - F.col(m)
    gap = F.abs(F.col(s) / F.col(m) - (F.col(total) - F.col(s)) / rest) * F.sqrt(F.col(m) * rest / F.col(n))
    return F.when((F.col(m) > 0) & (rest > 0), gap).otherwise(0.0)


def permutation_test(values: DataFrame, value: str, label: str, permutations: int = 1000, kind: str = "perm") -> DataFrame:
    """Two-sided p of each label's mean against that of all other rows, (k + 1) / (permutations + 1).

    In a replicate each row's hash draws its label, with the labels' shares as chances; one draw serves all labels, so
    partitions add up counts and sums by label, and no replicate is ever sorted.  Labels' sizes vary about their own, so
    distances of means are compared in units of their size.  Rows without a label count in the rest.  The labels, not the
    rows, are listed on the driver.
    """
    found = permutation_tests(values, value, {label: F.col(label)}, permutations, kind)
    return found.select(F.col("key").alias(label), "n", "difference", "p")


def permutation_tests(values: DataFrame, value: str, labels: dict[str, Column], permutations: int = 1000, kind: str = "perm") -> DataFrame:
    """(label, key, n, difference, p): permutation_test() of several labels, whose keys are of one type, in one pass: a row's hash serves all of them."""
    names = list(labels)
    v = values.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), "trade_id", *(labels[d].alias(f"_l{j}") for j, d in enumerate(names)))
    each = F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"_l{j}").alias("g")) for j in range(len(names))))
    own = v.select("x", F.explode(each).alias("e")).groupBy("e.j", "e.g").agg(F.count("*").alias("n"), F.sum("x").alias("s")).orderBy("j", F.col("g").asc_nulls_last()).collect()  # one row a key
    out, entries, upto, before = [], [], 0, None
    tn, ts = sum(r["n"] for r in own if r["j"] == 0), sum(r["s"] for r in own if r["j"] == 0)
    for i, r in enumerate(own):
        low = upto if r["j"] == before else 0
        upto, before = low + r["n"], r["j"]
        if r["g"] is not None and MIN_SAMPLE <= r["n"] <= tn - MIN_SAMPLE:
            out.append((i, names[r["j"]], r["g"], r["n"], r["s"], tn, ts))
            entries.append(entry(F.lit(i), {"pn": F.lit(1), "ps": F.col("x")}, F.lit(low * 2**32 // tn), F.lit(upto * 2**32 // tn)))
    schema = f"i int, label string, key {v.schema['_l0'].dataType.simpleString()}, n long, s double, tn long, ts double"
    real = values.sparkSession.createDataFrame(out, schema).withColumn("d", _scaled("s", "n", "ts", "tn"))
    if entries:
        sums = weighed_sums(v, F.array(*entries), ["pn", "ps"], kind, permutations).withColumnRenamed("g", "i")
    else:
        sums = values.sparkSession.createDataFrame([], "i int, rep long, pn double, ps double")
    hit = sums.join(F.broadcast(real), "i").groupBy("i").agg(F.count_if(_scaled("ps", "pn", "ts", "tn") >= F.col("d") * (1 - 1e-9)).alias("k"))
    gap = F.col("s") / F.col("n") - (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    return real.join(hit, "i", "left").select("label", "key", "n", gap.alias("difference"), ((F.coalesce("k", F.lit(0)) + 1) / F.lit(permutations + 1)).alias("p"))


def _picks(groups: DataFrame, kind: str, replicates: int, draws: Column) -> DataFrame:
    """(g, rep, k, i): per group and replicate so many draws k of a number i under n."""
    each = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), draws.cast("long") - 1)))
    return each.select("g", "n", "rep", "k", F.pmod(draw(F.lit(kind), "g", "rep", "k"), F.col("n")).alias("i"))


def _numbered(values: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Values numbered in their group, and the groups of at least MIN_SAMPLE values."""
    v = values.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("decimal(20,8)").alias("x"), "trade_id")
    v = v.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy("trade_id")) - 1)
    return v, v.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SAMPLE)


def paths(values: DataFrame, value: str, group: str, iterations: int = 5000, length: int = 100, ruin: float | None = None) -> DataFrame:
    """(group, rep, final, max_drawdown, ruined): resampled futures of ``length`` values; a path ends where its sum first
    is at or below -ruin.  Rows grow with iterations x length, not with the values."""
    v, groups = _numbered(values, value, group)
    steps = _picks(groups, "path", iterations, F.lit(length)).join(v.select("g", "i", "x"), ["g", "i"])
    order = W.partitionBy("g", "rep").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    s = steps.withColumn("equity", F.sum("x").over(order))
    over = F.lit(False) if ruin is None else F.col("equity") <= F.lit(-ruin)
    s = s.withColumn("peak", F.greatest(F.lit(0), F.max("equity").over(order))).withColumn("over", over)
    s = s.withColumn("ended", F.coalesce(F.max(F.col("over").cast("int")).over(W.partitionBy("g", "rep").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter("ended = 0")
    out = s.groupBy("g", "rep").agg(F.max_by("equity", "k").alias("final"), F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.max("over").alias("ruined"))
    return out.withColumnRenamed("g", group)


def path_summary(p: DataFrame, group: str) -> DataFrame:
    """Percentiles of final equity and drawdown, chance of loss and of ruin, per group of paths()."""
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    a = p.groupBy(group).agg(F.count("*").alias("iterations"), F.percentile("final", q).alias("f"), F.percentile("max_drawdown", q).alias("d"), F.count_if(F.col("final") < 0).alias("l"), F.count_if("ruined").alias("r"))
    cols = [F.col(c)[i].alias(f"{name}_p{int(x * 100)}") for c, name in (("f", "final"), ("d", "drawdown")) for i, x in enumerate(q)]
    return a.select(group, "iterations", *cols, ratio(F.col("l"), F.col("iterations")).alias("p_loss"), ratio(F.col("r"), F.col("iterations")).alias("p_ruin"))


def risk_of_ruin(values: DataFrame, value: str, group: str, equity: float, fraction: float = 0.5, iterations: int = 5000) -> DataFrame:
    return path_summary(paths(values, value, group, iterations, 1000, equity * fraction), group).select(group, "p_ruin")


def chance_of_profit(values: DataFrame, value: str, group: str, iterations: int = 5000) -> DataFrame:
    return path_summary(paths(values, value, group, iterations, 100), group).select(group, (1 - F.col("p_loss")).alias("p_profit"))


def two_tails(lo: Column, hi: Column, replicates: int) -> Column:
    """Twice the smaller tail, zero in both, at least 1 / replicates and at most 1."""
    return F.least(F.lit(1.0), F.greatest(2 * F.least(lo, hi) / F.lit(replicates), F.lit(1 / replicates)))


def paired_test(values: DataFrame, delta: str, group: str, replicates: int = 10_000) -> DataFrame:
    """Are the differences robust to which rows occurred?  p is two_tails() of the bootstrap sums; effect is the mean in
    units of the differences' own deviation."""
    v = values.filter(F.col(delta).isNotNull())
    x = F.col(delta).cast("double")
    real = v.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("difference"), F.stddev_samp(x).alias("sd"))
    tails = replicate_sums(v, {"s": x}, group, "pair", replicates).groupBy(F.col("g").alias(group)).agg(F.count_if(F.col("s") <= 1e-9).alias("lo"), F.count_if(F.col("s") >= -1e-9).alias("hi"))
    p = F.when(F.col("n") >= MIN_SAMPLE, two_tails(F.col("lo"), F.col("hi"), replicates))
    return real.join(tails, group, "left").select(group, "n", "difference", ratio(F.col("difference"), F.col("sd")).alias("effect"), p.alias("p"))


MIN_BLOCKS = 10


def block_skill(predictions: DataFrame, replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """One row: skill against predicting the mean, and its interval when whole sessions are drawn again.

    predictions: (session, predicted, actual).  A session comes down to four sums, so a replicate is a sum of drawn
    sessions' sums.  The interval takes the value of rank floor(f * n), and is NULL under MIN_BLOCKS sessions or if
    fewer than half the replicates have a skill.
    """
    y, e = F.col("actual").cast("double"), F.col("actual").cast("double") - F.col("predicted").cast("double")
    blocks = predictions.groupBy("session").agg(F.count("*").alias("m"), F.sum(e * e).alias("e"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"))
    blocks = blocks.withColumn("i", F.row_number().over(W.orderBy("session")) - 1)  # sessions are days of the calendar
    sums = [F.sum(c).alias(c) for c in ("m", "e", "y", "yy")]
    base = F.col("yy") - F.col("y") * F.col("y") / F.col("m")
    skill = F.when((F.col("m") >= 2) & (base > 1e-12), 1 - F.col("e") / base)
    n = blocks.agg(F.lit("").alias("g"), F.count("*").alias("n")).filter(F.col("n") >= MIN_BLOCKS)
    reps = _picks(n, "block", replicates, F.col("n")).join(blocks, "i").groupBy("rep").agg(*sums).select(skill.alias("s")).filter("s is not null")
    at = lambda f: F.element_at("a", F.least(F.floor(F.lit(f) * F.size("a") + 1e-9).cast("int") + 1, F.size("a")))
    tail = (1 - level) / 2
    ci = reps.agg(F.array_sort(F.collect_list("s")).alias("a"))  # one value a replicate
    ci = ci.select(*(F.when(F.size("a") >= max(replicates // 2, 1), at(f)).alias(c) for f, c in ((tail, "low"), (1 - tail, "high"))))
    one = blocks.agg(F.count("*").alias("sessions"), *sums).select("sessions", F.col("m").alias("predictions"), skill.alias("skill"))
    return one.withColumn("j", F.lit(0)).join(ci.withColumn("j", F.lit(0)), "j").drop("j").withColumn("established", F.coalesce(F.col("low") > 0, F.lit(False)))


def calibration(predictions: DataFrame, replicates: int = 1000) -> DataFrame:
    """One row: count-weighted calibration error over ten bins, and the share of ``replicates`` in which outcomes that follow
    the predictions themselves are off as much, (k + 1) / (replicates + 1).  predictions: (trade_id, predicted, actual)."""
    bin_ = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("p") * 10))).cast("int").alias("bin")
    x = predictions.select("trade_id", F.col("predicted").cast("double").alias("p"), F.col("actual").cast("int").alias("y"))
    bins = x.groupBy(bin_).agg(F.count("*").alias("m"), F.sum("p").alias("p"), F.sum("y").alias("y"))  # ten rows
    off = lambda y: (F.sum(F.abs(F.col("p") - F.col(y))) / F.sum("m")).alias
    real = bins.agg(off("y")("ece"), F.sum("m").alias("n")).withColumn("j", F.lit(0))
    # an outcome is 1 where the draw is under p * 2^32
    upto = F.when(F.col("p") >= 1, F.lit(2**32)).when(F.col("p") > 0, F.ceil(F.col("p") * F.lit(float(1 << 32)))).otherwise(0)
    sims = weighed_sums(x, F.array(entry(bin_, {"hits": F.lit(1)}, None, upto)), ["hits"], "cal", replicates)
    each = bins.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    each = each.join(sims.withColumnRenamed("g", "bin"), ["bin", "rep"], "left").withColumn("hits", F.coalesce("hits", F.lit(0.0)))
    null = each.groupBy("rep").agg(off("hits")("null_ece")).select("null_ece").withColumn("j", F.lit(0))
    hit = null.join(F.broadcast(real), "j").groupBy("ece", "n").agg(F.count_if(F.col("null_ece") >= F.col("ece") - 1e-9).alias("k"))  # real has one row
    return hit.select("n", "ece", ((F.col("k") + 1) / F.lit(replicates + 1)).alias("p"))


def two_sample(values: DataFrame, kind: str, permutations: int = 1000) -> DataFrame:
    """Per test: numbers and means of the rows inside and outside, and the two-sided p of their difference (NULL under
    MIN_SAMPLE rows on a side).  values: (test, now, x, trade_id); rows with a NULL are left out.

    In a replicate each row's hash tells whether it is inside, with the inside's share as the chance; see permutation_test().
    """
    # read several times: written once, so that what it is computed from isn't computed again each
    v = scan.written(values.select("test", "now", F.col("x").cast("double").alias("x"), "trade_id").dropna(subset=["test", "now", "x"]))
    side = lambda f, b: f(F.when(F.col("now") == F.lit(b), F.col("x")))
    real = v.groupBy("test").agg(
        side(F.count, True).alias("n_in"), side(F.count, False).alias("n_out"), side(F.avg, True).alias("mean_in"), side(F.avg, False).alias("mean_out"), F.sum("x").alias("ts"),
        F.coalesce(side(F.sum, True), F.lit(0.0)).alias("s"), F.count("*").alias("tn"),
    )
    bound = F.floor(F.col("n_in") * F.lit(2.0**32) / F.col("tn"))
    tested = real.filter((F.col("n_in") >= MIN_SAMPLE) & (F.col("n_out") >= MIN_SAMPLE)).withColumn("d", _scaled("s", "n_in", "ts", "tn")).select("test", "ts", "tn", "d", bound.alias("bound"))
    # one row a test: dimensions of a scan, never rows of data
    each = v.join(F.broadcast(tested.select("test", "bound")), "test").select("trade_id", entry(F.col("test"), {"pn": F.lit(1), "ps": F.col("x")}, None, F.col("bound")).alias("e"))
    rows = each.groupBy("trade_id").agg(F.collect_list("e").alias("entries"))  # one hash serves all tests
    reps = weighed_sums(rows, F.col("entries"), ["pn", "ps"], kind, permutations).withColumnRenamed("g", "test").join(F.broadcast(tested), "test")
    p = reps.groupBy("test").agg(((F.count_if(_scaled("ps", "pn", "ts", "tn") >= F.col("d") * (1 - 1e-9)) + 1) / F.lit(permutations + 1)).alias("p"))
    return real.drop("ts", "s", "tn").join(p, "test", "left")
