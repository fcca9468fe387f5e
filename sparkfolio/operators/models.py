"""Feature matrices, ridge models, walk-forward folds, clusters and exit selection.

A ridge fit needs nothing but sums of products, so each session comes down to one small matrix of them: every fold,
penalty and inner split is then arithmetic on these, and the rows are read once to sum and once to predict.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ratio
from . import scan

# Coverage of a feature, penalties and the one without a choice, folds' first sessions and step for models
# and exits, targets in R, least scored trades, stable share of folds, bounds of a probability.
COVERAGE, PENALTIES, PENALTY = 0.7, (0.1, 1.0, 10.0, 100.0), 10.0
MODEL_FOLDS, EXIT_FOLDS = (20, 5), (25, 10)
TARGETS = (1.0, 1.5, 2.0, 3.0, 4.0)
MIN_SCORED, STABLE, CLAMP = 40, 0.6, (0.001, 0.999)


def usable(trades: DataFrame, features: dict[str, Column]) -> list[str]:
    """Features known for COVERAGE of the rows and not constant."""
    row = trades.agg(F.count("*").alias("n"), *(f.alias(f"{s}_{k}") for k, c in features.items() for s, f in (("n", F.count(c)), ("lo", F.min(c)), ("hi", F.max(c))))).first()
    return [k for k in features if row["n"] and row[f"n_{k}"] / row["n"] >= COVERAGE and row[f"lo_{k}"] != row[f"hi_{k}"]]


def feature_matrix(trades: DataFrame, features: dict[str, Column], key: str = "trade_id") -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Standardised usable features of the rows that have all of them, and each feature's (centre, scale)."""
    kept = usable(trades, features)
    rows = trades.select(key, *(features[k].cast("double").alias(k) for k in kept)).dropna()
    if not kept:
        return rows.limit(0), {}
    s = rows.agg(*(f(k).alias(f"{n}_{k}") for k in kept for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    scales = {k: (s[f"m_{k}"] or 0.0, s[f"s_{k}"] or 1.0) for k in kept}
    return rows.select(key, *(((F.col(k) - m) / d).alias(k) for k, (m, d) in scales.items())), scales


def folds(rows: DataFrame, first: int, step: int, session: str = "session_date") -> DataFrame:
    """(session, i, fold): fold 0 is the first ``first`` sessions; fold f tests ``step`` ones and trains on all before."""
    days = rows.filter(F.col(session).isNotNull()).select(session).distinct().withColumn("i", F.row_number().over(W.orderBy(session)))  # days of the calendar
    return days.withColumn("fold", F.greatest(F.lit(0), F.floor((F.col("i") - 1 - first) / step) + 1).cast("int"))


def moments(rows: DataFrame, columns: list[str], label: str, by: str) -> list[tuple[object, np.ndarray]]:
    """Per value of ``by``, in order, the sums of products of (1, columns, label): one pass, partial sums before the shuffle."""
    z = [F.lit(1.0), *(F.col(c) for c in columns), F.col(label).cast("double")]
    pairs = [(a, b) for a in range(len(z)) for b in range(a, len(z))]
    out = []
    for r in rows.groupBy(by).agg(*(F.sum(z[a] * z[b]).alias(f"_{a}_{b}") for a, b in pairs)).orderBy(by).collect():  # one row a session
        m = np.zeros((len(z), len(z)))
        for a, b in pairs:
            m[a, b] = m[b, a] = r[f"_{a}_{b}"]
        out.append((r[by], m))
    return out


def standardiser(m: np.ndarray) -> np.ndarray:
    """The map of (1, x, y) to (1, z, y), z of mean 0 and sample deviation 1 over the summed rows."""
    n, t = m[0, 0], np.eye(len(m))
    for k in range(1, len(m) - 1):
        mean = m[0, k] / n
        var = (m[k, k] - n * mean * mean) / (n - 1) if n > 1 else 0.0
        d = var**0.5 if var > 1e-18 else 1.0
        t[k, k], t[k, 0] = 1 / d, -mean / d
    return t


def ridge(m: np.ndarray, penalty: float) -> np.ndarray | None:
    """Coefficients (intercept first, unpenalised), or None where the system is singular."""
    k = len(m) - 1
    a = m[:k, :k] + penalty * np.diag([0.0] + [1.0] * (k - 1))
    try:
        return np.linalg.solve(a, m[:k, k])
    except np.linalg.LinAlgError:
        return None


def squared_error(m: np.ndarray, beta: np.ndarray) -> float:
    k = len(m) - 1
    return (m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta) / m[0, 0]


def choose_penalty(sessions: list[np.ndarray]) -> float:
    """The penalty of least error on the last 30% of the sessions when fitted on those before."""
    if len(sessions) < 4:
        return PENALTY
    at = int(len(sessions) * 0.7)
    inner, rest = sum(sessions[:at]), sum(sessions[at:])
    t = standardiser(inner)
    inner, rest = t @ inner @ t.T, t @ rest @ t.T
    errors = [(squared_error(rest, b), p) for p in PENALTIES if (b := ridge(inner, p)) is not None]
    return min(errors)[1] if errors else PENALTY


def fold_models(days: list[tuple], per: dict, width: int) -> list[dict]:
    """The ridge model of each fold from 1 on: fold, penalty, beta (intercept first, in the columns' units), rows and mean label it
    was fitted on.  days: (session, fold) in order; per: a session's moments().  A fold whose system is singular has none."""
    out, held, at = [], [], 0
    for fold in sorted({f for _, f in days} - {0}):
        while at < len(days) and days[at][1] < fold:
            if days[at][0] in per:
                held.append(per[days[at][0]])
            at += 1
        if held:
            m = sum(held)
            penalty, t = choose_penalty(held), standardiser(m)
            beta = ridge(t @ m @ t.T, penalty)
            if beta is not None:
                out.append({"fold": fold, "penalty": penalty, "beta": [float(x) for x in beta @ t[:width, :width]], "rows": int(m[0, 0]), "mean": float(m[0, -1] / m[0, 0])})
    return out


def linear(columns: list[str], beta: str = "beta") -> Column:
    """What a model says of a row: its intercept and its coefficients times ``columns``."""
    out = F.element_at(beta, 1)
    for i, c in enumerate(columns, 2):
        out = out + F.element_at(beta, i) * F.col(c)
    return out


def calendar(rows: DataFrame, session: str, first: int, step: int) -> list[tuple]:
    """(session, number, fold) of all sessions in order: a row a day of the calendar, so it may stand on the driver."""
    return [(r[session], r["i"], r["fold"]) for r in folds(rows, first, step, session).orderBy(session).collect()]


def walk_forward(rows: DataFrame, columns: list[str], label: str, session: str = "session_date", first: int = MODEL_FOLDS[0], step: int = MODEL_FOLDS[1]) -> DataFrame | None:
    """(all columns, fold, penalty, predicted) of the rows in tested sessions; None without enough sessions.

    Rows with a missing feature or label aren't scored; a fold whose system is singular isn't either.
    """
    rows = rows.filter(F.col(session).isNotNull())
    full = rows.dropna(subset=[*columns, label])
    per = dict(moments(full, columns, label, session))
    days = [(d, f) for d, _, f in calendar(rows, session, first, step)]
    if len(days) < first + 1:
        return None
    of = {m["fold"]: m for m in fold_models(days, per, len(columns) + 1)}
    models = [(d, f, of[f]["penalty"], of[f]["beta"]) for d, f in days if f in of]
    schema = T.StructType([T.StructField("_day", full.schema[session].dataType), T.StructField("fold", T.IntegerType()), T.StructField("penalty", T.DoubleType()), T.StructField("beta", T.ArrayType(T.DoubleType()))])
    model = full.sparkSession.createDataFrame(models, schema)
    met = full.join(F.broadcast(model), F.col(session) == F.col("_day"))  # one row a day
    return met.withColumn("predicted", linear(columns)).drop("_day", "beta")


#: Rows that meet all models as one matrix product in a worker.
MATRIX_ROWS = 128


def _model_sums(dated: DataFrame, columns: list[str], low: str, high: str | None, models: list[tuple], errors: bool) -> dict:
    """Per model (fold, penalty, beta) the sums over the rows with ``low`` <= fold (and fold < ``high``): of squared errors and rows with
    ``errors``, else the gradient and the Hessian of the log-likelihood.

    dated: rows with ``_n``, how many there are of each.  A batch of rows meets all models in matrix products, its rows masked by fold; what
    leaves a task is a row a model.
    """
    models, numbers = zip(*sorted(zip(models, range(len(models))), key=lambda m: m[0][0]))
    ends, beta = np.array([f for f, *_ in models]), np.array([b for *_, b in models]).T
    k = len(columns) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["e", "n"] if errors else [*(f"g_{i}" for i in range(k)), *(f"h_{i}_{j}" for i, j in pairs)]

    def run(batches):
        import pyarrow as pa

        total = np.zeros((len(names), len(ends)))
        for batch in batches:
            data = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(batch.num_columns)])
            for a in range(0, len(data), MATRIX_ROWS):
                part = data[a : a + MATRIX_ROWS]
                x, y, w = np.column_stack([np.ones(len(part)), part[:, : k - 1]]), part[:, k - 1, None], part[:, -1, None]
                # models that some row of the part belongs to: rows come by fold, so they are few
                these = slice(np.searchsorted(ends, part[:, k].min()), len(ends) if high is None else np.searchsorted(ends, part[:, k + 1].max()))
                upto = ends[None, these]
                if upto.size == 0:
                    continue
                p = x @ beta[:, these]
                np.clip(p, -700, 700, out=p)
                np.exp(np.negative(p, out=p), out=p)
                p += 1
                np.reciprocal(p, out=p)
                inside = (upto >= part[:, k, None]) * w
                if high is not None:
                    inside *= upto < part[:, k + 1, None]
                if errors:
                    total[0, these] += (inside * (y - p) ** 2).sum(axis=0)
                    total[1, these] += inside.sum(axis=0)
                else:
                    total[:k, these] += x.T @ (inside * (y - p))
                    inside *= p
                    inside *= 1 - p
                    total[k:, these] += np.column_stack([x[:, i] * x[:, j] for i, j in pairs]).T @ inside
        yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers)), *map(pa.array, total)], ["m", *names])

    wanted = dated.select(*(F.col(c).cast("double") for c in columns), "_y", F.col(low).cast("double"), *([F.col(high).cast("double")] if high else []), F.col("_n").cast("double"))
    sums = wanted.mapInArrow(run, ", ".join(["m long", *(f"{n} double" for n in names)])).groupBy("m").agg(*(F.sum(n).alias(n) for n in names))
    return {r["m"]: r for r in sums.collect()}  # one row a model


def walk_forward_logistic(
    rows: DataFrame, columns: list[str], label: str, session: str = "session_date", first: int = MODEL_FOLDS[0], step: int = MODEL_FOLDS[1], iterations: int = 40, tol: float = 1e-6
) -> DataFrame | None:
    """walk_forward() for a chance: adds fold, penalty, converged and predicted to the rows in tested sessions.

    All folds and penalties take a Newton step in one pass over the rows (_model_sums); what has converged drops out, and the
    final fits start from those that chose their penalties.  A fold without both outcomes isn't scored.
    """
    rows = rows.filter(F.col(session).isNotNull())
    full = rows.dropna(subset=[*columns, label]).withColumn("_y", F.col(label).cast("double"))
    days = calendar(rows, session, first, step)
    if len(days) < first + 1:
        return None
    spark, top, k = full.sparkSession, max(f for *_, f in days), len(columns) + 1
    ends = {f: first + (f - 1) * step for f in range(1, top + 1)}
    inner = {f: int(n * 0.7) for f, n in ends.items()}
    per = dict(moments(full, columns, label, session))
    starts = [next((g for g in inner if inner[g] >= i), top + 1) for _, i, _ in days]
    kind = full.schema[session].dataType
    dates = spark.createDataFrame([(d, f, g, f + 1) for (d, _, f), g in zip(days, starts)], T.StructType([T.StructField("_day", kind), *(T.StructField(n, T.IntegerType()) for n in ("_fold", "_inner", "_first"))]))
    dated = full.join(F.broadcast(dates), F.col(session) == F.col("_day"))  # one row a day
    # every pass reads this table: equal rows of equal folds once with their number, by fold inside a part
    kept = dated.groupBy(*columns, "_y", "_inner", "_first").agg(F.count("*").alias("_n")).sortWithinPartitions("_first")
    kept = scan.written(kept)
    sums, upto = np.zeros((k + 1, k + 1)), [np.zeros((k + 1, k + 1))]
    for d, *_ in days:
        sums = sums + per[d] if d in per else sums
        upto.append(sums)

    def fit(wanted: list[tuple], start: str, last: dict[int, int]) -> dict:
        """(fold, penalty) to coefficients and whether they converged; wanted: (fold, penalty, coefficients to start from)."""
        todo, done = {}, {}
        for f, p, raw in wanted:
            m = upto[min(last[f], len(days))]
            if 0 < m[0, k] < m[0, 0]:
                t = standardiser(m)[:k, :k]
                todo[f, p] = (t, np.zeros(k) if raw is None else np.array(raw) @ np.linalg.inv(t))
        for _ in range(iterations):
            if not todo:
                break
            keys = list(todo)
            found = _model_sums(kept, columns, start, None, [(f, p, todo[f, p][1] @ todo[f, p][0]) for f, p in keys], False)
            for i, key in enumerate(keys):
                t, b = todo[key]
                r, d = found[i], key[1] * np.diag([0.0] + [1.0] * (k - 1))
                h = np.array([[r[f"h_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                try:
                    move = np.linalg.solve(t @ h @ t.T + d, t @ np.array([r[f"g_{i}"] for i in range(k)]) - d @ b)
                except np.linalg.LinAlgError:
                    del todo[key]
                    continue
                todo[key] = (t, b + move)
                if np.abs(move).max() < tol:
                    done[key] = ((b + move) @ t, True)
                    del todo[key]
        return done | {key: (b @ t, False) for key, (t, b) in todo.items()}

    tried = fit([(f, p, None) for f in ends if ends[f] >= 4 for p in PENALTIES], "_inner", inner)
    best: dict[int, tuple] = {}
    if tried:
        models = [(f, p, b) for (f, p), (b, _) in tried.items()]
        for i, r in _model_sums(kept, columns, "_first", "_inner", models, True).items():
            if r["n"]:
                best[models[i][0]] = min(best.get(models[i][0], (np.inf, 0.0)), (r["e"] / r["n"], models[i][1]))
    chosen = {f: best[f][1] if f in best else PENALTY for f in ends}
    final = fit([(f, p, tried[f, p][0] if (f, p) in tried else None) for f, p in chosen.items()], "_first", ends)
    model = spark.createDataFrame([(f, p, [float(x) for x in b], done) for (f, p), (b, done) in final.items()], "fold int, penalty double, beta array<double>, converged boolean")
    out = dated.withColumnRenamed("_fold", "fold").join(F.broadcast(model), "fold")  # one row a fold
    p = 1 / (1 + F.exp(-linear([*columns])))
    return out.withColumn("predicted", F.greatest(F.lit(CLAMP[0]), F.least(F.lit(CLAMP[1]), p))).drop("_day", "_inner", "_first", "_y", "beta")


# Least scored trades of a served model, significance of its calibration test.
SERVED, CALIBRATION_ALPHA = 50, 0.05


def gate(predictions: DataFrame, probability: bool = True, replicates: int = 1000, draws: int = 1000) -> DataFrame:
    """One row: scored, skill, low, ece, p and the first reason against serving the model (NULL: none).

    predictions: (trade_id, session, predicted, actual) out of sample.  Skill comes before calibration, which only a
    chance has.
    """
    from .resample import block_skill, calibration

    s = block_skill(predictions, replicates).select(F.lit(0).alias("_j"), F.coalesce("predictions", F.lit(0)).alias("scored"), "skill", "low", "established")
    if probability:
        s = s.join(calibration(predictions, draws).select(F.lit(0).alias("_j"), "ece", "p"), "_j", "left")
    else:
        s = s.withColumns({"ece": F.lit(None).cast("double"), "p": F.lit(None).cast("double")})
    why = F.when(F.col("scored") < SERVED, "too few scored trades").when(F.col("skill").isNull(), "skill unknown").when(F.col("skill") <= 0, "no skill").when(F.col("low").isNull(), "too few sessions").when(~F.col("established"), "skill within chance")
    if probability:
        why = why.when(F.coalesce(F.col("p") <= CALIBRATION_ALPHA, F.lit(True)), "miscalibrated")
    return s.select("scored", "skill", "low", "ece", "p", why.alias("reason"))


def fit_linear(rows: DataFrame, columns: list[str], label: str, penalty: float = 1.0) -> np.ndarray | None:
    found = moments(rows.dropna(subset=[*columns, label]).withColumn("_all", F.lit(0)), columns, label, "_all")
    return ridge(found[0][1], penalty) if found else None


def fit_logistic(rows: DataFrame, columns: list[str], label: str, penalty: float = 1.0):
    """Ridge logistic regression, intercept unpenalised; None without rows of both outcomes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    full = rows.dropna(subset=[*columns, label]).withColumn("_y", F.col(label).cast("double"))
    n = full.agg(F.count("*").alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi")).first()
    if not n["n"] or n["lo"] == n["hi"]:
        return None
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(full)
    return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=penalty / n["n"], standardization=False, maxIter=100, tol=1e-10).fit(data)


def probability(rows: DataFrame, columns: list[str], model) -> DataFrame:
    """Adds predicted: the clamped probability; NULL where a feature is missing."""
    s = F.lit(float(model.intercept))
    for c, b in zip(columns, model.coefficients, strict=True):
        s = s + F.col(c) * float(b)
    return rows.withColumn("predicted", F.when(s.isNotNull(), F.greatest(F.lit(CLAMP[0]), F.least(F.lit(CLAMP[1]), 1 / (1 + F.exp(-s))))))


def cluster(matrix: DataFrame, columns: list[str], k: int, seed: int = 20260731, key: str = "trade_id") -> DataFrame:
    """Adds cluster, distance, other (to the next centre) and confidence = other / (distance + other)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(matrix)
    centres = KMeans(k=k, featuresCol="_x", seed=seed, maxIter=100).fit(data).clusterCenters()
    away = F.array(*(F.struct(F.sqrt(sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, centre, strict=True)), F.lit(0.0))).alias("d"), F.lit(i).alias("c")) for i, centre in enumerate(centres)))
    m = matrix.withColumn("_d", F.array_sort(away)).withColumns({"cluster": F.col("_d")[0]["c"], "distance": F.col("_d")[0]["d"], "other": F.col("_d")[1]["d"]})
    return m.drop("_d").withColumn("confidence", F.coalesce(ratio(F.col("other"), F.col("distance") + F.col("other")), F.lit(0.5)))


def silhouette(clustered: DataFrame, columns: list[str], sample: int = 400, key: str = "trade_id") -> float | None:
    """Mean Euclidean silhouette of ``sample`` rows (the least hashes of their keys); a cluster of one counts 0.

    The sample is the feature: its rows stand in one array, so no pair of table rows is made.
    """
    from .resample import draw

    rows = clustered.select(key, "cluster", *columns).orderBy(draw(F.lit("sil"), key), key).limit(sample)
    x = np.array([[r["cluster"], *(r[c] for c in columns)] for r in rows.collect()])  # at most ``sample`` rows
    if len(x) < 2 or len(set(x[:, 0])) < 2:
        return None
    d = np.sqrt(((x[:, None, 1:] - x[None, :, 1:]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(x[:, 0]):
        mine = x[:, 0] == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][mine].sum() / (mine.sum() - 1)
        b = min(d[i][x[:, 0] == c].mean() for c in set(x[:, 0]) if c != own)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def shuffled(matrix: DataFrame, columns: list[str], reference: int, key: str = "trade_id", **chunks: int) -> DataFrame:
    """The matrix with each column's values dealt anew over all rows: same columns, no structure between them.

    A column's values are numbered in the order of hashes of their keys, the rows in the order of their keys, and both meet by number:
    a random permutation of the whole column.  Numbers are running counts in two levels (scan), so no task sorts the matrix.
    """
    from .resample import draw

    number = {"_i": ("count", F.lit(1))}
    out = scan.running(matrix.select(key), [], [key], number, **chunks)
    for c in columns:
        dealt = matrix.select(key, c).withColumn("_h", draw(F.lit("shuffle"), F.lit(reference), F.lit(c), key))
        out = out.join(scan.running(dealt, [], ["_h", key], number, **chunks).select("_i", c), "_i")
    return out.drop("_i")


def choose_clusters(matrix: DataFrame, columns: list[str], ks: range = range(2, 7), least: int = 5, floor: float = 0.15, references: int = 20, alpha: float = 0.05) -> tuple[DataFrame, float, float] | None:
    """(clustered rows, silhouette, p) for the k of best silhouette, or None where none is found or chance does as well."""
    best = None
    for k in ks:
        c = cluster(matrix, columns, k)
        sizes = [r["count"] for r in c.groupBy("cluster").count().collect()]  # one row a cluster
        s = silhouette(c, columns) if len(sizes) == k and min(sizes) >= least else None
        if s is not None and s >= floor and (best is None or s > best[1]):
            best = (c, s, k)
    if best is None or 1 / (references + 1) > alpha:
        return None
    null = [silhouette(cluster(shuffled(matrix, columns, i), columns, best[2]), columns) for i in range(references)]
    p = (sum(x is not None and x >= best[1] for x in null) + 1) / (references + 1)
    return (best[0], best[1], p) if p <= alpha else None


def exit_deltas(trades: DataFrame) -> DataFrame:
    """(session_date, target, n, applicable, delta): what each target would have changed, summed per session.

    trades: (session_date, r_multiple, mae_r, mfe_r, risk).  A trade that reached the target ends there; one without R or
    excursions can't be repriced.
    """
    known = F.col("r_multiple").isNotNull() & F.col("mae_r").isNotNull() & F.col("mfe_r").isNotNull()
    t = trades.filter("session_date is not null").withColumn("target", F.explode(F.array(*(F.lit(x) for x in TARGETS))))
    delta = F.when(known, F.when(F.col("mfe_r") >= F.col("target"), (F.col("target") - F.col("r_multiple")) * F.col("risk").cast("double")).otherwise(0.0))
    return t.groupBy("session_date", "target").agg(F.count("*").alias("n"), F.count(delta).alias("applicable"), F.coalesce(F.sum(delta), F.lit(0.0)).alias("delta"))


def exit_selection(trades: DataFrame, first: int = EXIT_FOLDS[0], step: int = EXIT_FOLDS[1]) -> DataFrame:
    """(fold, target, score, scored, delta): per fold the target of best mean on the sessions before (half of the trades
    repriced at least; ties to the nearer one), and what it changed on the fold's own sessions."""
    d = exit_deltas(trades)
    f = d.join(F.broadcast(folds(trades, first, step).select("session_date", "fold")), "session_date").groupBy("fold", "target").agg(*(F.sum(c).alias(c) for c in ("n", "applicable", "delta")))  # one row a day
    before = W.partitionBy("target").orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    f = f.withColumns({f"_{c}": F.sum(c).over(before) for c in ("n", "applicable", "delta")}).withColumn("score", F.when(F.col("_applicable") >= F.col("_n") * 0.5, F.round(ratio(F.col("_delta"), F.col("_applicable")), 9)))
    best = W.partitionBy("fold").orderBy(F.col("score").desc(), "target")
    f = f.filter("fold > 0 and score is not null").withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return f.select("fold", "target", "score", F.col("applicable").alias("scored"), "delta")


def exit_interval(trades: DataFrame, replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """One row (low, high): the mean change of the chosen targets when whole tested sessions are drawn again; NULL under MIN_BLOCKS sessions.

    A session comes down to its scored trades and what its fold's target changed, so replicates are sums of two numbers."""
    from .resample import MIN_BLOCKS, _picks

    own = exit_selection(trades).select("fold", "target")
    days = folds(trades, *EXIT_FOLDS).select("session_date", "fold")
    b = exit_deltas(trades).join(days, "session_date").join(own, ["fold", "target"]).filter("applicable > 0")
    b = b.select(F.col("applicable").alias("m"), "delta", (F.row_number().over(W.orderBy("session_date")) - 1).alias("i"))  # a row a day
    n = b.agg(F.lit("").alias("g"), F.count("*").alias("n")).filter(F.col("n") >= MIN_BLOCKS)
    reps = _picks(n, "exit", replicates, F.col("n")).join(b, "i").groupBy("rep").agg(ratio(F.sum("delta"), F.sum("m")).alias("s")).filter("s is not null")
    a = reps.agg(F.array_sort(F.collect_list("s")).alias("a"))  # one value a replicate
    at = lambda f: F.try_element_at("a", F.least(F.floor(F.lit(f) * F.size("a") + 1e-9).cast("int") + 1, F.greatest(F.size("a"), F.lit(1))))
    tail = (1 - level) / 2
    return a.select(at(tail).alias("low"), at(1 - tail).alias("high"))


def exit_recommendation(trades: DataFrame, replicates: int = 1000) -> DataFrame:
    """One row: folds, scored trades, the commonest target, the folds' share that chose it, the mean change, its interval by sessions, and
    the first reason against recommending it (NULL: none): too few trades, an unstable choice, no improvement, one within chance."""
    s = exit_selection(trades)
    modes = s.groupBy("target").agg(F.count("*").alias("votes"), F.sum("scored").alias("scored"), F.sum("delta").alias("delta"))
    a = modes.agg(F.sum("votes").alias("folds"), F.sum("scored").alias("scored"), F.sum("delta").alias("delta"), F.max(F.struct("votes", (-F.col("target")).alias("t"))).alias("m"))
    a = a.crossJoin(exit_interval(trades, replicates))  # one row each
    mean, share = ratio(F.col("delta"), F.col("scored")), ratio(F.col("m.votes"), F.col("folds"))
    why = F.when(F.col("folds").isNull(), "no fold").when(F.col("scored") < MIN_SCORED, "too few scored trades").when(share < STABLE, "unstable choice").when(~(mean > 0), "no improvement")
    why = why.when(F.col("low").isNull(), "too few sessions").when(~(F.col("low") > 0), "within chance")
    return a.select(F.coalesce("folds", F.lit(0)).alias("folds"), "scored", (-F.col("m.t")).alias("target"), share.alias("stability"), mean.alias("mean_delta"), "low", "high", why.alias("reason"))
