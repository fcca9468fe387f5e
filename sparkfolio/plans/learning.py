"""Queries of walk-forward models and of serving, beside SQL that solves the two-feature systems in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, scan, serving
from ..sources import scratch, versions, views
from .oracle import _ORDERS, r
from .queries import rounded

TABLE: dict = {}


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


def attempts(spark, sf):
    """Orders with their R by quantity and days held; both are unknown for every twentieth."""
    t = views.order_facts(spark, sf)
    some = F.col("trade_id") % 20 != 0
    return t.select(
        "trade_id", "account", "session_date", F.col("r_multiple").alias("y"), (F.col("net") > 0).cast("int").alias("won"), F.when(some, F.col("quantity").cast("double")).alias("quantity"),
        F.when(some, F.col("duration") / 86400).alias("hold"),
    )


def attempts_once(spark, sf):
    """attempts() as a table: training and scoring pass over them some times, and orders and lines are joined once."""
    return scan.written(attempts(spark, sf))


COLUMNS = ["quantity", "hold"]
_SUMS = {"n": "1.0", "a": "a", "b": "b", "y": "y", "aa": "a * a", "ab": "a * b", "bb": "b * b", "ay": "a * y", "by_": "b * y", "yy": "y * y"}


def _solved(name: str, source: str) -> str:
    """Coefficients w0, wa, wb of ridge regression on standardised features from the sums in ``source``, with its penalty p."""
    v = lambda x: f"(({x}{x} - {x} * {x} / n) / (n - 1))"
    return f"""{name}0 AS (SELECT *, CASE WHEN {v('a')} > 1e-18 THEN sqrt({v('a')}) ELSE 1 END AS da, CASE WHEN {v('b')} > 1e-18 THEN sqrt({v('b')}) ELSE 1 END AS db FROM {source}),
{name}1 AS (SELECT *, (aa - a * a / n) / (da * da) + p AS saa, (bb - b * b / n) / (db * db) + p AS sbb, (ab - a * b / n) / (da * db) AS sab, (ay - a * y / n) / da AS say, (by_ - b * y / n) / db AS sby FROM {name}0),
{name}2 AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) / da AS wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) / db AS wb FROM {name}1),
{name} AS (SELECT *, y / n - wa * a / n - wb * b / n AS w0 FROM {name}2)"""


def _models(step: int = 5, first: int = 20) -> str:
    cumulative = ", ".join(f"sum({k}) OVER w AS {k}" for k in _SUMS)
    rest = ", ".join(f"g.{k} - c.{k} AS r_{k}" for k in _SUMS)
    mine = ", ".join(f"c.{k}" for k in _SUMS)
    return f"""{_ORDERS}, x AS (SELECT trade_id, account, session_date, r_multiple AS y, CASE WHEN trade_id % 20 <> 0 THEN CAST(quantity AS DOUBLE) END AS a, CASE WHEN trade_id % 20 <> 0 THEN duration / 86400 END AS b FROM facts),
cal AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS i FROM (SELECT DISTINCT session_date FROM x)),
d AS (SELECT session_date, i, CASE WHEN i <= {first} THEN 0 ELSE (i - 1 - {first}) // {step} + 1 END AS fold FROM cal),
ok AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL),
s AS (SELECT session_date, {', '.join(f'sum({e}) AS {k}' for k, e in _SUMS.items())} FROM ok GROUP BY 1),
c AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS k, {cumulative} FROM s WINDOW w AS (ORDER BY session_date)),
fo AS (SELECT DISTINCT fold FROM d WHERE fold > 0 UNION SELECT max(fold) + 1 FROM d),
ends AS (SELECT fo.fold, max(k) AS k FROM fo JOIN d ON d.fold < fo.fold JOIN c USING (session_date) GROUP BY 1),
tries AS (SELECT e.fold, p, {mine}, {rest} FROM ends e JOIN c g ON g.k = e.k JOIN c ON c.k = CAST(floor(e.k * CAST(0.7 AS DOUBLE)) AS BIGINT), (SELECT unnest([0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS p) WHERE e.k >= 4),
{_solved('t', 'tries')},
te AS (SELECT fold, p, (r_yy - 2 * (w0 * r_y + wa * r_ay + wb * r_by_) + w0 * w0 * r_n + wa * wa * r_aa + wb * wb * r_bb + 2 * w0 * wa * r_a + 2 * w0 * wb * r_b + 2 * wa * wb * r_ab) / r_n AS e FROM t),
best AS (SELECT fold, arg_min(p, (e, p)) AS p FROM te GROUP BY 1),
fits AS (SELECT ends.fold, coalesce(best.p, 10.0) AS p, {mine} FROM ends JOIN c USING (k) LEFT JOIN best ON best.fold = ends.fold),
{_solved('m', 'fits')}"""


@query(f"WITH {_models()} SELECT trade_id, CAST(m.fold AS BIGINT) AS fold, m.p AS penalty, {r('w0 + wa * ok.a + wb * ok.b', 'predicted')} FROM ok JOIN d USING (session_date) JOIN m ON m.fold = d.fold")
def l07_walk_forward(spark, sf):
    """Each trade's R as the model of the sessions before its fold says, refitted every five sessions."""
    w = models.walk_forward(attempts_once(spark, sf), COLUMNS, "y")
    return rounded(w.select("trade_id", "fold", "penalty", "predicted"))


@query(f"WITH {_models()} SELECT CAST(d.fold AS BIGINT) AS fold, count(*) AS scored, count(DISTINCT session_date) AS sessions, count(*) AS converged FROM ok JOIN d USING (session_date) WHERE d.fold > 0 GROUP BY 1")
def l07_walk_forward_logistic(spark, sf):
    """Chance of a gain by the same features and folds; per fold what was scored (a test holds its predictions against plain fits)."""
    w = models.walk_forward_logistic(attempts_once(spark, sf).filter("y is not null"), COLUMNS, "won")
    return rounded(w.groupBy("fold").agg(F.count("*").alias("scored"), F.count_distinct("session_date").alias("sessions"), F.count_if("converged").alias("converged")))


@query(f"WITH {_models()} SELECT session_date, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL) AS complete, count(*) FILTER (a IS NULL OR b IS NULL OR y IS NULL) AS skipped FROM x GROUP BY 1")
def l02_design(spark, sf):
    return serving.design(attempts(spark, sf), COLUMNS, "y")[1]


def stored_models(spark, t):
    """A head's models of attempts_once() in an append-only table."""
    store = versions.Store(spark, scratch.folder(spark, "models"))
    store.commit({"models": serving.train(t, "r", COLUMNS, "y")})
    return store


_GATE = f"""{_models()}, tested AS (SELECT d.fold, count(*) AS tn, sum((ok.y - w0 - wa * ok.a - wb * ok.b) ** 2) AS te, sum((ok.y - m.y / m.n) ** 2) AS tb FROM ok JOIN d USING (session_date) JOIN m ON m.fold = d.fold GROUP BY 1),
g AS (SELECT m.fold, w0, wa, wb, m.p, m.n, coalesce(sum(tn) OVER w, 0) AS scored, CASE WHEN sum(tn) OVER w >= 2 AND sum(tb) OVER w > 1e-12 THEN 1 - sum(te) OVER w / sum(tb) OVER w END AS skill FROM m LEFT JOIN tested USING (fold) WINDOW w AS (ORDER BY m.fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gate AS (SELECT *, CASE WHEN scored < 50 THEN 'too few scored trades' WHEN skill IS NULL OR skill <= 0 THEN 'no skill' END AS reason FROM g),
lost AS (SELECT fo.fold, count(*) AS skipped FROM fo JOIN d ON d.fold < fo.fold JOIN x USING (session_date) WHERE x.a IS NULL OR x.b IS NULL OR x.y IS NULL GROUP BY 1)"""


@query(f"WITH {_GATE}, b AS (SELECT fold, min(session_date) AS trained_at FROM d GROUP BY 1) SELECT CAST(fold AS BIGINT) AS fold, coalesce(trained_at, (SELECT CAST(max(session_date) + 1 AS DATE) FROM d)) AS trained_at, p AS penalty, CAST(n AS BIGINT) AS trained, coalesce(skipped, 0) AS skipped, CAST(scored AS BIGINT) AS scored, {r('skill')}, reason, reason IS NULL AS deployable FROM gate LEFT JOIN b USING (fold) LEFT JOIN lost USING (fold)")
def l12_model_rows(spark, sf):
    """What training leaves: a row a fold and a last one, with the reason against serving."""
    m = stored_models(spark, attempts_once(spark, sf)).read("models")
    return rounded(m.select("fold", "trained_at", "penalty", "trained", "skipped", "scored", "skill", "reason", "deployable"))


@query(f"WITH {_GATE} SELECT trade_id, reason, CASE WHEN gate.fold IS NOT NULL AND reason IS NULL THEN {r('w0 + wa * x.a + wb * x.b', 'z').replace(' AS z', '')} END AS predicted FROM x JOIN d USING (session_date) LEFT JOIN gate ON gate.fold = d.fold")
def l12_served(spark, sf):
    """What the model in force said of each trade when it was opened."""
    t = attempts_once(spark, sf)
    served = serving.serve(t, stored_models(spark, t).read("models"), "r", COLUMNS)
    return rounded(served.select("trade_id", "reason", "predicted"))


@query(f"WITH {_GATE}, z AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY account ORDER BY session_date DESC, trade_id DESC) = 1) SELECT account, reason, CASE WHEN reason IS NULL THEN {r('w0 + wa * z.a + wb * z.b', 'z').replace(' AS z', '')} END AS predicted FROM z, gate WHERE gate.fold = (SELECT max(fold) FROM gate)")
def l08_next_trade(spark, sf):
    """What the last model, of all sessions, says of a trade like each account's latest one, opened after them."""
    t = attempts_once(spark, sf)
    latest = t.groupBy("account").agg(F.max_by(F.struct(*COLUMNS), F.struct("session_date", "trade_id")).alias("t")).select("account", "t.*")
    last = t.agg(F.date_add(F.max("session_date"), 1).alias("session_date"))
    ahead = latest.crossJoin(F.broadcast(last))  # one row
    return rounded(serving.serve(ahead, stored_models(spark, t).read("models"), "r", COLUMNS).select("account", "reason", "predicted"))


_DEALT = "row_number() OVER (ORDER BY ('0x' || substr(md5('20260731:shuffle:3:{c}:' || trade_id), 1, 8))::BIGINT, trade_id) AS i"


@query(f"WITH {_ORDERS}, x AS (SELECT trade_id, CAST(quantity AS DOUBLE) AS quantity, duration / 86400 AS hold FROM facts), o AS (SELECT trade_id, row_number() OVER (ORDER BY trade_id) AS i FROM x), a AS (SELECT quantity, {_DEALT.format(c='quantity')} FROM x), b AS (SELECT hold, {_DEALT.format(c='hold')} FROM x) SELECT trade_id, {r('quantity')}, {r('hold')} FROM o JOIN a USING (i) JOIN b USING (i)")
def d13_reference(spark, sf):
    """The feature matrix with each column permuted over all trades."""
    t = views.order_facts(spark, sf).select("trade_id", F.col("quantity").cast("double").alias("quantity"), (F.col("duration") / 86400).alias("hold"))
    return rounded(models.shuffled(t, COLUMNS, 3))
