"""Queries that resample, and the scenarios that are tested by it, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, models, reports, stats, whatif
from ..operators import resample as R
from ..sources import views
from .oracle import _CURVE, _DETECT, _DRAW, _EXITS, _ORDERS, _PRED, _REL, _STATE, _TRADES, r
from .queries import exits_input, facts, predictions, rounded, state

TABLE: dict = {}


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


_POISSON = "CASE " + " ".join(f"WHEN u < {t} THEN {k}" for k, t in enumerate(R.POISSON)) + f" ELSE {len(R.POISSON)} END"


def lanes(source: str, kind: str, replicates: int, columns: str) -> str:
    """Rows of a source for each replicate, with the 32 bits u drawn by a row's hash."""
    return f"""(SELECT {columns}, block * 4 + j AS rep, ('0x' || substr(h, 1 + 8 * j, 8))::BIGINT AS u
  FROM (SELECT *, md5('{R.SEED}:{kind}:' || block || ':' || trade_id) AS h FROM {source}, range({(replicates + 3) // 4}) b(block)), range(4) l(j) WHERE block * 4 + j < {replicates})"""


def boot_sql(source: str, kind: str, replicates: int, terms: str, statistic: str, whole: str, group: str) -> str:
    """CTEs of a Poisson bootstrap: terms are weighted sums with w, whole the same sums without."""
    return f"""dr AS (SELECT *, {_POISSON} AS w FROM {lanes(source, kind, replicates, '* EXCLUDE (block, h)')}),
 rs AS (SELECT {group}, rep, {terms} FROM dr GROUP BY 1, 2), ms AS (SELECT {group}, {statistic} AS m FROM rs),
 ci AS (SELECT {group}, quantile_cont(m, [0.025, 0.975]) AS p, count(m) AS k, count(*) FILTER (m <= 0) AS below FROM ms GROUP BY 1),
 wh AS (SELECT {group}, count(*) AS n, {whole} FROM {source} GROUP BY 1), vl AS (SELECT {group}, n, {statistic} AS value FROM wh)"""


def bh(source: str, key: str) -> str:
    """q over all of a source's p."""
    return f"""kk AS (SELECT {key}, p, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM {source} WHERE p IS NOT NULL),
 qq AS (SELECT {key}, least(1, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM kk)"""


_MEAN = "sum(w * x) AS s, CAST(sum(w) AS DOUBLE) AS d", "s / nullif(d, 0)", "sum(x) AS s, CAST(count(*) AS DOUBLE) AS d"
_SEG = f"{_TRADES}, v AS (SELECT segment, CAST(net AS DOUBLE) AS x, trade_id FROM facts)"
_CI = f"n, {r('value', 'mean')}, CASE WHEN n >= 5 THEN {r('p[1]', 'z').replace(' AS z', '')} END AS low, CASE WHEN n >= 5 THEN {r('p[2]', 'z').replace(' AS z', '')} END AS high"
_SHARE = r("below / k", "z").replace(" AS z", "")


@query(f"WITH {_SEG}, {boot_sql('v', 'boot', 10_000, *_MEAN, 'segment')} SELECT segment, {_CI}, CASE WHEN n >= 5 THEN {_SHARE} END AS share_not_above, {_REL} FROM vl LEFT JOIN ci USING (segment)")
def b01_bootstrap(spark, sf):
    return rounded(R.bootstrap_mean(facts(spark, sf), "net", "segment"))


@query(f"WITH {_SEG}, {boot_sql('v', 'boot', 10_000, *_MEAN, 'segment')} SELECT segment, {_CI}, CASE WHEN n >= 5 THEN {_SHARE} END AS p, {_REL}, CASE WHEN n >= 5 THEN p[1] > 0 END AS edge FROM vl LEFT JOIN ci USING (segment)")
def b07_edge_test(spark, sf):
    return rounded(R.edge_test(facts(spark, sf), "net", "segment"))


_PF = "sum(w * greatest(x, 0)) AS s, sum(w * greatest(-x, 0)) AS d", "s / nullif(d, 0)", "sum(greatest(x, 0)) AS s, sum(greatest(-x, 0)) AS d"


@query(f"WITH {_SEG}, {boot_sql('v', 'pf', 2000, *_PF, 'segment')} SELECT segment, n, {r('value')}, CASE WHEN n >= 5 AND k >= 1000 THEN {r('p[1]', 'z').replace(' AS z', '')} END AS low, CASE WHEN n >= 5 AND k >= 1000 THEN {r('p[2]', 'z').replace(' AS z', '')} END AS high, CASE WHEN n >= 5 AND k >= 1000 THEN {_SHARE} END AS share_not_above, {_REL} FROM vl LEFT JOIN ci USING (segment)")
def b02_bootstrap_profit_factor(spark, sf):
    x = F.col("net").cast("double")
    terms = {"won": F.greatest(x, F.lit(0.0)), "lost": F.greatest(-x, F.lit(0.0))}
    return rounded(R.bootstrap_statistic(facts(spark, sf), terms, "try_divide(won, lost)", "segment", kind="pf"))


@query(f"""WITH {_ORDERS}, v AS (SELECT instrument AS g, CAST(net AS DECIMAL(20,8)) AS x, row_number() OVER (PARTITION BY instrument ORDER BY trade_id) - 1 AS i FROM facts), n AS (SELECT g, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 5),
 d AS (SELECT g, rep, k, {_DRAW.format("'path:' || g || ':' || rep || ':' || k")} % n AS i FROM n, range(5000) a(rep), range(100) b(k)),
 e AS (SELECT g, rep, k, sum(x) OVER (PARTITION BY g, rep ORDER BY k ROWS UNBOUNDED PRECEDING) AS equity FROM d JOIN v USING (g, i)),
 w AS (SELECT *, min(CASE WHEN equity <= -20000 THEN k END) OVER (PARTITION BY g, rep) AS fin, greatest(0, max(equity) OVER (PARTITION BY g, rep ORDER BY k ROWS UNBOUNDED PRECEDING)) AS peak FROM e),
 p AS (SELECT g, rep, CAST(arg_max(equity, k) AS DOUBLE) AS final, CAST(max(peak - equity) AS DOUBLE) AS dd, bool_or(fin IS NOT NULL) AS ruined FROM w WHERE fin IS NULL OR k <= fin GROUP BY 1, 2),
 q AS (SELECT g, count(*) AS iterations, quantile_cont(final, [0.05, 0.25, 0.5, 0.75, 0.95]) AS f, quantile_cont(dd, [0.05, 0.25, 0.5, 0.75, 0.95]) AS d, count(*) FILTER (final < 0) AS l, count(*) FILTER (ruined) AS r FROM p GROUP BY 1)
SELECT g AS instrument, iterations, {', '.join(r(f'{c}[{i + 1}]', f'{m}_p{x}') for c, m in (('f', 'final'), ('d', 'drawdown')) for i, x in enumerate((5, 25, 50, 75, 95)))}, {r('l / iterations', 'p_loss')}, {r('r / iterations', 'p_ruin')} FROM q""")
def b04_paths(spark, sf):
    return rounded(R.path_summary(R.paths(views.order_facts(spark, sf), "net", "instrument", 5000, 100, 20000.0), "instrument"))


def _scaled(s: str, m: str, total: str, n: str) -> str:
    return f"CASE WHEN {m} > 0 AND {n} > {m} THEN abs({s} / {m} - ({total} - {s}) / ({n} - {m})) * sqrt(CAST({m} AS DOUBLE) * ({n} - {m}) / {n}) ELSE 0 END"


@query(f"""WITH {_SEG}, t AS (SELECT count(*) AS tn, sum(x) AS ts FROM v), w AS (SELECT segment, count(*) AS n, sum(x) AS s FROM v GROUP BY 1),
 b AS (SELECT *, sum(n) OVER (ORDER BY segment) * 4294967296 // tn AS hi, (sum(n) OVER (ORDER BY segment) - n) * 4294967296 // tn AS lo FROM w, t),
 d AS (SELECT rep, b.segment, count(*) AS pn, sum(x) AS ps FROM {lanes('v', 'perm', 5000, 'x')} l JOIN b ON l.u >= b.lo AND l.u < b.hi GROUP BY 1, 2),
 k AS (SELECT b.segment, count(*) FILTER ({_scaled('ps', 'pn', 'ts', 'tn')} >= ({_scaled('s', 'n', 'ts', 'tn')}) * (1 - 1e-9)) AS k FROM b JOIN d ON b.segment = d.segment GROUP BY 1)
SELECT segment, n, {r('s / n - (ts - s) / (tn - n)', 'difference')}, {r('(k + 1) / 5001', 'p')} FROM b JOIN k USING (segment) WHERE n >= 5 AND tn - n >= 5""")
def b06_permutation(spark, sf):
    return rounded(R.permutation_test(facts(spark, sf), "net", "segment", 5000))


_BLOCKS = f"""WITH {_ORDERS}, {_PRED}, b AS (SELECT session, count(*) AS m, sum((actual - predicted) ** 2) AS e, sum(actual) AS y, sum(actual * actual) AS yy, row_number() OVER (ORDER BY session) - 1 AS i FROM pred GROUP BY 1), c AS (SELECT count(*) AS n, sum(m) AS m, sum(e) AS e, sum(y) AS y, sum(yy) AS yy FROM b),
 d AS (SELECT rep, {_DRAW.format("'block::' || rep || ':' || k")} % n AS i FROM c, range(1000) a(rep), range(n) z(k)),
 s AS (SELECT rep, sum(m) AS m, sum(e) AS e, sum(y) AS y, sum(yy) AS yy FROM d JOIN b USING (i) GROUP BY 1), k AS (SELECT list(1 - e / (yy - y * y / m) ORDER BY 1 - e / (yy - y * y / m)) AS a FROM s)
SELECT n AS sessions, CAST(m AS BIGINT) AS predictions, {r('1 - e / (yy - y * y / m)', 'skill')}, {r('a[26]', 'low')}, {r('a[976]', 'high')}, a[26] > 0 AS established FROM c, k"""


@query(_BLOCKS)
def b08_block_skill(spark, sf):
    return rounded(R.block_skill(predictions(spark, sf)))


# The walk by the book: one trade after another, with the session's count and losses as they are before it.
_WALK = """seq AS (SELECT t.*, row_number() OVER (PARTITION BY sc, key ORDER BY opened_at, trade_id) AS rn FROM tagged t),
 walk AS (SELECT DISTINCT sc, key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS {id}) AS trade_id, 0 AS idx, 0 AS losses, false AS skip FROM seq
  UNION ALL SELECT sc, key, rn, trade_id, CASE WHEN sk THEN idx ELSE idx + 1 END, CASE WHEN sk THEN losses WHEN sim < 0 THEN losses + 1 WHEN sim > 0 THEN 0 ELSE losses END, sk
  FROM (SELECT seq.sc, seq.key, seq.rn, seq.trade_id, seq.sim, walk.idx, walk.losses, coalesce(walk.idx >= maxt, false) OR coalesce(walk.losses >= al, false) OR (hrs IS NOT NULL AND NOT coalesce(list_contains(hrs, entry_hour), false)) AS sk
   FROM walk JOIN seq ON seq.sc = walk.sc AND seq.key = walk.key AND seq.rn = walk.rn + 1))"""
_PLAN = f"""{_TRADES}, tagged AS (SELECT 1 AS sc, symbol || session_date AS key, trade_id, opened_at, net AS sim, 5 AS maxt, 2 AS al, [0, 1, 2, 3, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18] AS hrs, hour(local) AS entry_hour FROM facts),
 {_WALK.format(id='VARCHAR')}, planned AS (SELECT f.*, NOT skip AS taken, CASE WHEN skip THEN -f.net ELSE 0 END AS delta FROM facts f JOIN walk USING (trade_id))"""
HOURS = [0, 1, 2, 3, *range(8, 19)]


def planned(spark, sf):
    return whatif.what_if(facts(spark, sf), "symbol", max_trades=5, stop_after_losses=2, hours=HOURS)


@query(f"WITH RECURSIVE {_PLAN} SELECT symbol, session_date, count(*) FILTER (taken) AS taken, {r('sum(delta)', 'delta')} FROM planned GROUP BY 1, 2")
def w14_what_if(spark, sf):
    return rounded(planned(spark, sf).groupBy("symbol", "session_date").agg(F.count_if("taken").alias("taken"), F.sum("delta").alias("delta")))


@query(f"""WITH RECURSIVE {_PLAN}, v AS (SELECT segment, CAST(delta AS DOUBLE) AS x, trade_id FROM planned), c AS (SELECT segment, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM v GROUP BY 1),
 t AS (SELECT segment, rep, sum(x * ({_POISSON})) AS s FROM {lanes('v', 'pair', 10_000, 'segment, x')} GROUP BY 1, 2), h AS (SELECT segment, count(*) FILTER (s <= 1e-9) AS lo, count(*) FILTER (s >= -1e-9) AS hi FROM t GROUP BY 1)
SELECT segment, n, {r('m', 'difference')}, {r('m / nullif(sd, 0)', 'effect')}, CASE WHEN n >= 5 THEN {r('least(1, greatest(2 * least(lo, hi) / 10000, 0.0001))', 'p').replace(' AS p', '')} END AS p FROM c LEFT JOIN h USING (segment)""")
def b09_paired_test(spark, sf):
    return rounded(R.paired_test(planned(spark, sf), "delta", "segment"))


_CAL = f"""WITH {_ORDERS}, {_PRED}, x AS (SELECT trade_id, predicted AS p, actual AS y, CAST(least(9, greatest(0, floor(predicted * 10))) AS INT) AS bin FROM pred), s AS (SELECT rep, bin, p, CASE WHEN u < p * 4294967296 THEN 1 ELSE 0 END AS y FROM {lanes('x', 'cal', 1000, 'bin, p')}),
 o AS (SELECT sum(gap) / sum(m) AS ece, CAST(sum(m) AS BIGINT) AS n FROM (SELECT count(*) AS m, abs(sum(p) - sum(y)) AS gap FROM x GROUP BY bin)), u AS (SELECT rep, sum(gap) / sum(m) AS e FROM (SELECT rep, count(*) AS m, abs(sum(p) - sum(y)) AS gap FROM s GROUP BY rep, bin) GROUP BY 1)
SELECT n, {r('ece')}, {r('(count(*) FILTER (e >= ece - 1e-9) + 1) / 1001', 'p')} FROM o, u GROUP BY n, ece"""


@query(_CAL)
def b10_calibration(spark, sf):
    return rounded(R.calibration(predictions(spark, sf)))


@query(f"""SELECT predictions AS scored, skill, low, ece, p, CASE WHEN predictions < 50 THEN 'too few scored trades' WHEN skill IS NULL THEN 'skill unknown' WHEN skill <= 0 THEN 'no skill' WHEN low IS NULL THEN 'too few sessions' WHEN NOT established THEN 'skill within chance' WHEN p <= 0.05 THEN 'miscalibrated' END AS reason
FROM ({_BLOCKS}), ({_CAL})""")
def l11_gate(spark, sf):
    return rounded(models.gate(predictions(spark, sf), True, 1000, 1000))


def two_sample_sql(kind: str, replicates: int) -> str:
    """CTEs from v (test, now, x, trade_id): a, with counts and means, and p and q by test."""
    return f"""a AS (SELECT test, count(*) FILTER (now) AS n_in, count(*) FILTER (NOT now) AS n_out, avg(x) FILTER (now) AS mi, avg(x) FILTER (NOT now) AS mo, sum(x) AS ts, coalesce(sum(x) FILTER (now), 0) AS s, count(*) AS tn FROM v GROUP BY 1),
 u AS (SELECT l.test, rep, count(*) FILTER (u < n_in * 4294967296 // tn) AS pn, coalesce(sum(x) FILTER (u < n_in * 4294967296 // tn), 0) AS ps FROM {lanes('v', kind, replicates, 'test, x')} l JOIN a ON l.test = a.test WHERE n_in >= 5 AND n_out >= 5 GROUP BY 1, 2),
 pp AS (SELECT a.test, (count(*) FILTER ({_scaled('ps', 'pn', 'ts', 'tn')} >= ({_scaled('s', 'n_in', 'ts', 'tn')}) * (1 - 1e-9)) + 1) / {replicates + 1} AS p FROM u JOIN a ON u.test = a.test GROUP BY 1),
 {bh('pp', 'test')}"""


_COMPARED = f"""WITH {_ORDERS}, v0 AS (SELECT trade_id, session_date >= DATE '1996-01-01' AS now, unnest(['net', 'win_rate', 'r_multiple', 'duration', 'quantity']) AS test, unnest([CAST(net AS DOUBLE), CASE WHEN net > 0 THEN 1 ELSE 0 END, r_multiple, duration, quantity]) AS x FROM facts WHERE session_date BETWEEN DATE '1995-12-01' AND DATE '1996-01-31'),
 v AS (SELECT * FROM v0 WHERE x IS NOT NULL), {two_sample_sql('period', 5000)}
SELECT test AS metric, n_in AS n_current, n_out AS n_previous, {r('mi', 'current')}, {r('mo', 'previous')}, {r('pp.p', 'p')}, {r('q', 'q')}, CASE WHEN NOT coalesce(q <= 0.05, FALSE) THEN 'unchanged' WHEN mi > mo THEN 'up' WHEN mi < mo THEN 'down' ELSE 'flat' END AS direction FROM a LEFT JOIN pp USING (test) LEFT JOIN qq USING (test)"""
_MONTHS = ("1996-01-01", "1996-01-31"), ("1995-12-01", "1995-12-31")


@query(_COMPARED)
def e01_period_comparison(spark, sf):
    return rounded(reports.compare_periods(views.order_facts(spark, sf), *_MONTHS, 5000))


@query(f"""WITH {_ORDERS}, a AS (SELECT instrument, count(*) AS n, count(*) FILTER (net > 0) AS w, count(*) FILTER (net < 0) AS l, avg(CAST(net AS DOUBLE)) FILTER (net > 0) AS aw, avg(CAST(net AS DOUBLE)) FILTER (net < 0) AS al FROM facts WHERE session_date BETWEEN DATE '1996-01-01' AND DATE '1996-01-31' GROUP BY 1),
 k AS (SELECT instrument, unnest(['n', 'kelly']) AS k, unnest([CAST(n AS DOUBLE), CASE WHEN w > 0 AND l > 0 THEN w / (w + l) - (1 - w / (w + l)) / (aw / abs(al)) END]) AS v FROM a),
 c AS (SELECT metric, unnest(['n_current', 'n_previous', 'current', 'previous', 'q']) AS k, unnest([n_current, n_previous, current, previous, q]) AS v FROM ({_COMPARED}))
SELECT 'performance' AS section, instrument || '.' || k AS key, {r('v', 'value')}, CAST(NULL AS VARCHAR) AS reason FROM k UNION ALL SELECT 'comparison', metric || '.' || k, {r('v', 'value')}, NULL FROM c""")
def e04_report(spark, sf):
    """January 1996: Kelly by instrument, and the comparison with the month before."""
    t = views.order_facts(spark, sf)
    now = t.filter("session_date between '1996-01-01' and '1996-01-31'")
    compared = reports.compare_periods(t, *_MONTHS, 5000).select("metric", "n_current", "n_previous", "current", "previous", "q")
    sections = {"performance": (stats.kelly(now, "instrument").select("instrument", "n", "kelly"), "instrument"), "comparison": (compared, "metric")}
    return rounded(reports.compose(sections, now.select("session_date").distinct().count(), "monthly"))


@query(f"""WITH {_STATE}, {_DETECT}, v AS (SELECT trade_id, behaviour AS test, present AS now, CAST(value AS DOUBLE) AS x FROM det WHERE present IS NOT NULL AND value IS NOT NULL), {two_sample_sql('scan', 5000)}
SELECT test, n_in, n_out, {r('mi', 'mean_in')}, {r('mo', 'mean_out')}, {r('pp.p', 'p')}, {r('q', 'q')}, coalesce(q <= 0.05, FALSE) AS found FROM a LEFT JOIN pp USING (test) LEFT JOIN qq USING (test)""")
def d16_behaviour_scan(spark, sf):
    return rounded(discovery.scan(state(spark, sf), None, 5000))


_SCEN = "sc_(i, scenario, stop_r, target_r, maxt, al) AS (VALUES " + ", ".join(f"({i}, '{s['name']}', {s.get('stop_r', 'NULL')}::DOUBLE, {s.get('target_r', 'NULL')}::DOUBLE, {s.get('max_trades', 'NULL')}::INT, {s.get('after_losses', 'NULL')}::INT)" for i, s in enumerate(whatif.SCENARIOS)) + ")"
_SWEPT = f"""{_ORDERS}, {_SCEN}, y AS (SELECT trade_id, session_date, opened_at, net, r_multiple AS rm, trade_id % 5 <> 0 AS known, CASE WHEN trade_id % 5 <> 0 THEN abs(r_multiple) + (trade_id % 7) * 0.75 END AS mfe, CASE WHEN trade_id % 5 <> 0 THEN (trade_id % 4) * 0.4 END AS mae FROM facts),
 z AS (SELECT *, CASE WHEN stop_r IS NULL AND target_r IS NULL THEN 'unchanged' WHEN NOT (known AND rm IS NOT NULL AND rm <> 0) THEN 'inapplicable' WHEN mae >= stop_r OR mfe >= target_r THEN 'repriced' ELSE 'unchanged' END AS kind, CASE WHEN mae >= stop_r THEN -stop_r WHEN mfe >= target_r THEN target_r END AS lvl FROM y, sc_),
 tagged AS (SELECT i AS sc, scenario, CAST(session_date AS VARCHAR) AS key, trade_id, opened_at, net, kind, CASE kind WHEN 'repriced' THEN round_even(lvl * (CAST(net AS DOUBLE) / rm), 2) WHEN 'unchanged' THEN CAST(net AS DOUBLE) END AS sim, maxt, al, CAST(NULL AS BIGINT[]) AS hrs, CAST(NULL AS BIGINT) AS entry_hour FROM z),
 {_WALK.format(id='BIGINT')},
 simulated AS (SELECT g.sc AS i, scenario, g.trade_id, net, CASE WHEN skip THEN 'skipped' ELSE kind END AS outcome, CASE WHEN NOT skip THEN sim END AS simulated, CASE WHEN skip THEN -CAST(net AS DOUBLE) WHEN kind <> 'inapplicable' THEN sim - CAST(net AS DOUBLE) END AS delta FROM tagged g JOIN walk w ON g.sc = w.sc AND g.trade_id = w.trade_id)"""


def traded(spark, sf):
    return exits_input(spark, sf).withColumn("entry_hour", F.lit(None).cast("int"))


@query(f"WITH RECURSIVE {_SWEPT} SELECT scenario, outcome, count(*) AS n, {r('sum(simulated)', 'simulated')}, {r('sum(delta)', 'delta')} FROM simulated GROUP BY 1, 2")
def q01_simulate(spark, sf):
    s = whatif.simulate(traded(spark, sf), whatif.SCENARIOS)
    return rounded(s.groupBy("scenario", "outcome").agg(F.count("*").alias("n"), F.sum("simulated").alias("simulated"), F.sum("delta").alias("delta")))


_SWEEP = f"""WITH RECURSIVE {_SWEPT}, tot AS (SELECT i, scenario, count(*) AS n, count(*) FILTER (outcome = 'repriced') AS repriced, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'inapplicable') AS inapplicable,
  coalesce(sum(CAST(net AS DOUBLE)) FILTER (outcome <> 'inapplicable'), 0) AS baseline, coalesce(sum(simulated), 0) AS simulated, avg(delta) AS mean_delta FROM simulated GROUP BY 1, 2),
 ids AS (SELECT trade_id FROM facts), wt AS MATERIALIZED (SELECT trade_id, rep, {_POISSON} AS w FROM {lanes('ids', 'sweep', 2000, 'trade_id')}),
 rs AS (SELECT i, rep, sum(w * delta) AS s, sum(w * delta) / nullif(sum(w), 0) AS m FROM wt JOIN (SELECT i, trade_id, delta FROM simulated WHERE delta IS NOT NULL) USING (trade_id) GROUP BY 1, 2),
 tl AS (SELECT i, count(*) FILTER (s <= 1e-9) AS lo, count(*) FILTER (s >= -1e-9) AS hi, quantile_cont(m, [0.025, 0.975]) AS pc FROM rs GROUP BY 1),
 te AS (SELECT *, n - inapplicable AS used, repriced + unchanged AS evaluated, CASE WHEN n - inapplicable >= 5 THEN least(1, greatest(2 * least(lo, hi) / 2000, 0.0005)) END AS p FROM tot JOIN tl USING (i)),
 {bh('te', 'i')}, swept AS (SELECT te.*, q, used / n AS coverage, simulated - baseline AS difference, pc[1] AS low, pc[2] AS high, coalesce(evaluated >= 30 AND used / n >= 0.5 AND (pc[1] > 0 OR pc[2] < 0) AND q < 0.05, FALSE) AS actionable FROM te LEFT JOIN qq USING (i))"""


@query(f"{_SWEEP} SELECT scenario, n, repriced, unchanged, skipped, inapplicable, {', '.join(r(x) for x in 'baseline simulated difference mean_delta coverage low high p q'.split())}, evaluated, {_REL.replace('n <', 'evaluated <')}, actionable FROM swept")
def q02_sweep(spark, sf):
    s = whatif.sweep(traded(spark, sf), replicates=2000)
    return rounded(s.select("scenario", "n", "repriced", "unchanged", "skipped", "inapplicable", "baseline", "simulated", "difference", "mean_delta", "coverage", "low", "high", "p", "q", "evaluated", "reliability", "actionable"))


@query(f"""{_SWEEP}, bb AS (SELECT arg_max(scenario, difference) AS best, max(difference) AS difference, arg_max(q, difference) AS q FROM swept WHERE actionable AND difference > 0)
SELECT (SELECT count(*) FROM swept) AS tested, (SELECT count(*) FILTER (actionable) FROM swept) AS actionable, (SELECT count(*) FILTER (coverage < 0.5) FROM swept) AS thin, best, {r('difference')}, {r('q')}, CASE WHEN best IS NULL THEN 'no established improvement' END AS reason FROM bb""")
def q04_recommendation(spark, sf):
    return rounded(whatif.recommendation(whatif.sweep(traded(spark, sf), replicates=2000)))
