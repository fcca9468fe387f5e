"""The queries in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

from ..functions.exprs import SEGMENTS, clock
from ..sources.views import INSTRUMENTS

_INST = "inst AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {t}::DECIMAL(20,8), {p}::DECIMAL(12,2), '{z}', {clock(r)})" for s, t, p, z, r in INSTRUMENTS) + ") t(symbol, tick, point, zone, rollover))"
_FILLS = _INST + """,
fills AS (SELECT event_id AS fill_id, user_id AS account, event_type AS symbol, ts, CASE WHEN (event_id + user_id) % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, event_id % 4 + 1 AS qty, round(value, 2) AS price, (event_id % 4 + 1) * 0.25 AS commission, (event_id % 4 + 1) * 0.02 AS fees FROM events)"""
_SLICES = _FILLS + """,
f1 AS (SELECT *, CASE side WHEN 'buy' THEN 1 ELSE -1 END AS s FROM fills),
f2 AS (SELECT *, sum(s * qty) OVER (PARTITION BY account, symbol ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING) AS aft FROM f1),
f3 AS (SELECT *, aft - s * qty AS bef FROM f2),
f4 AS (SELECT *, CASE WHEN bef * s < 0 THEN least(abs(bef), qty) ELSE 0 END AS cq FROM f3),
f5 AS (SELECT *, qty - cq AS oq, CASE WHEN qty - cq > 0 AND (bef = 0 OR cq > 0) THEN 1 ELSE 0 END AS st FROM f4),
f6 AS (SELECT *, sum(st) OVER (PARTITION BY account, symbol ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING) AS t0 FROM f5),
sl AS (SELECT account, symbol, t0 - st AS tid, 'exit' AS role, -s AS dir, fill_id, ts, price, cq AS q FROM f6 WHERE cq > 0 UNION ALL SELECT account, symbol, t0, 'entry', s, fill_id, ts, price, oq FROM f6 WHERE oq > 0),
slices AS (SELECT *, sum(q) OVER (PARTITION BY account, symbol, tid, role ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING) AS hi FROM sl),
lots AS (SELECT e.account, e.symbol, e.tid, e.fill_id AS entry_id, x.fill_id AS exit_id, least(e.hi, x.hi) - greatest(e.hi - e.q, x.hi - x.q) AS qty, (x.price - e.price) * e.dir * (least(e.hi, x.hi) - greatest(e.hi - e.q, x.hi - x.q)) AS points
  FROM slices e JOIN slices x ON e.account = x.account AND e.symbol = x.symbol AND e.tid = x.tid AND e.role = 'entry' AND x.role = 'exit' AND e.hi - e.q < x.hi AND x.hi - x.q < e.hi)"""
_TRADES = _SLICES + """,
m AS (SELECT account, symbol, tid, max(dir) AS dir, min(ts) AS opened_at, max(ts) FILTER (role = 'exit') AS last_exit, sum(q) FILTER (role = 'entry') AS qo, coalesce(sum(q) FILTER (role = 'exit'), 0) AS qc, sum(price * q) FILTER (role = 'entry') AS paid, sum(price * q) FILTER (role = 'exit') AS got, sum(q) * 0.25 AS commission, sum(q) * 0.02 AS fees, count(*) FILTER (role = 'entry') AS ne, count(*) FILTER (role = 'exit') AS nx FROM slices GROUP BY ALL),
g AS (SELECT account, symbol, tid, sum(points) AS points FROM lots GROUP BY ALL),
tr AS (SELECT m.account, m.symbol, CAST(m.tid AS BIGINT) AS tid, CASE WHEN dir > 0 THEN 'long' ELSE 'short' END AS direction, CASE WHEN qo = qc THEN 'closed' ELSE 'open' END AS status, opened_at, CASE WHEN qo = qc THEN last_exit END AS closed_at, qo, qc, paid / qo AS avg_entry, got / nullif(qc, 0) AS avg_exit, points, round(coalesce(points, 0), 8) * CAST(point AS DOUBLE) AS gross, commission, fees, ne > 1 AS scaled_in, nx > 1 AS scaled_out,
  CASE WHEN qo = qc THEN (epoch_us(last_exit) - epoch_us(opened_at)) // 1000000 END AS duration, timezone(zone, timezone('UTC', opened_at)) AS local, rollover FROM m LEFT JOIN g USING (account, symbol, tid) JOIN inst USING (symbol)),
trades AS (SELECT *, round(gross - commission - fees, 6) AS net, account || '-' || symbol || '-' || tid AS trade_id, CAST(local AS DATE) + CASE WHEN hour(local) * 3600 + minute(local) * 60 + second(local) >= rollover THEN 1 ELSE 0 END AS d0 FROM tr),
facts AS (SELECT *, CAST(d0 + CASE WHEN isodow(d0) = 6 THEN 2 ELSE 0 END AS DATE) AS session_date, (SELECT name FROM (VALUES """ + ", ".join(f"({clock(t)}, '{n}')" for t, n in SEGMENTS) + """) v(start, name) WHERE start <= hour(local) * 3600 + minute(local) * 60 + second(local) ORDER BY start DESC LIMIT 1) AS segment FROM trades WHERE status = 'closed')"""
_STATE = _TRADES + """,
st1 AS (SELECT *, row_number() OVER w - 1 AS index, coalesce(sum(net) OVER b, 0) AS pnl_before, coalesce(sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) OVER b, 0) AS wins, last_value(closed_at IGNORE NULLS) OVER b AS prev_exit, last_value(CASE WHEN net <> 0 THEN net < 0 END IGNORE NULLS) OVER b AS pl
  FROM facts WINDOW w AS (PARTITION BY account, session_date ORDER BY opened_at, trade_id), b AS (PARTITION BY account, session_date ORDER BY opened_at, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
state AS (SELECT *, coalesce(sum(CASE WHEN net < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account, session_date, wins ORDER BY opened_at, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS losses_before,
  CASE WHEN prev_exit IS NOT NULL THEN greatest(0, epoch_us(opened_at) - epoch_us(prev_exit)) // 60000000 END AS minutes_since_exit, CASE WHEN index > 0 THEN coalesce(pl, false) END AS prev_loss FROM st1)"""
_BARS = """tick AS (SELECT event_type AS symbol, ts, event_id, round(value, 2) AS price FROM events),
bars AS (SELECT symbol, make_timestamp(CAST(floor(epoch(ts) / {s}) AS BIGINT) * {s} * 1000000) AS ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM tick GROUP BY 1, 2)"""
_ORDERS = """l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(0.05 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS net, sum(CAST(l_extendedprice AS DECIMAL(15,2))) * CAST(0.01 AS DECIMAL(4,2)) AS risk, sum(CAST(l_quantity AS DECIMAL(12,2))) AS quantity, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
facts AS (SELECT o_orderkey AS trade_id, o_custkey AS account, o_orderpriority AS instrument, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, o_orderdate AS opened_at, greatest(o_orderdate, shipped) AS closed_at, CAST(o_orderdate AS DATE) AS session_date, quantity, net, quantity * CAST(0.25 AS DECIMAL(4,2)) AS costs, net + quantity * CAST(0.25 AS DECIMAL(4,2)) AS gross, risk,
  CASE WHEN risk > 0 THEN CAST(net AS DOUBLE) / CAST(risk AS DOUBLE) END AS r_multiple, CAST(epoch(greatest(o_orderdate, shipped)) - epoch(o_orderdate) AS BIGINT) AS duration FROM orders JOIN l ON o_orderkey = l_orderkey)"""
_CURVE = _ORDERS + """,
curve0 AS (SELECT account, trade_id, row_number() OVER w AS i, sum(net) OVER w AS cum_net, CASE WHEN sum(CASE WHEN r_multiple IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN sum(r_multiple) OVER w END AS cum_r FROM facts WINDOW w AS (PARTITION BY account ORDER BY closed_at, opened_at, trade_id ROWS UNBOUNDED PRECEDING)),
curve1 AS (SELECT *, greatest(0, max(cum_net) OVER (PARTITION BY account ORDER BY i ROWS UNBOUNDED PRECEDING)) AS peak FROM curve0),
curve AS (SELECT *, cum_net - peak AS drawdown FROM curve1),
runs AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY account ORDER BY i ROWS UNBOUNDED PRECEDING) AS run, max(i) OVER (PARTITION BY account) AS n FROM curve),
periods AS (SELECT account, min(i) AS first_i, max(i) AS last_i, min(drawdown) AS depth, arg_min(i, (drawdown, i)) AS trough_i, CASE WHEN max(i) < max(n) THEN max(i) + 1 END AS recovered_i FROM runs WHERE drawdown < 0 GROUP BY account, run)"""


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    """x as a rounded double."""
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name or x}"


_REL = "CASE WHEN n < 5 THEN 'insufficient' WHEN n < 30 THEN 'provisional' ELSE 'reliable' END AS reliability"
_RULES = "CAST(index < 6 AS BOOLEAN) AS r1, (losses_before < 2 OR minutes_since_exit >= 10) AS r2, (pnl_before >= 0 OR qo <= 2) AS r3"
_DRAW = "('0x' || substr(md5('20260731:' || {}), 1, 8))::BIGINT"
_PRED = "pred AS (SELECT trade_id, session_date AS session, CAST(0.1 AS DOUBLE) + (trade_id % 8) * CAST(0.1 AS DOUBLE) AS predicted, CASE WHEN net > 0 THEN 1 ELSE 0 END AS actual FROM facts)"
_EXITS = "x AS (SELECT session_date, r_multiple AS r, risk, trade_id % 5 <> 0 AS known, CASE WHEN trade_id % 5 <> 0 THEN abs(r_multiple) + (trade_id % 7) * 0.75 END AS mfe FROM facts)"
_PICK = """e AS (SELECT fold, target, count(*) AS n, count(CASE WHEN known AND r IS NOT NULL THEN 1 END) AS applicable, sum(CASE WHEN known AND r IS NOT NULL AND mfe >= target THEN (target - r) * CAST(risk AS DOUBLE) ELSE 0 END) AS delta FROM x JOIN d USING (session_date), (VALUES (1.0::DOUBLE), (1.5), (2.0), (3.0), (4.0)) t(target) GROUP BY 1, 2),
 b AS (SELECT *, sum(n) OVER w AS bn, sum(applicable) OVER w AS ba, sum(delta) OVER w AS bd FROM e WINDOW w AS (PARTITION BY target ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 pick AS (SELECT fold, target, applicable, delta, round(bd / ba, 9) AS score FROM b WHERE fold > 0 AND ba >= bn * 0.5 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(bd / ba, 9) DESC, target) = 1)"""
_SPECS = "specs AS (SELECT p_partkey AS contract_id, p_brand AS symbol, CASE WHEN p_size % 40 % 2 = 0 THEN 0.25 ELSE 0.01 END AS tick, p_size % 40 * 5 + 5 AS point FROM part)"
_MAPPED = _SPECS + """, mapped AS (SELECT event_id AS id, o_custkey AS account, symbol, CASE WHEN event_id % 7 <> 0 THEN 1.25 ELSE 0 END AS commission, CASE WHEN event_id % 7 <> 0 THEN 0.5 ELSE 0 END AS fees,
 CASE WHEN o_custkey IS NULL THEN 'order missing' WHEN symbol IS NULL THEN 'contract missing' WHEN event_id % 7 = 0 AND ts > TIMESTAMP '2024-01-01 05:55:00' THEN 'fee not settled' END AS reason
 FROM events LEFT JOIN orders ON o_orderkey = event_id * 2 LEFT JOIN specs ON contract_id = event_id % 2500 + 1)"""
_DETECT = """det AS (SELECT trade_id, unnest(['revenge', 'overtrading', 'while_down', 'after_losing_streak', 'first_of_session', 'holding_losers', 'size_escalation']) AS behaviour,
 unnest([CASE WHEN index > 0 THEN prev_loss AND minutes_since_exit <= 10 END, index >= 6, pnl_before < 0, losses_before >= 2, index = 0, CASE WHEN net <> 0 THEN net < 0 END, pnl_before < 0 AND qo > typical]) AS present, unnest([net, net, net, net, net, CAST(duration AS DOUBLE), net]) AS value FROM state, (SELECT median(CAST(qo AS DOUBLE)) AS typical FROM state)),
beh AS (SELECT behaviour, count(*) FILTER (present) AS n_with, avg(value) FILTER (present) AS mean_with, var_samp(value) FILTER (present) AS var_with, count(*) FILTER (NOT present) AS n_without, avg(value) FILTER (NOT present) AS mean_without, var_samp(value) FILTER (NOT present) AS var_without FROM det WHERE present IS NOT NULL AND value IS NOT NULL GROUP BY 1),
behc AS (SELECT *, mean_with - mean_without AS difference, CASE WHEN behaviour <> 'holding_losers' THEN (mean_with - mean_without) * n_with END AS cost FROM beh)"""

ORACLE = {
    "f01_fifo_trades": f"WITH {_TRADES} SELECT account, symbol, tid, direction, status, opened_at, closed_at, {r('qo', 'qty_opened')}, {r('qc', 'qty_closed')}, {r('avg_entry')}, {r('avg_exit')}, {r('points')}, {r('gross')}, {r('commission')}, {r('fees')}, {r('net')}, scaled_in, scaled_out, CAST(duration AS BIGINT) AS duration FROM trades",
    "f02_fifo_lots": f"WITH {_SLICES} SELECT account, symbol, CAST(tid AS BIGINT) AS tid, entry_id, exit_id, {r('qty')}, {r('points')} FROM lots",
    "f05_sessions": f"WITH {_TRADES} SELECT trade_id, session_date, segment, hour(local) AS entry_hour, isodow(local) AS entry_weekday FROM facts",
    "s01_fresh_fills": f"WITH {_FILLS} SELECT account, count(*) AS n, {r('sum(qty)', 'qty')} FROM fills WHERE account >= 100 GROUP BY 1",
    "s11_bar_upsert": f"WITH {_BARS.format(s=3600)} SELECT symbol, CAST(CASE WHEN hour(ts) < 3 THEN 2 ELSE 1 END AS BIGINT) AS version, count(*) AS n, {r('sum(close + CASE WHEN hour(ts) < 3 THEN 1 ELSE 0 END)', 'close')} FROM bars GROUP BY 1, 2",
    "s12_coverage": f"WITH {_BARS.format(s=3600)} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars FROM bars GROUP BY 1",
    "s13_missing_ranges": f"WITH {_BARS.format(s=3600)}, c AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1) SELECT symbol, TIMESTAMP '2023-12-31' AS range_start, a AS range_end FROM c WHERE a > TIMESTAMP '2023-12-31' UNION ALL SELECT symbol, b, TIMESTAMP '2024-02-01' FROM c WHERE b < TIMESTAMP '2024-02-01'",
    "s15_blotter": f"WITH {_ORDERS} SELECT trade_id, account, opened_at, {r('net')} FROM (SELECT * FROM facts ORDER BY opened_at DESC, trade_id DESC LIMIT 51 OFFSET 100)",
    "s40_counts_by_state": "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1",
    "p01_outcomes": f"WITH {_ORDERS} SELECT *, {_REL} FROM (SELECT instrument, CASE WHEN net > 0 THEN 'winner' WHEN net < 0 THEN 'loser' ELSE 'scratch' END AS outcome, count(*) AS n, {r('sum(net)', 'net')} FROM facts GROUP BY 1, 2)",
    "f_m2_ticks": f"WITH {_FILLS}, k AS (SELECT symbol, price, round_even(CAST(CAST(price AS DECIMAL(20,8)) / tick AS DOUBLE), 0) * CAST(tick AS DOUBLE) AS t FROM fills JOIN inst USING (symbol)) SELECT symbol, {r('sum(t)', 'ticked')}, count(*) FILTER (abs(t - price) > 1e-9) AS moved FROM k GROUP BY 1",
    "a20_performance": f"""WITH {_ORDERS}, a AS (SELECT instrument, count(*) AS n, count(*) FILTER (net > 0) AS winners, count(*) FILTER (net < 0) AS losers, count(*) FILTER (net = 0) AS scratches, sum(net) AS net, sum(gross) AS gross, sum(costs) AS costs, coalesce(sum(net) FILTER (net > 0), 0) AS gross_profit, coalesce(-sum(net) FILTER (net < 0), 0) AS gross_loss,
 max(net) FILTER (net > 0) AS largest_win, min(net) FILTER (net < 0) AS largest_loss, avg(CAST(net AS DOUBLE)) FILTER (net > 0) AS avg_win, avg(CAST(net AS DOUBLE)) FILTER (net < 0) AS avg_loss, median(CAST(net AS DOUBLE)) FILTER (net > 0) AS median_win, median(CAST(net AS DOUBLE)) FILTER (net < 0) AS median_loss,
 avg(CAST(net AS DOUBLE)) AS expectancy, avg(r_multiple) AS expectancy_r, count(r_multiple) AS n_r, stddev_samp(r_multiple) AS sd_r, median(CAST(net AS DOUBLE)) AS median, stddev_samp(CAST(net AS DOUBLE)) AS stdev, skewness(CAST(net AS DOUBLE)) AS skew, kurtosis_pop(CAST(net AS DOUBLE)) AS kurtosis, quantile_cont(CAST(net AS DOUBLE), [0.05, 0.25, 0.75, 0.95]) AS p,
 avg(duration) AS hold, avg(duration) FILTER (net > 0) AS hold_winners, avg(duration) FILTER (net < 0) AS hold_losers FROM facts GROUP BY 1)
SELECT instrument, n, winners, losers, scratches, {', '.join(r(x) for x in 'net gross costs gross_profit gross_loss largest_win largest_loss avg_win avg_loss median_win median_loss expectancy expectancy_r sd_r median stdev skew kurtosis hold hold_winners hold_losers'.split())}, n_r, {_REL}, {r('winners / (winners + losers)', 'win_rate')}, {r('CAST(gross_profit AS DOUBLE) / CAST(gross_loss AS DOUBLE)', 'profit_factor')}, {r('avg_win / abs(avg_loss)', 'payoff')}, {r('CAST(costs AS DOUBLE) / CAST(gross_profit AS DOUBLE)', 'cost_ratio')}, {r('sqrt(least(n_r, 100)) * expectancy_r / sd_r', 'sqn')}, {r('p[1]', 'p5')}, {r('p[2]', 'p25')}, {r('p[3]', 'p75')}, {r('p[4]', 'p95')} FROM a""",
    "a21_daily_pnl": f"WITH {_ORDERS} SELECT instrument, session_date, {r('sum(net)', 'net')} FROM facts GROUP BY 1, 2",
    "a22_risk_adjusted": f"WITH {_ORDERS}, d AS (SELECT instrument, session_date, CAST(sum(net) AS DOUBLE) AS x FROM facts GROUP BY 1, 2) SELECT instrument, count(*) AS days, CASE WHEN count(*) >= 20 THEN {r('avg(x) / nullif(stddev_samp(x), 0) * sqrt(252)', 'sharpe').replace(' AS sharpe', '')} END AS sharpe, CASE WHEN count(*) >= 20 THEN {r('avg(x) / nullif(sqrt(sum(CASE WHEN x < 0 THEN x * x ELSE 0 END) / (count(*) - 1)), 0) * sqrt(252)', 's').replace(' AS s', '')} END AS sortino FROM d GROUP BY 1",
    "a25_kelly": f"""WITH {_ORDERS}, a AS (SELECT account, count(*) AS n, count(*) FILTER (net > 0) AS w, count(*) FILTER (net < 0) AS l, avg(CAST(net AS DOUBLE)) FILTER (net > 0) AS aw, avg(CAST(net AS DOUBLE)) FILTER (net < 0) AS al FROM facts GROUP BY 1),
k AS (SELECT *, CASE WHEN w > 0 AND l > 0 THEN w / (w + l) - (1 - w / (w + l)) / (aw / abs(al)) END AS k FROM a)
SELECT account, n, {r('k', 'kelly')}, {r('k / 2', 'half_kelly')}, CASE WHEN w + l = 0 THEN 'no decided trades' WHEN w = 0 THEN 'no winners' WHEN l = 0 THEN 'no losers' END AS reason, concat_ws(',', CASE WHEN n < 100 THEN 'small sample' END, CASE WHEN k > 0.25 THEN 'aggressive' END, CASE WHEN k <= 0 THEN 'no edge' END) AS warnings FROM k""",
    "a26_segment_cube": f"""WITH {_ORDERS}, x AS (SELECT CAST(net AS DOUBLE) AS x, net, unnest(['month', 'weekday', 'direction', 'instrument', 'duration_bucket']) AS dimension, unnest([strftime(session_date, '%Y-%m'), CAST(isodow(session_date) AS VARCHAR), direction, instrument, CASE WHEN duration < 60 THEN 'under_1m' WHEN duration < 300 THEN '1m_to_5m' WHEN duration < 900 THEN '5m_to_15m' WHEN duration < 3600 THEN '15m_to_1h' WHEN duration < 14400 THEN '1h_to_4h' ELSE 'over_4h' END]) AS key FROM facts),
s AS (SELECT dimension, key, count(*) AS n, count(*) FILTER (net > 0) AS winners, sum(net) AS net, CAST(sum(net) AS DOUBLE) / count(*) AS expectancy FROM x GROUP BY 1, 2),
o AS (SELECT a.dimension, a.key, CAST(sum(b.net) AS DOUBLE) / count(b.x) AS re, var_samp(b.x) AS rv, count(b.x) AS rn FROM s a LEFT JOIN x b ON a.dimension = b.dimension AND a.key <> b.key GROUP BY 1, 2),
v AS (SELECT dimension, key, var_samp(x) AS sv FROM x GROUP BY 1, 2),
d AS (SELECT s.*, re, CASE WHEN n >= 2 AND rn >= 2 THEN (expectancy - re) / sqrt(((n - 1) * sv + (rn - 1) * rv) / (n + rn - 2)) END AS cd FROM s JOIN o USING (dimension, key) JOIN v USING (dimension, key))
SELECT dimension, key, n, winners, {r('net')}, {r('expectancy', None, 9)}, {r('re', 'rest_expectancy', 8)}, {r('cd', 'cohens_d')}, {_REL}, CASE WHEN cd IS NULL THEN NULL WHEN abs(cd) < 0.2 THEN 'negligible' WHEN abs(cd) < 0.5 THEN 'small' WHEN abs(cd) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d""",
    "a31_resample": f"WITH {_BARS.format(s=14400)} SELECT * FROM bars",
    "w01_equity_curve": f"WITH {_CURVE} SELECT account, trade_id, i, {r('cum_net')}, {r('cum_r')}, {r('peak')}, {r('drawdown')} FROM curve",
    "w02_drawdown_periods": f"WITH {_CURVE} SELECT account, first_i, last_i, {r('depth')}, trough_i, recovered_i FROM periods",
    "w03_drawdown_summary": f"WITH {_CURVE}, p AS (SELECT account, count(*) AS periods, min(depth) AS deepest, avg(CAST(depth AS DOUBLE)) AS mean_depth, max(last_i - first_i + 1) AS longest FROM periods GROUP BY 1), c AS (SELECT account, avg(CASE WHEN drawdown < 0 THEN 1.0 ELSE 0.0 END) AS underwater, arg_max(drawdown, i) AS current, arg_max(cum_net, i) AS net FROM curve GROUP BY 1) SELECT account, {r('underwater')}, {r('current', 'current')}, {r('net')}, periods, {r('deepest')}, {r('mean_depth')}, longest, {r('CAST(net AS DOUBLE) / nullif(CAST(-deepest AS DOUBLE), 0)', 'recovery_factor')} FROM c LEFT JOIN p USING (account)",
    "w05_streaks": f"WITH {_ORDERS}, t AS (SELECT account, net > 0 AS won, row_number() OVER (PARTITION BY account ORDER BY closed_at, opened_at, trade_id) AS i, row_number() OVER (PARTITION BY account, net > 0 ORDER BY closed_at, opened_at, trade_id) AS j FROM facts WHERE net <> 0), u AS (SELECT account, won, count(*) AS len, max(i) AS last_i FROM t GROUP BY account, won, i - j) SELECT account, max(len) FILTER (won) AS longest_win, max(len) FILTER (NOT won) AS longest_loss, {r('avg(len) FILTER (won)', 'mean_win')}, {r('avg(len) FILTER (NOT won)', 'mean_loss')}, arg_max(CASE WHEN won THEN len ELSE -len END, last_i) AS current FROM u GROUP BY 1",
    "w07_session_state": f"WITH {_STATE} SELECT trade_id, index, {r('pnl_before')}, CAST(losses_before AS BIGINT) AS losses_before, CAST(minutes_since_exit AS BIGINT) AS minutes_since_exit, prev_loss FROM state",
    "w11_bar_gaps": f"WITH {_BARS.format(s=3600)}, g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) SELECT symbol, p + INTERVAL 1 HOUR AS gap_start, ts AS gap_end FROM g WHERE ts - p > INTERVAL 1 HOUR",
    "w13_atr": f"WITH RECURSIVE {_BARS.format(s=3600)}, t AS (SELECT symbol, ts, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), a AS (SELECT symbol, CAST(14 AS BIGINT) AS i, avg(tr) AS atr FROM t WHERE i BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14 UNION ALL SELECT a.symbol, t.i, (a.atr * 13 + t.tr) / 14 FROM a JOIN t ON a.symbol = t.symbol AND t.i = a.i + 1) SELECT symbol, {r('arg_max(atr, i)', 'atr')}, max(i) AS n_ranges FROM a GROUP BY 1",
    "w15_benjamini_hochberg": f"WITH {_ORDERS}, p AS (SELECT account, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (net < 0) / count(*), 9) END AS p FROM facts GROUP BY 1), k AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS raw, p * count(*) OVER () / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS tied FROM p WHERE p IS NOT NULL), q AS (SELECT account, least(1, min(tied) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k) SELECT p.account, n, {r('p.p', 'p')}, {r('q.q', 'q')} FROM p LEFT JOIN q USING (account)",
    "j03_as_of_equity": f"WITH {_ORDERS}, e AS (SELECT o_custkey AS account, o_orderdate AS as_of, max(o_totalprice) AS equity FROM orders GROUP BY 1, 2) SELECT f.trade_id, f.account, f.closed_at, CASE WHEN epoch(f.closed_at) - epoch(e.as_of) < 691200 THEN {r('e.equity', 'x').replace(' AS x', '')} END AS equity, CASE WHEN epoch(f.closed_at) - epoch(e.as_of) < 691200 THEN e.as_of END AS as_of FROM facts f ASOF LEFT JOIN e ON f.account = e.account AND f.closed_at >= e.as_of",
    "x01_excursions": f"WITH {_TRADES}, {_BARS.format(s=3600)}, c AS (SELECT t.trade_id, t.direction, t.avg_entry, least(min(b.low), t.avg_entry) AS lo, greatest(max(b.high), t.avg_entry) AS hi, count(*) AS n_bars FROM facts t JOIN bars b ON t.symbol = b.symbol AND epoch(b.ts) >= floor(epoch(t.opened_at) / 3600) * 3600 AND floor(epoch(b.ts)) <= floor(epoch(t.closed_at)) GROUP BY 1, 2, 3) SELECT trade_id, {r("CASE direction WHEN 'long' THEN avg_entry - lo ELSE hi - avg_entry END", 'mae')}, {r("CASE direction WHEN 'long' THEN hi - avg_entry ELSE avg_entry - lo END", 'mfe')}, n_bars FROM c",
    "j08_first_touch": f"WITH {_TRADES}, {_BARS.format(s=3600)} SELECT t.trade_id, min(b.ts) AS touched_at FROM facts t JOIN bars b ON t.symbol = b.symbol AND epoch(b.ts) >= floor(epoch(t.opened_at) / 3600) * 3600 AND b.ts <= t.closed_at AND t.avg_entry * 2 BETWEEN b.low AND b.high GROUP BY 1",
    "d08_behaviours": f"WITH {_STATE}, {_DETECT} SELECT behaviour, n_with, n_without, {', '.join(r(x, None, 4) for x in 'mean_with var_with mean_without var_without difference cost'.split())} FROM behc",
    "e02_leaks": f"WITH {_STATE}, {_DETECT}, c AS (SELECT behaviour AS pattern, trade_id, cost / count(*) OVER (PARTITION BY behaviour) AS share FROM det JOIN behc USING (behaviour) WHERE present AND cost < 0), f AS (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY abs(share) DESC, pattern) = 1 AS first FROM c) SELECT pattern, {r('sum(share)', 'naive', 3)}, {r('sum(CASE WHEN first THEN share ELSE 0 END)', 'exclusive', 3)}, count(*) AS n_trades, count(*) FILTER (first) AS n_exclusive FROM f GROUP BY 1",
    "e03_due_periods": f"WITH {_ORDERS}, d AS (SELECT DISTINCT account, session_date FROM facts), p AS (SELECT account, unnest(['daily', 'weekly', 'monthly', 'quarterly', 'yearly']) AS report_type, unnest([session_date, CAST(date_trunc('week', session_date) AS DATE), CAST(date_trunc('month', session_date) AS DATE), CAST(date_trunc('quarter', session_date) AS DATE), CAST(date_trunc('year', session_date) AS DATE)]) AS period_start FROM d), c AS (SELECT account, report_type, period_start, count(*) AS sessions FROM p GROUP BY 1, 2, 3), e AS (SELECT *, CAST(CASE report_type WHEN 'daily' THEN period_start WHEN 'weekly' THEN period_start + 6 WHEN 'monthly' THEN period_start + INTERVAL 1 MONTH - INTERVAL 1 DAY WHEN 'quarterly' THEN period_start + INTERVAL 3 MONTH - INTERVAL 1 DAY ELSE period_start + INTERVAL 1 YEAR - INTERVAL 1 DAY END AS DATE) AS period_end FROM c) SELECT account, report_type, period_start, sessions, period_end FROM e WHERE period_end < DATE '1999-06-15' AND sessions >= CASE report_type WHEN 'daily' THEN 1 WHEN 'weekly' THEN 3 WHEN 'monthly' THEN 8 WHEN 'quarterly' THEN 20 ELSE 60 END",
    "f_s1_root_symbols": "SELECT upper(substr(o_orderpriority, 3, 2)) AS root, count(*) AS n FROM orders GROUP BY 1",
    "d10_feature_matrix": f"WITH {_ORDERS}, x AS (SELECT trade_id, CAST(quantity AS DOUBLE) AS q, duration / 86400 AS h, CAST(isodow(session_date) - 1 AS DOUBLE) AS w FROM facts), a AS (SELECT avg(q) AS mq, stddev_samp(q) AS sq, avg(h) AS mh, stddev_samp(h) AS sh, avg(w) AS mw, stddev_samp(w) AS sw FROM x) SELECT trade_id, {r('(q - mq) / sq', 'quantity')}, {r('(h - mh) / sh', 'hold')}, {r('(w - mw) / sw', 'weekday')} FROM x, a",
    "l04_ridge": f"""WITH {_ORDERS}, x AS (SELECT CAST(net AS DOUBLE) AS y, CAST(quantity AS DOUBLE) AS q, duration / 86400 AS h FROM facts), m AS (SELECT avg(y) AS my, avg(q) AS mq, avg(h) AS mh FROM x), c AS (SELECT any_value(my) AS my, any_value(mq) AS mq, any_value(mh) AS mh, sum((q - mq) ** 2) + 10 AS qq, sum((h - mh) ** 2) + 10 AS hh, sum((q - mq) * (h - mh)) AS qh, sum((q - mq) * (y - my)) AS qy, sum((h - mh) * (y - my)) AS hy FROM x, m),
 b AS (SELECT *, (qy * hh - hy * qh) / (qq * hh - qh * qh) AS bq, (hy * qq - qy * qh) / (qq * hh - qh * qh) AS bh FROM c) SELECT unnest(['intercept', 'quantity', 'hold']) AS term, unnest([{r('my - bq * mq - bh * mh', 'a', 4).replace(' AS a', '')}, {r('bq', 'a', 4).replace(' AS a', '')}, {r('bh', 'a', 4).replace(' AS a', '')}]) AS beta FROM b""",
    "q05_exit_selection": f"""WITH {_ORDERS}, {_EXITS}, d AS (SELECT session_date, CASE WHEN row_number() OVER (ORDER BY session_date) <= 25 THEN 0 ELSE (row_number() OVER (ORDER BY session_date) - 26) // 10 + 1 END AS fold FROM (SELECT DISTINCT session_date FROM facts)), {_PICK}
SELECT CAST(fold AS BIGINT) AS fold, {r('target', None, 4)}, {r('score', None, 4)}, applicable AS scored, {r('delta', None, 4)} FROM pick""",
    "q06_exit_recommendation": f"""WITH {_ORDERS}, {_EXITS}, d AS (SELECT session_date, CASE WHEN row_number() OVER (ORDER BY session_date) <= 25 THEN 0 ELSE (row_number() OVER (ORDER BY session_date) - 26) // 10 + 1 END AS fold FROM (SELECT DISTINCT session_date FROM facts)), {_PICK},
 m AS (SELECT target, count(*) AS votes FROM pick GROUP BY 1), t AS (SELECT arg_max(target, votes * 100 - target) AS target, max(votes) AS votes FROM m), a AS (SELECT count(*) AS folds, CAST(sum(applicable) AS BIGINT) AS scored, sum(delta) AS delta FROM pick),
 xb AS (SELECT row_number() OVER (ORDER BY session_date) - 1 AS i, * FROM (SELECT session_date, count(CASE WHEN known AND r IS NOT NULL THEN 1 END) AS m, sum(CASE WHEN known AND r IS NOT NULL AND mfe >= target THEN (target - r) * CAST(risk AS DOUBLE) ELSE 0 END) AS dl FROM x JOIN d USING (session_date) JOIN pick USING (fold) GROUP BY 1) WHERE m > 0),
 xd AS (SELECT rep, {_DRAW.format("'exit::' || rep || ':' || k")} % n AS i FROM (SELECT count(*) AS n FROM xb), range(1000) u(rep), range(n) z(k)),
 xk AS (SELECT list(v ORDER BY v) AS l FROM (SELECT sum(dl) / sum(m) AS v FROM xd JOIN xb USING (i) GROUP BY rep))
SELECT folds, scored, {r('target', None, 4)}, {r('votes / folds', 'stability', 4)}, {r('delta / scored', 'mean_delta', 4)}, {r('l[26]', 'low', 4)}, {r('l[976]', 'high', 4)}, CASE WHEN scored < 40 THEN 'too few scored trades' WHEN votes / folds < 0.6 THEN 'unstable choice' WHEN NOT delta / scored > 0 THEN 'no improvement' WHEN NOT l[26] > 0 THEN 'within chance' END AS reason FROM a, t, xk""",
    "e07_evidence": f"""WITH {_ORDERS}, a AS (SELECT account, count(*) AS n, count(*) FILTER (net > 0) AS w, count(*) FILTER (net < 0) AS l, avg(CAST(net AS DOUBLE)) FILTER (net > 0) AS aw, avg(CAST(net AS DOUBLE)) FILTER (net < 0) AS al FROM facts GROUP BY 1),
k AS (SELECT account, unnest(['n', 'kelly']) AS k, unnest([CAST(n AS DOUBLE), CASE WHEN w > 0 AND l > 0 THEN w / (w + l) - (1 - w / (w + l)) / (aw / abs(al)) END]) AS v FROM a) SELECT account || '.' || k AS key, {r('v', 'value')}, v IS NULL AS gap FROM k""",
    "s35_map_fills": f"WITH {_MAPPED} SELECT id, account, symbol, {r('commission')}, {r('fees')}, reason FROM mapped",
    "s36_specs": f"WITH {_SPECS} SELECT contract_id, symbol, {r('tick')}, {r('point * tick', 'tick_value')}, CAST(2 AS BIGINT) AS digits FROM specs",
    "s37_next_cursor": f"""WITH {_MAPPED}, z AS (SELECT unnest(['all', 'settled', 'known']) AS kind)
SELECT kind AS "case", CAST(greatest(99, least(greatest(max(id), 99), coalesce(min(id) FILTER (reason IS NOT NULL OR (kind = 'known' AND (account IS NULL OR account % 10 = 3))) - 1, 9000000000000))) AS BIGINT) AS cursor
FROM z JOIN mapped ON kind = 'all' OR reason IS NULL GROUP BY 1""",
    "x03_replay_windows": f"WITH {_TRADES}, z AS (SELECT *, CASE WHEN duration <= 120 THEN 15 WHEN duration <= 900 THEN 60 WHEN duration <= 3600 THEN 120 WHEN duration <= 14400 THEN 300 WHEN duration <= 86400 THEN 900 ELSE 3600 END AS b FROM facts) SELECT trade_id, symbol, CAST(b AS BIGINT) AS bar_seconds, opened_at - to_seconds(b * 120) AS window_start, closed_at + to_seconds(b * 60) AS window_end FROM z",
    "x03_replay_markers": f"WITH {_SLICES}, k AS (SELECT *, row_number() OVER (PARTITION BY account, symbol, tid, role ORDER BY ts, fill_id) AS i, count(*) OVER (PARTITION BY account, symbol, tid, role) AS n FROM slices) SELECT account, symbol, CAST(tid AS BIGINT) AS tid, CASE WHEN role = 'entry' THEN CASE WHEN i = 1 THEN 'entry' ELSE 'scale_in' END WHEN i = n THEN 'exit' ELSE 'scale_out' END AS kind, fill_id, ts, {r('price')}, {r('q', 'qty')} FROM k",
}
ORACLE["e05_next_reports"] = f"SELECT * FROM ({ORACLE['e03_due_periods']}) ORDER BY period_end, period_start, account, report_type LIMIT 25"
ORACLE["e08_claims"] = f"WITH {_ORDERS}, n AS (SELECT account, count(*) AS n FROM facts GROUP BY 1) SELECT account AS claim_id, CASE WHEN account % 5 = 0 THEN 'uncited,unsupported' WHEN account % 3 = 0 THEN 'unsupported' ELSE '' END AS problems FROM n"
