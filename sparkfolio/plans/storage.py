"""Queries of sinks, state, bars at rest and their checks, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import fifo, stats
from ..sources import sinks, views
from .analytics import bare
from .oracle import _BARS, _ORDERS, _SLICES, _TRADES, r
from .queries import facts, rounded

TABLE: dict = {}


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


def trades(spark, sf):
    return fifo.trades(views.fills(spark, sf), views.instruments(spark)).withColumn("trade_id", F.concat_ws("-", "account", "symbol", F.col("tid").cast("string")))


_KEPT = f"WITH {_TRADES}, z AS (SELECT trade_id, tid, net, CASE WHEN tid % 3 = 0 THEN 'human ' || tid END AS note FROM trades)"


@query(f"{_KEPT} SELECT trade_id, CASE WHEN tid % 2 = 0 THEN {bare('net + 1')} ELSE {bare('net')} END AS net, CASE WHEN tid % 5 <> 1 THEN note END AS note FROM z")
def s17_trade_upsert(spark, sf):
    """Stored trades (all but those of number 1 in 5) with people's notes; a sync brings even ones with another net, and the missing ones."""
    t = trades(spark, sf).select("trade_id", "tid", F.col("net").cast("decimal(30,8)").alias("net"), F.when(F.col("tid") % 3 == 0, F.concat(F.lit("human "), F.col("tid").cast("string"))).alias("note"))
    stored = t.filter("tid % 5 <> 1").drop("tid")
    batch = t.filter("tid % 2 = 0 or tid % 5 = 1").select("trade_id", (F.col("net") + F.when(F.col("tid") % 2 == 0, 1).otherwise(0)).cast("decimal(30,8)").alias("net"))
    return rounded(sinks.merge(stored, batch, ["trade_id"], ["net"]))


@query(f"WITH {_SLICES} SELECT account, symbol, count(*) AS n, {bare('sum(CASE WHEN tid % 2 = 0 THEN q * 2 ELSE q END)')} AS qty FROM slices GROUP BY 1, 2")
def s18_leg_replace(spark, sf):
    """The legs of even trades are written anew, with twice the size."""
    legs = fifo.slices(views.fills(spark, sf)).select("account", "symbol", "tid", "role", "fill_id", F.col("qty").cast("double").alias("qty"))
    new = legs.filter("tid % 2 = 0").withColumn("qty", F.col("qty") * 2)
    return rounded(sinks.replace_keys(legs, new, ["account", "symbol", "tid"]).groupBy("account", "symbol").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")))


_MAE = f"WITH {_TRADES}, w AS (SELECT trade_id, closed_at, avg_entry, CASE WHEN tid % 2 = 0 THEN 1.5 END AS mae FROM facts)"


def with_mae(spark, sf):
    return facts(spark, sf).select("trade_id", "closed_at", "avg_entry", F.when(F.col("tid") % 2 == 0, F.lit(1.5)).alias("mae"))


@query(f"{_MAE} SELECT trade_id, closed_at FROM w WHERE mae IS NULL ORDER BY closed_at DESC, trade_id DESC LIMIT 100")
def s19_excursion_work(spark, sf):
    return rounded(sinks.excursion_work(with_mae(spark, sf), 100).select("trade_id", "closed_at"))


@query(f"{_MAE} SELECT trade_id, {bare('coalesce(mae, 0.5)')} AS mae FROM w")
def s20_column_update(spark, sf):
    t = with_mae(spark, sf)
    return rounded(sinks.updated(t, t.filter("mae is null").select("trade_id", F.lit(0.5).alias("mae")), ["trade_id"], ["mae"]).select("trade_id", "mae"))


@query(f"WITH {_TRADES}, l AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY tid DESC) AS k FROM trades) SELECT account, symbol, tid, {bare('qo - qc')} AS position FROM l WHERE k = 1 AND status = 'open'")
def s21_open_positions(spark, sf):
    return rounded(sinks.open_positions(trades(spark, sf)).select("account", "symbol", "tid", (F.col("qty_opened") - F.col("qty_closed")).alias("position")))


@query(f"WITH {_ORDERS}, o AS (SELECT count(*) AS n, CAST(sum(net) AS DOUBLE) AS net FROM facts), s AS (SELECT instrument AS key, count(*) AS n, CAST(sum(net) AS DOUBLE) AS net FROM facts GROUP BY 1) SELECT 'overall' AS scope, '' AS dimension, '' AS key, unnest(['n', 'net']) AS metric, unnest([CAST(n AS DOUBLE), {bare('net')}]) AS value FROM o UNION ALL SELECT 'segment', 'instrument', key, unnest(['n', 'net']), unnest([CAST(n AS DOUBLE), {bare('net')}]) FROM s")
def s22_metric_rows(spark, sf):
    """Metric rows, merged into a store that holds the same slices from before."""
    t = views.order_facts(spark, sf)
    overall, segments = stats.summary(t), stats.summary(t, "instrument").withColumn("dimension", F.lit("instrument")).withColumnRenamed("instrument", "key")
    now = sinks.metric_rows(overall, segments, ["n", "net"])
    stored = now.withColumn("value", F.lit(0.0))
    return rounded(sinks.merge(stored, now, ["scope", "dimension", "key", "metric"], ["value"]))


@query(f"WITH {_ORDERS} SELECT account, count(*) AS n, max(k) AS last_i FROM (SELECT account, row_number() OVER (PARTITION BY account ORDER BY closed_at, opened_at, trade_id) AS k FROM facts) GROUP BY 1")
def s23_equity_overwrite(spark, sf):
    """The curves of even accounts are replaced by renumbered ones; the stored ones lacked their newest trade."""
    curve = stats.equity_curve(views.order_facts(spark, sf), "account").select("account", "trade_id", "i")
    stored = curve.filter("account % 2 = 1 or i > 1")
    out = sinks.replace_keys(stored, curve.filter("account % 2 = 0"), ["account"])
    return rounded(out.groupBy("account").agg(F.count("*").alias("n"), F.max("i").alias("last_i")))


@query(f"WITH {_ORDERS} SELECT account, arg_max(trade_id, (closed_at, trade_id)) AS trade_id, {bare('arg_max(net, (closed_at, trade_id))')} AS net FROM facts GROUP BY 1")
def s28_latest_row(spark, sf):
    """The newest row of an append-only store by key."""
    t = views.order_facts(spark, sf).select("account", "trade_id", "closed_at", "net")
    return rounded(sinks.latest(t, ["account"], F.struct("closed_at", "trade_id")).select("account", "trade_id", "net"))


@query(f"WITH {_ORDERS} SELECT trade_id, CASE WHEN trade_id % 3 = 0 AND trade_id % 10 >= 5 THEN 'breakout' WHEN trade_id % 4 = 0 THEN 'old' END AS setup, CASE WHEN trade_id % 3 = 0 AND trade_id % 10 >= 5 THEN {bare('(trade_id % 10) / 10')} END AS confidence FROM facts")
def s26_accept_setup(spark, sf):
    t = views.order_facts(spark, sf).select("trade_id", F.when(F.col("trade_id") % 4 == 0, "old").alias("setup"), F.lit(None).cast("double").alias("confidence"))
    members = t.filter("trade_id % 3 = 0 and trade_id % 10 >= 5").select("trade_id", ((F.col("trade_id") % 10) / 10).alias("confidence"))
    return rounded(sinks.accept_setup(t, members, "breakout"))


@query("SELECT user_id AS account, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-14 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def s29_rolling_count(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("account"), F.col("ts").cast("timestamp").alias("ts"))
    return sinks.rolling_count(e, "2024-01-15 00:00:00")


_RECON = f"WITH {_TRADES}, o AS (SELECT account, coalesce(sum(CASE WHEN status = 'closed' AND CAST(d0 + CASE WHEN isodow(d0) = 6 THEN 2 ELSE 0 END AS DATE) = DATE '2024-01-15' THEN net END), 0) AS net FROM trades GROUP BY 1)"


@query(f"{_RECON} SELECT account, {r('net')} FROM o")
def s31_realised(spark, sf):
    return rounded(sinks.realised(trades(spark, sf), "2024-01-15"))


@query(f"{_RECON} SELECT account, {bare('net')} AS ours, CASE WHEN account % 7 <> 0 THEN {bare('net + (account % 3) * 0.01')} END AS theirs, CASE WHEN account % 7 <> 0 THEN {bare('-(account % 3) * 0.01')} END AS difference, CASE WHEN account % 7 <> 0 THEN account % 3 < 2 END AS matches FROM o")
def f08_reconciliation(spark, sf):
    """Against a broker who is up to two cents off and silent on every seventh account; a cent and a half is let pass."""
    ours = sinks.realised(trades(spark, sf), "2024-01-15").withColumn("net", F.col("net").cast("double"))
    theirs = ours.filter("account % 7 <> 0").withColumn("net", F.col("net") + (F.col("account") % 3) * 0.01)
    return rounded(sinks.reconciled(ours, theirs, 0.015))


@query(f"WITH {_TRADES} SELECT trade_id, {bare('round(coalesce(points, 0), 8) * 2 * CAST(point AS DOUBLE)')} AS gross, {bare('round(coalesce(points, 0), 8) * 2 * CAST(point AS DOUBLE) - commission - fees')} AS net FROM trades JOIN inst USING (symbol)")
def f04_respec(spark, sf):
    new = views.instruments(spark).withColumn("point", (F.col("point") * 2).cast("decimal(12,2)"))
    return rounded(sinks.respecified(trades(spark, sf), new).select("trade_id", "gross", "net"))


@query(f"WITH {_SLICES} SELECT account, symbol, CAST(tid AS BIGINT) AS tid, {bare('sum(CASE role WHEN %sentry%s THEN q ELSE -q END * dir)' % (chr(39), chr(39)))} AS position FROM slices WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2, 3")
def w10_signed_position(spark, sf):
    """What each trade held at a moment, short as negative."""
    s = fifo.slices(views.fills(spark, sf)).filter(F.col("ts") <= F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    return rounded(s.groupBy("account", "symbol", "tid").agg(F.sum(F.when(F.col("role") == "entry", F.col("qty")).otherwise(-F.col("qty")) * F.col("dir")).alias("position")))


def stored_bars(spark, sf):
    """Bars at rest: hours of all symbols, five minutes of three, minutes of one."""
    at = lambda s: views.bars(spark, sf, s).withColumn("seconds", F.lit(s))
    return at(3600).unionByName(at(300).filter("symbol in ('click', 'error', 'view')")).unionByName(at(60).filter("symbol = 'view'"))


def _bar(seconds: int, where: str = "TRUE", name: str = "bars") -> str:
    return _BARS.format(s=seconds).replace("tick AS", f"tick{seconds} AS").replace("FROM tick ", f"FROM tick{seconds} WHERE {where} ").replace("bars AS", f"{name} AS")


@query("SELECT DISTINCT event_type AS symbol, unnest(CASE WHEN event_type = 'view' THEN [60, 300, 3600] WHEN event_type IN ('click', 'error') THEN [300, 3600] ELSE [3600] END)::BIGINT AS seconds FROM events")
def s09_timeframes(spark, sf):
    return rounded(B.stored_timeframes(stored_bars(spark, sf)))


@query(f"WITH {_bar(900, chr(34) + 'symbol' + chr(34) + ' IN (' + ', '.join(chr(39) + x + chr(39) for x in ('click', 'error', 'view')) + ')')} SELECT symbol, ts, {r('open')}, {r('high')}, {r('low')}, {r('close')}, {r('volume')} FROM bars")
def s10_adaptive_bars(spark, sf):
    """Quarters of an hour, made of five minutes where these are stored; hours are too coarse."""
    return rounded(B.at_resolution(stored_bars(spark, sf), 900).drop("seconds"))


@query(f"WITH {_BARS.format(s=3600)} SELECT symbol, arg_max(close, ts) AS close, max(ts) AS ts FROM bars WHERE ts <= TIMESTAMP '2024-01-15 10:30:00' GROUP BY 1")
def s14_latest_close(spark, sf):
    return rounded(B.latest_close(views.bars(spark, sf), "2024-01-15 10:30:00"))


@query(f"WITH {_BARS.format(s=3600)}, b AS (SELECT *, CASE WHEN hour(ts) = 3 THEN low - 1 ELSE high END AS h2 FROM bars) SELECT symbol, count(*) AS n FROM b WHERE NOT (h2 >= low AND open BETWEEN low AND h2 AND close BETWEEN low AND h2) GROUP BY 1")
def p21_invalid_bars(spark, sf):
    b = views.bars(spark, sf).withColumn("high", F.when(F.hour("ts") == 3, F.col("low") - 1).otherwise(F.col("high")))
    return rounded(B.invalid(b).groupBy("symbol").agg(F.count("*").alias("n")))


@query(f"WITH {_BARS.format(s=3600)} SELECT symbol, ts, {bare('high - low')} AS range, {bare('(high + low) / 2')} AS midpoint, close >= open AS is_up, high > greatest(open, close) AND low < least(open, close) AS sequence_ambiguous FROM bars")
def f_d8_bar_shapes(spark, sf):
    return rounded(B.shapes(views.bars(spark, sf)).select("symbol", "ts", "range", "midpoint", "is_up", "sequence_ambiguous"))


@query(f"WITH {_TRADES}, {_BARS.format(s=300)} SELECT f.trade_id, CASE WHEN epoch_us(f.opened_at) // 1000000 - epoch(b.ts) < 300 THEN {bare('b.close')} END AS close FROM facts f ASOF LEFT JOIN bars b ON f.symbol = b.symbol AND f.opened_at >= b.ts")
def j04_bar_at(spark, sf):
    t = facts(spark, sf).select("trade_id", "symbol", "opened_at")
    return rounded(B.bar_at(t, views.bars(spark, sf, 300), "opened_at", 300).select("trade_id", "close"))


@query(f"WITH {_TRADES}, {_BARS.format(s=3600)}, c AS (SELECT t.trade_id, t.opened_at, t.closed_at, count(*) AS n_bars, min(epoch(b.ts)) AS a, max(epoch(b.ts)) AS z FROM facts t JOIN bars b ON t.symbol = b.symbol AND epoch(b.ts) >= floor(epoch(t.opened_at) / 3600) * 3600 AND floor(epoch(b.ts)) <= floor(epoch(t.closed_at)) GROUP BY 1, 2, 3) SELECT trade_id, n_bars, a > epoch(opened_at) OR z + 3600 < epoch(closed_at) OR z - a > (n_bars - 1) * 3600 AS partial FROM c")
def w12_partial_coverage(spark, sf):
    return rounded(B.partial_coverage(facts(spark, sf), views.bars(spark, sf), 3600))


@query(f"WITH {_TRADES}, {_BARS.format(s=300)} SELECT trade_id FROM facts t WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = t.symbol AND epoch(b.ts) BETWEEN epoch_us(t.opened_at) // 1000000 - 600 AND epoch_us(t.closed_at) // 1000000 + 300)")
def j10_has_bars(spark, sf):
    return B.has_bars(facts(spark, sf), views.bars(spark, sf, 300), 600, 300).select("trade_id")


_EXC = "SELECT t.trade_id, {s} AS seconds, t.direction, t.avg_entry, least(min(b.low), t.avg_entry) AS lo, greatest(max(b.high), t.avg_entry) AS hi, count(*) AS n_bars FROM facts t JOIN b{s} b ON t.symbol = b.symbol AND epoch(b.ts) >= floor(epoch(t.opened_at) / {s}) * {s} AND floor(epoch(b.ts)) <= floor(epoch(t.closed_at)) WHERE duration >= {low} AND duration < {high} GROUP BY 1, 2, 3, 4"


@query(f"WITH {_TRADES}, {_bar(900, chr(34) + 'symbol' + chr(34) + ' IN (' + ', '.join(chr(39) + x + chr(39) for x in ('click', 'error', 'view')) + ')', 'b900')}, {_bar(3600, 'TRUE', 'b3600')}, e AS ({_EXC.format(s=900, low=0, high=86400)} UNION ALL {_EXC.format(s=3600, low=86400, high=10**12)}) SELECT trade_id, CAST(seconds AS BIGINT) AS seconds, n_bars, {bare('CASE direction WHEN %slong%s THEN avg_entry - lo ELSE hi - avg_entry END' % (chr(39), chr(39)))} AS mae, {bare('CASE direction WHEN %slong%s THEN hi - avg_entry ELSE avg_entry - lo END' % (chr(39), chr(39)))} AS mfe FROM e")
def x02_backfill(spark, sf):
    """Trades of less than a day by quarters of an hour, longer ones by hours."""
    t = facts(spark, sf).select("trade_id", "symbol", "direction", "opened_at", "closed_at", "avg_entry", "duration")
    return rounded(B.backfill(t, stored_bars(spark, sf), [(0, 900), (86400, 3600)]))


@query(f"WITH {_SLICES}, w AS (SELECT account, symbol, tid, sum(CASE role WHEN 'entry' THEN q ELSE -q END) OVER (PARTITION BY account, symbol, tid ORDER BY ts, fill_id ROWS UNBOUNDED PRECEDING) AS p FROM slices) SELECT account, symbol, CAST(tid AS BIGINT) AS tid, {bare('max(p)')} AS quantity FROM w GROUP BY 1, 2, 3")
def s05_pattern_scan(spark, sf):
    """Trades with the size that patterns look at: the greatest position held."""
    return rounded(fifo.max_position(fifo.slices(views.fills(spark, sf))))


@query(f"WITH {_ORDERS} SELECT account, count(*) AS n, count(*) FILTER (trade_id % 100 = 7) AS found FROM facts GROUP BY 1")
def s16_counts(spark, sf):
    """A tenant's trades, and those that are looked up among them by id."""
    t = views.order_facts(spark, sf)
    return t.groupBy("account").agg(F.count("*").alias("n"), F.count_if(F.col("trade_id") % 100 == 7).alias("found"))


@query(f"WITH {_ORDERS}, k AS (SELECT instrument, count(DISTINCT session_date) AS days FROM facts GROUP BY 1) SELECT instrument, DATE '1999-01-01' AS as_of, days, 'old' AS assumptions FROM k WHERE instrument >= '3' UNION ALL SELECT instrument, DATE '1999-01-01', days, 'new' FROM k WHERE instrument < '3' UNION ALL SELECT instrument, DATE '1999-02-01', days, 'new' FROM k")
def s24_risk_upsert(spark, sf):
    """Risk metrics by (instrument, as_of) with their assumptions; a second run renews some of a day and adds another."""
    risk = stats.risk_adjusted(views.order_facts(spark, sf), "instrument").select("instrument", "days")
    at = lambda df, day, why: df.select("instrument", F.to_date(F.lit(day)).alias("as_of"), "days", F.lit(why).alias("assumptions"))
    batch = at(risk.filter("instrument < '3'"), "1999-01-01", "new").unionByName(at(risk, "1999-02-01", "new"))
    return rounded(sinks.merge(at(risk, "1999-01-01", "old"), batch, ["instrument", "as_of"], ["days", "assumptions"]))


@query("""WITH p AS (SELECT p_brand || '-' || p_type AS symbol, p_partkey % 3 = 0 AS late, p_size / 100 AS tick, p_retailprice AS point FROM part),
s AS (SELECT symbol, min(tick) AS tick, max(point) AS point FROM p WHERE NOT late AND tick < 0.3 GROUP BY 1), b AS (SELECT symbol, min(tick) AS tick FROM p WHERE late GROUP BY 1)
SELECT symbol, round(coalesce(b.tick, s.tick), 6) AS tick, round(s.point, 6) AS point FROM s FULL JOIN b USING (symbol)""")
def s30_instrument_upsert(spark, sf):
    """Brands and kinds of parts as instruments: later parts correct the ticks of known ones and bring new ones, whose point nobody knows yet."""
    p = views.table(spark, sf, "part").select(
        F.concat_ws("-", "p_brand", "p_type").alias("symbol"), (F.col("p_partkey") % 3 == 0).alias("late"), (F.col("p_size") / 100).alias("tick"), F.col("p_retailprice").alias("point")
    )
    stored = p.filter("not late and tick < 0.3").groupBy("symbol").agg(F.min("tick").alias("tick"), F.max("point").alias("point"))
    return rounded(sinks.merge(stored, p.filter("late").groupBy("symbol").agg(F.min("tick").alias("tick")), ["symbol"], ["tick"]))
