"""Queries of streams, versioned stores, pruned layouts, syncs, the compliance scan and replays, beside their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import compliance, fifo, replay, reports, stats
from ..operators import sequences as Q
from ..sources import layout, scratch, sinks, sync, versions, views
from ..sources import reports as report_store
from ..streaming import positions
from .analytics import bare
from .oracle import _DETECT, _FILLS, _MAPPED, _ORDERS, _SLICES, _STATE, _TRADES, ORACLE, r
from .queries import contract_specs, facts, f01_columns, rounded, state

TABLE: dict = {}


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


def store_of(spark: SparkSession, name: str) -> versions.Store:
    return versions.Store(spark, scratch.folder(spark, name))


def parts_by_time(fills: DataFrame) -> list[DataFrame]:
    """The fills in three consecutive thirds, and the middle one once more: what a source sends twice."""
    at = F.unix_micros("ts")
    a, b = fills.withColumn("_at", at.cast("double")).approxQuantile("_at", [1 / 3, 2 / 3], 0.01)
    return [fills.filter(at <= a), fills.filter((at > a) & (at <= b)), fills.filter((at > a) & (at <= b)), fills.filter(at > b)]


#: Files of a micro-batch, written by as many tasks.
FILES = 16


def streamed(spark: SparkSession, fills: list[DataFrame], store: versions.Store, **more) -> None:
    """Each DataFrame as a micro-batch of one stream (tables of few rows make fewer files, and so share one)."""
    folder = scratch.folder(spark, "landing")
    kinds = [x.split(" ") for x in positions.FILL.split(", ")]
    for i, part in enumerate(fills):
        part.select(*(F.col(c).cast(t).alias(c) for c, t in kinds)).repartition(FILES).write.parquet(f"{folder}/part={i}")
    source = spark.readStream.schema(positions.FILL + ", part int").option("maxFilesPerTrigger", FILES).option("pathGlobFilter", "*.parquet").parquet(folder).drop("part")
    run = positions.run(spark, source, store, scratch.folder(spark, "stream"), instruments=views.instruments(spark), **more)
    run.awaitTermination()


@query(ORACLE["f01_fifo_trades"])
def r03_resumed_trades(spark, sf):
    """Trades from keyed state, over four micro-batches of which one comes twice."""
    store = store_of(spark, "positions")
    streamed(spark, parts_by_time(views.fills(spark, sf)), store)
    return rounded(f01_columns(positions.trades(store, views.instruments(spark))))


@query(ORACLE["f01_fifo_trades"])
def r06_catch_up(spark, sf):
    """Fills up to a gap come as one batch; the stream begins at what is stored and brings some of them again."""
    store = store_of(spark, "positions")
    first, middle, _, last = parts_by_time(views.fills(spark, sf))
    positions.ingest(store, first.unionByName(middle), views.instruments(spark))
    streamed(spark, [middle, last], store, restart=True)
    return rounded(f01_columns(positions.trades(store, views.instruments(spark))))


@query(f"WITH {_FILLS} SELECT account, symbol, count(*) AS n, CAST(sum(qty) AS DOUBLE) AS qty, {r('sum(commission + fees)', 'costs')} FROM fills GROUP BY 1, 2")
def r05_stored_once(spark, sf):
    """Stored fills after batches that overlap and repeat."""
    store = store_of(spark, "positions")
    first, middle, again, last = parts_by_time(views.fills(spark, sf))
    for batch in (first.unionByName(middle), again.unionByName(last), last):
        positions.ingest(store, batch, views.instruments(spark))
    costs = F.sum(F.col("commission") + F.col("fees")).alias("costs")
    return rounded(store.read("fills").groupBy("account", "symbol").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), costs))


_JUNK = """junk AS (SELECT fill_id, account, symbol, ts, CASE WHEN fill_id % 13 = 0 THEN 'hold' ELSE side END AS side, CASE WHEN fill_id % 11 = 0 THEN 0 ELSE qty END AS qty,
 CASE WHEN fill_id % 17 = 0 THEN NULL ELSE price END AS price, CASE WHEN fill_id % 19 = 0 THEN -commission ELSE commission END AS commission FROM fills),
faults AS (SELECT account, CASE WHEN NOT qty > 0 THEN 'quantity not positive' WHEN price IS NULL OR price < 0 THEN 'price missing or negative' WHEN side NOT IN ('buy', 'sell') THEN 'side unknown' WHEN commission < 0 THEN 'cost negative' END AS reason, fill_id FROM junk),
twice AS (SELECT * FROM faults UNION ALL SELECT account, CASE WHEN reason IS NULL THEN 'repeated fill' ELSE reason END, fill_id FROM faults WHERE fill_id % 5 = 0)"""


@query(f"WITH {_FILLS}, {_JUNK} SELECT account, coalesce(reason, 'used') AS reason, count(*) AS n FROM twice GROUP BY 1, 2")
def p22_set_aside(spark, sf):
    """Fills with faults put into them, every fifth delivered twice, by the reason for which they are set aside."""
    f, at = views.fills(spark, sf), F.col("fill_id")
    f = f.withColumns({
        "side": F.when(at % 13 == 0, "hold").otherwise(F.col("side")), "qty": F.when(at % 11 == 0, 0).otherwise(F.col("qty")).cast("decimal(6,0)"),
        "price": F.when(at % 17 != 0, F.col("price")), "commission": F.when(at % 19 == 0, -F.col("commission")).otherwise(F.col("commission")),
    })
    found = fifo.screened(f.unionByName(f.filter("fill_id % 5 = 0")))
    return found.groupBy("account", F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


_PATTERNS = f"WITH {_ORDERS}, p AS (SELECT instrument AS pattern, count(*) AS n, sum(net) FILTER (net < 0) AS impact, count(*) FILTER (net < 0) * 2 > count(*) AS sig FROM facts GROUP BY 1)"


@query(f"{_PATTERNS} SELECT pattern, n, sig AS is_significant, {r('impact')}, row_number() OVER (ORDER BY sig DESC, impact ASC NULLS LAST, pattern) AS place FROM p")
def s25_patterns_replaced(spark, sf):
    """A scan's verdicts replace all of the scan before, and are listed by weight."""
    from pyspark.sql import Window as W

    t, store = views.order_facts(spark, sf), store_of(spark, "patterns")
    scan = lambda t: t.groupBy(F.col("instrument").alias("pattern")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("net") < 0, F.col("net"))).alias("impact"), (F.count_if(F.col("net") < 0) * 2 > F.count("*")).alias("is_significant")
    )
    old = scan(t.filter("net > 0").withColumn("instrument", F.concat(F.lit("old "), "instrument")))
    store.commit(replace={"patterns": old})
    store.commit(replace={"patterns": scan(t)})
    listed = sinks.ranked_patterns(store.read("patterns"))
    order = W.orderBy(F.col("is_significant").desc(), F.col("impact").asc_nulls_last(), "pattern")  # a row a pattern
    return rounded(listed.withColumn("place", F.row_number().over(order)))


def monthly_reports(spark, sf) -> versions.Store:
    """A store of monthly reports by account: those of even months first, then all months, of which the stored ones don't change."""
    month = F.trunc("session_date", "month")
    m = views.order_facts(spark, sf).groupBy("account", month.alias("period_start")).agg(F.count("*").alias("n"), F.sum("net").alias("net"))
    end = F.last_day("period_start")
    made = lambda word: m.select(
        "account", F.lit("monthly").alias("report_type"), F.lit("ready").alias("status"), "period_start", end.alias("period_end"), F.concat("n", F.lit(word)).alias("headline"),
        F.to_json(F.struct("n")).alias("findings"), F.to_json(F.struct(F.col("net").cast("double").alias("net"))).alias("evidence"), F.date_add(end, 1).cast("timestamp").alias("generated_at"),
    )
    store = store_of(spark, "reports")
    report_store.save(store, made(" trades").filter(F.month("period_start") % 2 == 0))
    report_store.save(store, made(" trades, again"))
    return store


_MONTHS = f"""{_ORDERS}, m AS (SELECT account, CAST(date_trunc('month', session_date) AS DATE) AS period_start, count(*) AS n FROM facts GROUP BY 1, 2),
reports AS (SELECT account, 'monthly' AS report_type, 'ready' AS status, period_start, last_day(period_start) AS period_end, n || CASE WHEN month(period_start) % 2 = 0 THEN ' trades' ELSE ' trades, again' END AS headline, CAST(last_day(period_start) + 1 AS TIMESTAMP) AS generated_at FROM m)"""


@query(f"WITH {_ORDERS} SELECT account, min(session_date) AS first, max(session_date) AS last FROM facts GROUP BY 1")
def s27_session_bounds(spark, sf):
    return report_store.session_bounds(views.order_facts(spark, sf))


@query(f"WITH {_MONTHS} SELECT account, report_type, period_start FROM reports")
def s27_existing_periods(spark, sf):
    return rounded(report_store.existing_periods(monthly_reports(spark, sf).read("reports")))


@query(f"WITH {_MONTHS} SELECT account, report_type, status, period_start, period_end, headline, generated_at FROM reports QUALIFY row_number() OVER (PARTITION BY account ORDER BY period_start DESC) = 1")
def s27_latest(spark, sf):
    return rounded(report_store.latest(monthly_reports(spark, sf).read("reports")).drop("findings", "evidence"))


@query(f"WITH {_MONTHS} SELECT * FROM reports ORDER BY period_start DESC, generated_at DESC, account LIMIT 50")
def s27_listing(spark, sf):
    return rounded(report_store.listing(monthly_reports(spark, sf).read("reports")))


_DUE = f"""{_MONTHS}, b AS (SELECT account, date_trunc('month', min(session_date)) AS a, least(date_trunc('month', max(session_date)), DATE '1999-05-01') AS z FROM facts GROUP BY 1)
SELECT b.account, CAST(x AS DATE) AS period_start FROM (SELECT account, unnest(range(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS x FROM b WHERE a <= z) b
WHERE NOT EXISTS (SELECT 1 FROM reports p WHERE p.account = b.account AND p.period_start = CAST(x AS DATE))"""


@query(f"WITH {_DUE}")
def e05_missing_months(spark, sf):
    """Months inside an account's sessions without a stored report."""
    import datetime

    bounds = report_store.session_bounds(views.order_facts(spark, sf))
    return report_store.missing(bounds, report_store.existing_periods(monthly_reports(spark, sf).read("reports")), datetime.date(1999, 6, 15))


def sync_input(spark, sf):
    """Events as raw fills, and what s35_map_fills joins them with; accounts whose number ends in 3 aren't known."""
    e = views.table(spark, sf, "events")
    raw = e.select(
        F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("order_id"), (F.col("event_id") % 2500 + 1).alias("contract_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 2 == 0, "Buy").otherwise("Sell").alias("action"), (F.col("event_id") % 4 + 1).alias("qty"), F.round("value", 2).cast("decimal(20,8)").alias("price"),
    )
    orders = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"))
    fees = raw.filter("id % 7 != 0").select("id", F.lit("1.25").cast("decimal(20,8)").alias("commission"), F.lit("0.5").cast("decimal(20,8)").alias("fees"))
    known = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("account")).filter("account % 10 <> 3")
    return raw, orders, contract_specs(spark, sf), fees, known


def synced(spark, sf) -> versions.Store:
    """Three runs: with half of the fills landed, with all of them, and once more."""
    store = store_of(spark, "sync")
    raw, orders, spec, fees, known = sync_input(spark, sf)
    half = raw.agg(F.max("id")).first()[0] // 2
    for landed in (raw.filter(F.col("id") <= half), raw, raw):
        sync.sync(store, landed, orders, spec, fees, known, "2024-01-01 06:00:00")
    return store


_SYNC = f"""{_MAPPED}, k AS (SELECT *, account IS NOT NULL AND account % 10 <> 3 AS known, reason IS NOT NULL OR account IS NULL OR account % 10 = 3 AS blocked FROM mapped), h AS (SELECT max(id) // 2 AS half FROM k),
c1 AS (SELECT greatest(0, least(greatest(max(id), 0), coalesce(min(id) FILTER (blocked) - 1, max(id)))) AS cur FROM k, h WHERE id > 0 AND id <= half),
c2 AS (SELECT greatest(any_value(cur), least(greatest(max(id), any_value(cur)), coalesce(min(id) FILTER (blocked) - 1, max(id)))) AS cur FROM k, c1 WHERE id > cur),
c3 AS (SELECT greatest(any_value(cur), least(greatest(max(id), any_value(cur)), coalesce(min(id) FILTER (blocked) - 1, max(id)))) AS cur FROM k, c2 WHERE id > cur),
runs AS (SELECT 1 AS run, 0 AS a, c1.cur AS z, half AS upto FROM c1, h UNION ALL SELECT 2, c1.cur, c2.cur, 9000000000000 FROM c1, c2 UNION ALL SELECT 3, c2.cur, c3.cur, 9000000000000 FROM c2, c3)"""


@query(f"WITH {_SYNC} SELECT CAST(run AS BIGINT) AS run, 'done' AS status, count(*) AS received, count(*) FILTER (reason IS NULL AND known) AS mapped, count(*) FILTER (reason IS NOT NULL) AS waiting, count(*) FILTER (reason IS NULL AND NOT known) AS \"unknown\", CAST(a AS BIGINT) AS cursor_from, CAST(z AS BIGINT) AS cursor_to FROM runs JOIN k ON id > a AND id <= upto GROUP BY run, a, z")
def s32_run_audit(spark, sf):
    return rounded(synced(spark, sf).read("runs").select("run", "status", "received", "mapped", "waiting", "unknown", "cursor_from", "cursor_to"))


@query(f"WITH {_SYNC} SELECT account, symbol, count(*) AS n, CAST(sum(id % 4 + 1) AS DOUBLE) AS qty, {r('sum(commission + fees)', 'costs')} FROM k WHERE reason IS NULL AND known AND id > 0 GROUP BY 1, 2")
def f07_synced_fills(spark, sf):
    """What three runs stored by account: each mapped fill of a known account once."""
    costs = F.sum(F.col("commission") + F.col("fees")).alias("costs")
    return rounded(synced(spark, sf).read("fills").groupBy("account", "symbol").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), costs))


def bars_at(spark, sf, *seconds: int) -> DataFrame:
    each = [views.bars(spark, sf, s).withColumn("seconds", F.lit(s)) for s in seconds]
    return functools.reduce(DataFrame.unionByName, each)


def _bars_at(*seconds: int) -> str:
    return f"""tick AS (SELECT event_type AS symbol, ts, event_id, round(value, 2) AS price FROM events),
bars AS (SELECT symbol, seconds, make_timestamp(CAST(floor(epoch(ts) / seconds) AS BIGINT) * seconds * 1000000) AS ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM tick, (SELECT unnest({list(seconds)}) AS seconds) GROUP BY symbol, seconds, floor(epoch(tick.ts) / seconds))""".replace("make_timestamp(CAST(floor(epoch(ts)", "make_timestamp(CAST(floor(epoch(any_value(tick.ts))").replace("(ts, event_id)", "(tick.ts, event_id)")


@query(f"WITH {_TRADES}, {_bars_at(300, 3600)} SELECT trade_id, count(*) AS n_bars, {r('min(low)', 'low')}, {r('sum(volume)', 'volume')} FROM facts f JOIN bars b ON f.symbol = b.symbol AND b.seconds = CASE WHEN duration < 86400 THEN 300 ELSE 3600 END AND b.ts BETWEEN opened_at AND closed_at GROUP BY 1")
def s08_bar_ranges(spark, sf):
    """Bars inside each trade, from a store by timeframe, symbol bucket and day."""
    path = scratch.folder(spark, "bars")
    layout.write_bars(bars_at(spark, sf, 300, 3600), path)
    asked = facts(spark, sf).select(
        "trade_id", "symbol", F.when(F.col("duration") < 86400, 300).otherwise(3600).alias("seconds"), F.col("opened_at").alias("range_start"), F.col("closed_at").alias("range_end")
    )
    found = layout.bars_of_ranges(spark, path, asked)
    return rounded(found.groupBy("trade_id").agg(F.count("*").alias("n_bars"), F.min("low").alias("low"), F.sum("volume").alias("volume")))


@query(f"WITH {_FILLS}, s AS (SELECT account, max(ts) - INTERVAL 3 DAY AS since FROM fills GROUP BY 1) SELECT account, symbol, count(*) AS n, CAST(sum(qty) AS DOUBLE) AS qty FROM fills JOIN s USING (account) WHERE ts >= since GROUP BY 1, 2")
def s03_fills_since(spark, sf):
    """Each account's fills of its last three days, from a store by account bucket and month."""
    path = scratch.folder(spark, "fills")
    f = views.fills(spark, sf)
    layout.write_fills(f, path)
    since = f.groupBy("account").agg((F.max("ts") - F.expr("interval 3 days")).alias("since"))
    return rounded(layout.fills_since(spark, path, since).groupBy("account", "symbol").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")))


_LEAKS = ORACLE["e02_leaks"]


@query(f"SELECT *, row_number() OVER (ORDER BY exclusive ASC NULLS LAST, pattern) AS place FROM ({_LEAKS})")
def t07_leak_order(spark, sf):
    s = state(spark, sf)
    b = Q.behaviours(s).filter("cost < 0").select("behaviour", "cost")
    each = F.array(*(F.struct(F.lit(k).alias("behaviour"), p.alias("present")) for k, (p, _) in Q.detectors(Q.typical_size(s)).items()))
    claims = s.select("trade_id", F.explode(each).alias("e")).filter("e.present").select("trade_id", F.col("e.behaviour").alias("behaviour")).join(b, "behaviour")
    costs = reports.attribute_leaks(claims.withColumnRenamed("behaviour", "pattern"))
    return rounded(reports.ranked_leaks(costs.withColumns({c: F.round(c, 3) for c in ("naive", "exclusive")})), 3)


def scan_input(spark, sf):
    """Orders as trades, customers as accounts, regions as set-ups, nations as market conditions, priorities as instruments."""
    t = views.order_facts(spark, sf).withColumns({"setup_id": F.col("trade_id") % 7, "condition_id": F.col("trade_id") % 30})
    instruments = t.select("instrument").distinct().select("instrument", F.substring("instrument", 1, 1).alias("root_symbol"), F.lit("America/Chicago").alias("zone"))
    accounts = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.lit(500.0).alias("max_daily_loss"), F.col("c_acctbal").alias("starting_balance"))
    named = lambda name, key: views.table(spark, sf, name).select(F.col(f"{key}key").cast("long").alias("id"), F.col(key.replace("key", "") + "name").alias("name"))
    setups = views.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    conditions = views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    orders = views.table(spark, sf, "orders").filter("o_orderkey % 3 = 0")
    equity = orders.groupBy(F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("timestamp").alias("as_of")).agg(F.max("o_totalprice").alias("equity"))
    return t, instruments, accounts, setups, conditions, equity


_SCAN = f"""{_ORDERS}, fl AS (SELECT min(session_date) AS floor FROM (SELECT DISTINCT session_date FROM facts ORDER BY session_date DESC LIMIT 1000)),
e AS (SELECT o_custkey AS account, o_orderdate AS as_of, max(o_totalprice) AS equity FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
t AS (SELECT f.* FROM facts f, fl WHERE session_date >= floor),
j AS (SELECT t.*, CASE WHEN epoch(t.opened_at) - epoch(e.as_of) < 691200 THEN e.equity END AS eq FROM t ASOF LEFT JOIN e ON t.account = e.account AND t.opened_at >= e.as_of),
scan AS (SELECT j.*, r_name AS setup, n_name AS market_condition, coalesce(eq, c_acctbal) AS account_equity, left(instrument, 1) AS root_symbol FROM j JOIN customer ON c_custkey = account LEFT JOIN region ON r_regionkey = trade_id % 7 LEFT JOIN nation ON n_nationkey = trade_id % 30)"""


@query(f"WITH {_SCAN} SELECT trade_id, root_symbol, setup, market_condition, {r('account_equity')}, CASE WHEN account_equity > 0 THEN {bare('CAST(risk AS DOUBLE) / account_equity')} END AS risk_pct_of_equity FROM scan")
def s06_compliance_scan(spark, sf):
    """Trades of the newest 1,000 sessions with what rules need; equity as of each entry."""
    found = compliance.scan(*scan_input(spark, sf), max_sessions=1000)
    return rounded(found.select("trade_id", "root_symbol", "setup", "market_condition", "account_equity", "risk_pct_of_equity"))


@query(f"WITH {_ORDERS}, n AS (SELECT unnest([1, 20, 1000, 100000]) AS most), d AS (SELECT DISTINCT session_date FROM facts WHERE session_date <= DATE '1999-06-15'), k AS (SELECT session_date, row_number() OVER (ORDER BY session_date DESC) AS i FROM d) SELECT CAST(most AS BIGINT) AS most, min(session_date) AS floor FROM k JOIN n ON i <= most GROUP BY 1")
def t09_session_floor(spark, sf):
    t = views.order_facts(spark, sf)
    each = [compliance.session_floor(t, n, "1999-06-15").select(F.lit(n).cast("long").alias("most"), "floor") for n in (1, 20, 1000, 100000)]
    return functools.reduce(DataFrame.unionByName, each)


_SHOWN = "CASE WHEN duration <= 120 THEN 15 WHEN duration <= 900 THEN 60 WHEN duration <= 3600 THEN 120 WHEN duration <= 14400 THEN 300 WHEN duration <= 86400 THEN 900 WHEN duration <= 604800 THEN 3600 ELSE 3600 END"
RESOLUTIONS = (15, 60, 120, 300, 900, 3600)


@query(f"WITH {_TRADES}, {_bars_at(*RESOLUTIONS)}, z AS (SELECT *, {_SHOWN} AS b FROM facts), j AS (SELECT trade_id, z.b, bars.* FROM z JOIN bars ON z.symbol = bars.symbol AND bars.seconds = z.b AND ts BETWEEN opened_at - to_seconds(b * 120) AND closed_at + to_seconds(b * 60)) SELECT trade_id, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY trade_id ORDER BY ts)) > b, FALSE) AS gap FROM j")
def x03_replay_bars(spark, sf):
    """The bars of each trade's window, at the resolution that its time held asks for."""
    return rounded(replay.window_bars(replay.windows(facts(spark, sf)), bars_at(spark, sf, *RESOLUTIONS)))


_FRAMES = f"""{_TRADES}, {_bars_at(*RESOLUTIONS)}, z AS (SELECT *, {_SHOWN} AS b, to_microseconds(CAST(floor((epoch_us(closed_at) - epoch_us(opened_at)) / 1000000) AS BIGINT) * 1000000) AS held FROM facts),
fr AS (SELECT trade_id, account, symbol, tid, b, unnest(['before_entry', 'entry', 'exit', 'after_exit']) AS kind, unnest([opened_at - held, opened_at - held, opened_at, closed_at]) AS a, unnest([opened_at, closed_at, closed_at + held, closed_at + to_seconds(b * 60)]) AS e FROM z),
seen AS (SELECT trade_id, kind, count(*) AS n_bars, min(bars.ts) AS fb, max(bars.ts) AS lb FROM fr JOIN bars ON fr.symbol = bars.symbol AND fr.b = bars.seconds AND bars.ts BETWEEN a AND e GROUP BY 1, 2),
marks AS (SELECT s.trade_id, kind, count(*) AS n_markers FROM seen s JOIN facts f ON s.trade_id = f.trade_id JOIN slices m ON m.account = f.account AND m.symbol = f.symbol AND m.tid = f.tid AND m.ts BETWEEN fb AND lb GROUP BY 1, 2)"""


@query(f"WITH {_FRAMES} SELECT fr.trade_id, fr.kind, a AS frame_start, e AS frame_end, coalesce(n_bars, 0) AS n_bars, coalesce(n_markers, 0) AS n_markers FROM fr LEFT JOIN seen USING (trade_id, kind) LEFT JOIN marks USING (trade_id, kind)")
def p14_frames(spark, sf):
    """Four views of each trade; a view shows the markers between its bars and no later one."""
    f = replay.frames(facts(spark, sf))
    s = fifo.slices(views.fills(spark, sf)).withColumn("trade_id", F.concat_ws("-", "account", "symbol", F.col("tid").cast("string")))
    return rounded(replay.frame_contents(f, bars_at(spark, sf, *RESOLUTIONS), s).select("trade_id", "kind", "frame_start", "frame_end", "n_bars", "n_markers"))


def with_stops(spark, sf) -> DataFrame:
    """Trades with a stop four parts in a hundred off the entry; every fifth has none, every seventh one on the wrong side."""
    off = F.when(F.col("tid") % 7 == 0, -0.04).otherwise(0.04) * F.when(F.col("direction") == "long", 1).otherwise(-1)
    return facts(spark, sf).withColumn("stop_price", F.when(F.col("tid") % 5 != 0, F.col("avg_entry") * (1 - off)))


@query(f"WITH {_TRADES}, s AS (SELECT *, CASE WHEN tid % 7 = 0 THEN -0.04 ELSE 0.04 END AS off, CASE direction WHEN 'long' THEN 1 ELSE -1 END AS way FROM facts WHERE tid % 5 <> 0) SELECT trade_id, opened_at AS box_from, closed_at AS box_to, {r('avg_entry', 'entry_price')}, {r('avg_entry * (1 - off * way)', 'stop_price')}, {r('avg_entry * off', 'risk_points')} FROM s WHERE off > 0 AND avg_entry > 0")
def x03_risk_box(spark, sf):
    return rounded(replay.risk_box(with_stops(spark, sf)))


def excursions_in_r(spark, sf) -> DataFrame:
    """Excursions over five-minute bars, also in units of the risk that with_stops() plans."""
    t = with_stops(spark, sf).join(views.instruments(spark).select("symbol", F.col("point").cast("double").alias("_point")), "symbol")
    value = F.col("_point") * F.col("qty_opened").cast("double")
    way = F.when(F.col("direction") == "long", 1).otherwise(-1)
    t = t.withColumns({"point_value": value, "risk": (F.col("avg_entry") - F.col("stop_price")) * way * value})
    return B.excursions(t.select("trade_id", "symbol", "direction", "opened_at", "closed_at", "avg_entry", "risk", "point_value"), views.bars(spark, sf, 300), 300)


_R = f"""{_TRADES}, {_bars_at(300)}, e AS (SELECT t.trade_id, t.tid, t.direction, t.avg_entry, t.avg_entry - least(min(b.low), t.avg_entry) AS down, greatest(max(b.high), t.avg_entry) - t.avg_entry AS up, count(*) AS n_bars
 FROM facts t JOIN bars b ON t.symbol = b.symbol AND epoch(b.ts) >= floor(epoch(t.opened_at) / 300) * 300 AND floor(epoch(b.ts)) <= floor(epoch(t.closed_at)) GROUP BY t.trade_id, t.tid, t.direction, t.avg_entry),
x AS (SELECT *, CASE direction WHEN 'long' THEN down ELSE up END AS mae, CASE direction WHEN 'long' THEN up ELSE down END AS mfe, CASE WHEN tid % 5 <> 0 AND tid % 7 <> 0 AND avg_entry > 0 THEN avg_entry * 0.04 END AS unit FROM e)"""


@query(f"WITH {_R} SELECT trade_id, {r('mae')}, {r('mfe')}, {bare('mae / unit', 5)} AS mae_r, {bare('mfe / unit', 5)} AS mfe_r, n_bars FROM x")
def x01_excursions_in_r(spark, sf):
    e = excursions_in_r(spark, sf)
    return rounded(e.withColumns({c: F.round(c, 5) for c in ("mae_r", "mfe_r")}))


@query(f"WITH {_R} SELECT trade_id, unnest(['mae', 'mfe']) AS kind, {bare('unnest([avg_entry - CASE direction WHEN %slong%s THEN mae ELSE -mae END, avg_entry + CASE direction WHEN %slong%s THEN mfe ELSE -mfe END])' % ((chr(39),) * 4))} AS price FROM x")
def x03_excursion_markers(spark, sf):
    e = excursions_in_r(spark, sf).join(facts(spark, sf).select("trade_id", "direction", "avg_entry"), "trade_id")
    return rounded(replay.excursion_markers(e))
