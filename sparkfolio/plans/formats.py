"""Queries of periods, placeholders, decimals, timeframes, landed fills and the total order of fills, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, payload
from ..operators import fifo, reports
from ..sources import mapping, scratch, versions, views
from ..sources import reports as report_store
from .oracle import _ORDERS, _SLICES, ORACLE, r
from .queries import rounded

TABLE: dict = {}


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


_P = "unnest(['daily', 'weekly', 'monthly', 'quarterly', 'yearly']) AS report_type, unnest(['day', 'week', 'month', 'quarter', 'year']) AS unit"
_END = "CAST({0} + CASE unit WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH WHEN 'quarter' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 YEAR END - INTERVAL 1 DAY AS DATE)"


@query(f"""WITH {_ORDERS}, d AS (SELECT session_date, {_P} FROM (SELECT DISTINCT session_date FROM facts)), s AS (SELECT *, CAST(date_trunc(unit, session_date) AS DATE) AS a FROM d), e AS (SELECT *, {_END.format('a')} AS z, CAST(date_trunc(unit, a - INTERVAL 1 DAY) AS DATE) AS b FROM s)
SELECT session_date, report_type, a AS period_start, z AS period_end, b AS previous_start, CAST(a - INTERVAL 1 DAY AS DATE) AS previous_end, z < DATE '1999-06-15' AS complete,
CASE unit WHEN 'day' THEN strftime(a, '%Y-%m-%d') WHEN 'week' THEN strftime(a, '%Y-%m-%d') || ' to ' || strftime(z, '%Y-%m-%d') WHEN 'month' THEN strftime(a, '%B %Y') WHEN 'quarter' THEN 'Q' || quarter(a) || ' ' || year(a) ELSE CAST(year(a) AS VARCHAR) END AS label FROM e""")
def f_d5_periods(spark, sf):
    """The periods that each session falls in, the ones before, and their names."""
    kinds = F.explode(F.array(*map(F.lit, exprs.PERIODS))).alias("report_type")
    d = views.order_facts(spark, sf).select("session_date").distinct().select("session_date", kinds)
    kind, start = F.col("report_type"), exprs.period_start(F.col("report_type"), F.col("session_date"))
    d = d.withColumn("period_start", start).withColumn("period_end", exprs.period_end(kind, F.col("period_start")))
    before = F.date_sub("period_start", 1)
    return d.withColumns({
        "previous_start": exprs.period_start(kind, before), "previous_end": exprs.period_end(kind, exprs.period_start(kind, before)),
        "complete": F.col("period_end") < F.to_date(F.lit("1999-06-15")), "label": exprs.period_label(kind, F.col("period_start")),
    })


@query(f"SELECT * FROM ({ORACLE['e03_due_periods']}) WHERE account % 3 <> 0")
def j11_due_without_reports(spark, sf):
    """Due periods less those that have a stored report: of every third account all were built by an earlier run."""
    due = reports.due_periods(views.order_facts(spark, sf), "1999-06-15")
    store = versions.Store(spark, scratch.folder(spark, "reports"))
    text = lambda name: F.lit("{}").alias(name)
    report_store.save(store, due.filter("account % 3 = 0").select(
        "account", "report_type", F.lit("ready").alias("status"), "period_start", "period_end", F.lit("built").alias("headline"), text("findings"), text("evidence"),
        F.date_add("period_end", 1).cast("timestamp").alias("generated_at"),
    ))
    made = report_store.existing_periods(store.read("reports"))
    return rounded(reports.due_periods(views.order_facts(spark, sf), "1999-06-15", made))


@query(f"WITH {_ORDERS}, a AS (SELECT account, count(*) AS n, sum(net) > 0 AS won FROM facts GROUP BY 1) SELECT account, 'Account ' || account || ' closed ' || n || ' trades ([unavailable]), ' || n || ' in all.' || CASE WHEN won THEN ' Up.' ELSE '' END AS said FROM a")
def f_s4_render(spark, sf):
    """A text with placeholders, one of them unknown, filled in for each account."""
    a = views.order_facts(spark, sf).groupBy("account").agg(F.count("*").alias("n"), (F.sum("net") > 0).alias("won"))
    text = F.concat(F.lit("Account {{ account }} closed {{counts.all}} trades ({{ segments[0].gone }}), {{counts.all}} in all."), F.when(F.col("won"), " Up.").otherwise(""))
    values = F.create_map(F.lit("account"), F.col("account").cast("string"), F.lit("counts.all"), F.col("n").cast("string"))
    return a.select("account", exprs.render(text, values).alias("said"))


_TRIM = "CASE WHEN regexp_matches({0}, '^-?\\d+\\.\\d+$') THEN regexp_replace(regexp_replace({0}, '0+$', ''), '\\.$', '') ELSE {0} END"


@query(rf"WITH p AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(20,8)) AS VARCHAR) AS price, CASE WHEN p_size % 10 = 0 THEN 'n/a' ELSE CAST(CAST(p_size / 8 AS DECIMAL(20,8)) AS VARCHAR) END AS size FROM part), t AS (SELECT p_partkey, {_TRIM.format('price')} AS price, {_TRIM.format('size')} AS size FROM p) SELECT p_partkey, CASE WHEN price NOT LIKE '%.%' THEN price || '.00' WHEN price LIKE '%.__%' THEN price ELSE price || '0' END AS price, size FROM t")
def f_s6_decimals(spark, sf):
    """Prices with two digits at least, sizes with no more than they need."""
    p = views.table(spark, sf, "part")
    text = lambda c: c.cast("decimal(20,8)").cast("string")
    size = F.when(F.col("p_size") % 10 == 0, "n/a").otherwise(text(F.col("p_size") / 8))
    return p.select("p_partkey", exprs.trim_decimal(text(F.col("p_retailprice")), 2).alias("price"), exprs.trim_decimal(size).alias("size"))


@query("SELECT event_id AS id, event_id % 4 + 1 AS qty, CAST(CAST(event_id AS DECIMAL(20,8)) + CAST(0.12345678 AS DECIMAL(20,8)) AS VARCHAR) AS price FROM events WHERE event_id > 99")
def s34_landed(spark, sf):
    """Raw fills as JSON lines, read back behind a cursor; eight digits of a price stay what they are."""
    folder = scratch.folder(spark, "landed")
    e = views.table(spark, sf, "events")
    price = (F.col("event_id").cast("decimal(20,8)") + F.lit("0.12345678").cast("decimal(20,8)")).cast("decimal(20,8)")
    raw = e.select(
        F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("order_id"), (F.col("event_id") % 2500 + 1).alias("contract_id"), "ts", F.lit("Buy").alias("action"),
        (F.col("event_id") % 4 + 1).alias("qty"), price.alias("price"),
    )
    raw.write.json(folder)
    return mapping.landed(spark, folder, 99).select("id", "qty", F.col("price").cast("string").alias("price"))


_FRAMES = ", ".join(f"('{k}', {v})" for k, v in exprs.TIMEFRAMES.items() if v >= 60)


@query(f"SELECT event_type AS symbol, name AS timeframe, count(DISTINCT floor(epoch(ts) / seconds)) AS bars FROM events, (VALUES {_FRAMES}) t(name, seconds) GROUP BY 1, 2")
def f_d7_timeframes(spark, sf):
    """How many bars of each named timeframe from a minute on the events make."""
    seconds = F.create_map(*(F.lit(x) for kv in exprs.TIMEFRAMES.items() for x in kv))
    names = F.explode(F.array(*(F.lit(k) for k, v in exprs.TIMEFRAMES.items() if v >= 60))).alias("timeframe")
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), names)
    bar = F.floor(F.unix_timestamp("ts") / seconds[F.col("timeframe")])
    return e.groupBy("symbol", "timeframe").agg(F.count_distinct(bar).alias("bars"))


_HOURLY = _SLICES.replace("event_type AS symbol, ts,", "event_type AS symbol, date_trunc('hour', ts) AS ts, -event_id % 7 AS sequence,").replace("ORDER BY ts, fill_id", "ORDER BY ts, sequence, fill_id")


@query(f"WITH {_HOURLY} SELECT account, symbol, CAST(tid AS BIGINT) AS tid, role, fill_id, {r('q', 'qty')} FROM sl")
def t01_total_order(spark, sf):
    """Slices of fills whose times are whole hours: the broker's sequence decides, then the fill's number."""
    f = views.fills(spark, sf).withColumn("ts", F.date_trunc("hour", "ts")).withColumn("sequence", -F.col("fill_id") % 7)
    return rounded(fifo.slices(f).select("account", "symbol", "tid", "role", "fill_id", "qty"))


def payloads(spark, sf):
    """What an account's report holds, as one tree: counts, percentiles as a map, trades as an array of structs."""
    t = views.order_facts(spark, sf).withColumn("x", F.col("net").cast("double"))
    marks = [0.25, 0.5, 0.75]
    a = t.groupBy("account").agg(
        F.count("*").alias("n"), F.sum("x").alias("net"), F.percentile("x", marks).alias("p"), F.array_sort(F.collect_list(F.struct("trade_id", F.col("direction").alias("side"), F.col("quantity").cast("double").alias("quantity")))).alias("trades")
    )
    keys = F.array(*(F.lit(f"p{int(m * 100)}") for m in marks))
    return a.select("account", F.struct(F.struct("n", F.round("net", 4).alias("net")).alias("totals"), F.map_from_arrays(keys, F.transform("p", lambda v: F.round(v, 6))).alias("percentiles"), "trades").alias("payload"))


_TREE = f"""{_ORDERS}, a AS (SELECT account, count(*) AS n, sum(CAST(net AS DOUBLE)) AS net, quantile_cont(CAST(net AS DOUBLE), [0.25, 0.5, 0.75]) AS p FROM facts GROUP BY 1),
o AS (SELECT account, trade_id, direction, quantity, row_number() OVER (PARTITION BY account ORDER BY trade_id) - 1 AS i FROM facts),
leaves AS (SELECT account, 'totals.n' AS path, CAST(n AS DOUBLE) AS number, NULL AS text FROM a UNION ALL SELECT account, 'totals.net', round(net, 4), NULL FROM a
UNION ALL SELECT account, 'percentiles.' || unnest(['p25', 'p50', 'p75']), unnest([round(p[1], 6), round(p[2], 6), round(p[3], 6)]), NULL FROM a
UNION ALL SELECT account, 'trades[' || i || '].' || unnest(['trade_id', 'side', 'quantity']), unnest([CAST(trade_id AS DOUBLE), NULL, CAST(quantity AS DOUBLE)]), unnest([NULL, direction, NULL]) FROM o)"""


@query(f"WITH {_TREE} SELECT account, path, {r('number')}, text FROM leaves")
def f_j1_payload_paths(spark, sf):
    """Every leaf of each account's payload under its dotted path."""
    found = payload.dotted(payloads(spark, sf), "payload", "account")
    number = F.expr("try_cast(value as double)")
    return rounded(found.select("account", "path", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text")))


@query(f"WITH {_ORDERS} SELECT account, count(*) AS n, round(quantile_cont(CAST(net AS DOUBLE), 0.5), 6) + 0.0 AS middle, count(*) FILTER (direction = 'long') AS longs, {r('sum(quantity)', 'quantity')}, min(trade_id) AS first FROM facts GROUP BY 1")
def f_a1_round_trip(spark, sf):
    """Payloads to paths, back to trees, to JSON and from it; then read from: a field, a map's value, sums over an array."""
    p = payloads(spark, sf)
    kind = p.schema["payload"].dataType
    again = payload.rebuilt(payload.dotted(p, "payload", "account"), kind, "payload", "account")
    again = again.select("account", F.from_json(F.to_json("payload"), kind).alias("t"))
    total = F.aggregate("t.trades", F.lit(0.0), lambda s, x: s + x["quantity"])
    longs = F.size(F.filter("t.trades", lambda x: x["side"] == "long"))
    return rounded(again.select("account", F.col("t.totals.n").alias("n"), F.col("t.percentiles")["p50"].alias("middle"), longs.alias("longs"), total.alias("quantity"), F.col("t.trades")[0]["trade_id"].alias("first")))
