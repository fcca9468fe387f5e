"""Queries by operator of the survey, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import effect, outcome, reliability, root_symbol, to_tick
from ..operators import bars as B
from ..operators import discovery, fifo, models, replay, reports, rules, stats
from ..operators import resample as R
from ..operators import sequences as Q
from ..sources import mapping, stores, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Decimals and doubles as doubles of so many digits, times without zone."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        c = F.round(c.cast("double"), digits) + F.lit(0.0) if kind == "double" or kind.startswith("decimal") else c.cast("timestamp_ntz") if kind == "timestamp" else c
        c = c.cast("long") if kind in ("int", "bigint") else c
        out.append(c.alias(f.name))
    return df.select(*out)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return fifo.closed_facts(views.fills(spark, sf), views.instruments(spark))


def state(spark: SparkSession, sf: str) -> DataFrame:
    return Q.session_state(facts(spark, sf), "account")


def f01_columns(t: DataFrame) -> DataFrame:
    names = """account symbol tid direction status opened_at closed_at qty_opened qty_closed avg_entry avg_exit points gross commission fees net scaled_in scaled_out duration"""
    return t.select(*names.split())


@query
def f01_fifo_trades(spark, sf):
    return rounded(f01_columns(fifo.trades(views.fills(spark, sf), views.instruments(spark))))


@query
def f02_fifo_lots(spark, sf):
    return rounded(fifo.matches(fifo.slices(views.fills(spark, sf))).select("account", "symbol", "tid", "entry_id", "exit_id", "qty", "points"))


@query
def f05_sessions(spark, sf):
    return rounded(facts(spark, sf).select("trade_id", "session_date", "segment", "entry_hour", "entry_weekday"))


@query
def s01_fresh_fills(spark, sf):
    """Fills of accounts under 100 are stored, every tenth arrives twice."""
    f = views.fills(spark, sf)
    again = f.unionByName(f.filter("fill_id % 10 = 0"))
    return rounded(stores.fresh(again, f.filter("account < 100"), "account", "fill_id").groupBy("account").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")))


@query
def s11_bar_upsert(spark, sf):
    b = views.bars(spark, sf).withColumn("version", F.lit(1))
    new = b.filter("hour(ts) < 3").withColumns({"close": F.col("close") + 1, "version": F.lit(2)})
    return rounded(stores.upsert(b, new, "symbol", "ts").groupBy("symbol", "version").agg(F.count("*").alias("n"), F.sum("close").alias("close")))


@query
def s12_coverage(spark, sf):
    return rounded(B.coverage(views.bars(spark, sf)))


@query
def s13_missing_ranges(spark, sf):
    return rounded(stores.missing_ranges(B.coverage(views.bars(spark, sf)), "2023-12-31 00:00:00", "2024-02-01 00:00:00"))


@query
def s15_blotter(spark, sf):
    return rounded(stores.blotter(views.order_facts(spark, sf).select("trade_id", "account", "opened_at", "net"), 51, 100))


@query
def s40_counts_by_state(spark, sf):
    return views.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query
def p01_outcomes(spark, sf):
    t = views.order_facts(spark, sf)
    return rounded(t.groupBy("instrument", outcome(F.col("net")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("net").alias("net")).withColumn("reliability", reliability(F.col("n"))))


@query
def f_m2_ticks(spark, sf):
    f = views.fills(spark, sf).join(F.broadcast(views.instruments(spark)), "symbol")
    t = to_tick(F.col("price"), F.col("tick"))
    return rounded(f.groupBy("symbol").agg(F.sum(t).alias("ticked"), F.count_if(t != F.col("price")).alias("moved")))


@query
def a20_performance(spark, sf):
    return rounded(stats.summary(views.order_facts(spark, sf), "instrument"))


@query
def a21_daily_pnl(spark, sf):
    return rounded(stats.daily(views.order_facts(spark, sf), "instrument"))


@query
def a22_risk_adjusted(spark, sf):
    return rounded(stats.risk_adjusted(views.order_facts(spark, sf), "instrument"))


@query
def a25_kelly(spark, sf):
    return rounded(stats.kelly(views.order_facts(spark, sf), "account"))


@query
def a26_segment_cube(spark, sf):
    c = stats.cube(views.order_facts(spark, sf))
    c = c.withColumn("effect", effect(F.col("cohens_d"))).withColumns({"cohens_d": F.round("cohens_d", 6), "rest_expectancy": F.round("rest_expectancy", 8)})
    return rounded(c, 9)


@query
def a31_resample(spark, sf):
    return rounded(views.bars(spark, sf, 14400))


@query
def w01_equity_curve(spark, sf):
    return rounded(stats.equity_curve(views.order_facts(spark, sf), "account").select("account", "trade_id", "i", "cum_net", "cum_r", "peak", "drawdown"))


@query
def w02_drawdown_periods(spark, sf):
    return rounded(stats.drawdown_periods(stats.equity_curve(views.order_facts(spark, sf), "account"), "account"))


@query
def w03_drawdown_summary(spark, sf):
    return rounded(stats.drawdown_summary(views.order_facts(spark, sf), "account"))


@query
def w05_streaks(spark, sf):
    return rounded(stats.streaks(views.order_facts(spark, sf), "account"))


@query
def w07_session_state(spark, sf):
    return rounded(state(spark, sf).select("trade_id", "index", "pnl_before", "losses_before", "minutes_since_exit", "prev_loss"))


@query
def w11_bar_gaps(spark, sf):
    return rounded(B.gaps(views.bars(spark, sf), 3600))


@query
def w13_atr(spark, sf):
    return rounded(B.atr(views.bars(spark, sf)))


@query
def w15_benjamini_hochberg(spark, sf):
    """Share of an account's trades that lost, taken for a p value."""
    p = views.order_facts(spark, sf).groupBy("account").agg((F.count_if(F.col("net") < 0) / F.count("*")).alias("share"), F.count("*").alias("n"))
    return rounded(Q.benjamini_hochberg(p.withColumn("p", F.when(F.col("n") >= 5, F.round(F.col("share"), 9))).drop("share"), "p"))


@query
def j03_as_of_equity(spark, sf):
    """The latest order total of an account at or before each of its trades, under 8 days old."""
    t = views.order_facts(spark, sf).select("trade_id", "account", "closed_at")
    e = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("timestamp").alias("as_of")).agg(F.max("o_totalprice").alias("equity"))
    return rounded(B.as_of(t, e, "account", "closed_at", "as_of", "equity", 8 * 86400).withColumnRenamed("value_ts", "as_of"))


@query
def x01_excursions(spark, sf):
    t = facts(spark, sf).select("trade_id", "symbol", "direction", "opened_at", "closed_at", "avg_entry")
    return rounded(B.excursions(t, views.bars(spark, sf), 3600))


@query
def j08_first_touch(spark, sf):
    t = facts(spark, sf).select("trade_id", "symbol", "opened_at", "closed_at", (F.col("avg_entry") * 2).alias("target"))
    return rounded(B.first_touch(t, views.bars(spark, sf), 3600, "target"))


@query
def d08_behaviours(spark, sf):
    return rounded(Q.behaviours(state(spark, sf)), 4)


@query
def e02_leaks(spark, sf):
    s = state(spark, sf)
    b = Q.behaviours(s).filter("cost < 0").select("behaviour", "cost")
    each = F.array(*(F.struct(F.lit(k).alias("behaviour"), p.alias("present")) for k, (p, _) in Q.detectors(Q.typical_size(s)).items()))
    claims = s.select("trade_id", F.explode(each).alias("e")).filter("e.present").select("trade_id", F.col("e.behaviour").alias("behaviour")).join(F.broadcast(b), "behaviour")
    return rounded(reports.attribute_leaks(claims.withColumnRenamed("behaviour", "pattern")), 3)


@query
def e03_due_periods(spark, sf):
    return rounded(reports.due_periods(views.order_facts(spark, sf), "1999-06-15"))


@query
def f_s1_root_symbols(spark, sf):
    s = F.concat(F.upper(F.substring("o_orderpriority", 3, 2)), F.lit("Z"), (F.col("o_orderkey") % 10).cast("string"))
    return views.table(spark, sf, "orders").groupBy(root_symbol(s).alias("root")).agg(F.count("*").alias("n"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up chance of a gain per order, by its key."""
    t = views.order_facts(spark, sf)
    return t.select("trade_id", F.col("session_date").alias("session"), (F.lit(0.1) + (F.col("trade_id") % 8) * 0.1).alias("predicted"), (F.col("net") > 0).cast("int").alias("actual"))


def exits_input(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with made-up excursions; every fifth has none."""
    t = views.order_facts(spark, sf)
    known = F.col("trade_id") % 5 != 0
    return t.withColumns({"mfe_r": F.when(known, F.abs("r_multiple") + (F.col("trade_id") % 7) * 0.75), "mae_r": F.when(known, (F.col("trade_id") % 4) * 0.4)})


def features() -> dict:
    """Three of use, one known for half of the trades and a constant one."""
    return {"quantity": F.col("quantity"), "hold": F.col("duration") / 86400, "weekday": F.weekday("session_date"), "half": F.when(F.col("trade_id") % 2 == 0, F.col("quantity")), "constant": F.lit(1)}


@query
def d10_feature_matrix(spark, sf):
    m, _ = models.feature_matrix(views.order_facts(spark, sf), features())
    return rounded(m)


@query
def l04_ridge(spark, sf):
    """Coefficients of net on quantity and days held, penalty 10."""
    t = views.order_facts(spark, sf).select(F.col("net").cast("double").alias("net"), F.col("quantity").cast("double").alias("quantity"), (F.col("duration") / 86400).alias("hold"))
    b = models.fit_linear(t, ["quantity", "hold"], "net", 10.0)
    rows = [] if b is None else list(zip(["intercept", "quantity", "hold"], map(float, b), strict=True))
    return rounded(spark.createDataFrame(rows, "term string, beta double"), 4)


@query
def q05_exit_selection(spark, sf):
    return rounded(models.exit_selection(exits_input(spark, sf)), 4)


@query
def q06_exit_recommendation(spark, sf):
    return rounded(models.exit_recommendation(exits_input(spark, sf)), 4)


@query
def e07_evidence(spark, sf):
    return rounded(reports.evidence(stats.kelly(views.order_facts(spark, sf), "account").select("account", "n", "kelly"), "account"))


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw fills of orders and of parts as contracts; every seventh has no fee yet."""
    e = views.table(spark, sf, "events")
    raw = e.select(F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("order_id"), (F.col("event_id") % 2500 + 1).alias("contract_id"), F.col("ts").cast("timestamp").alias("ts"))
    orders = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"))
    fees = raw.filter("id % 7 != 0").select("id", F.lit(1.25).alias("commission"), F.lit(0.5).alias("fees"))
    return mapping.map_fills(raw, orders, contract_specs(spark, sf), fees, "2024-01-01 06:00:00")


def contract_specs(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "part")
    contracts = p.select(F.col("p_partkey").alias("contract_id"), F.col("p_brand").alias("symbol"), (F.col("p_size") % 40).alias("product_id"))
    products = spark.range(45).select(F.col("id").alias("product_id"), (F.col("id") * 5 + 5).alias("point"), F.when(F.col("id") % 2 == 0, "0.25").otherwise("0.01").alias("tick"))
    return mapping.specs(contracts, products)


@query
def s35_map_fills(spark, sf):
    return rounded(mapped(spark, sf).select("id", "account", "symbol", "commission", "fees", "reason"))


@query
def s36_specs(spark, sf):
    return rounded(contract_specs(spark, sf))


@query
def s37_next_cursor(spark, sf):
    """Where a cursor at 99 goes over all fills, over those that wait for nothing, and with accounts that aren't known."""
    m = mapped(spark, sf)
    known = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("account")).filter("account % 10 <> 3")
    cases = {"all": (m, None), "settled": (m.filter("reason is null"), None), "known": (m.filter("reason is null"), known)}
    each = [mapping.next_cursor(f, 99, k).select(F.lit(name).alias("case"), "cursor") for name, (f, k) in cases.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query
def x03_replay_windows(spark, sf):
    return rounded(replay.windows(facts(spark, sf)))


@query
def x03_replay_markers(spark, sf):
    return rounded(replay.markers(fifo.slices(views.fills(spark, sf))))


@query
def e05_next_reports(spark, sf):
    return rounded(reports.next_reports(reports.due_periods(views.order_facts(spark, sf), "1999-06-15")))


@query
def e08_claims(spark, sf):
    """Claims on accounts' numbers of trades: every third is off by one, every fifth cites nothing."""
    n = views.order_facts(spark, sf).groupBy("account").agg(F.count("*").alias("n"))
    said = F.when(F.col("account") % 3 == 0, F.col("n") + 1).otherwise(F.col("n"))
    cites = F.when(F.col("account") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.col("account").cast("string"), F.lit(".n"))))
    claims = n.select(F.col("account").alias("claim_id"), F.concat(F.lit("made "), said, F.lit(" trades")).alias("text"), cites.alias("cites"))
    return reports.check_claims(claims, reports.evidence(n, "account")).select("claim_id", F.concat_ws(",", "problems").alias("problems"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per account: FIFO trades of its fills, by session."""
    return facts(spark, sf).groupBy("account").agg(F.count("*").alias("n"), F.count_distinct("session_date").alias("sessions"), F.sum("net").alias("net"), F.count_if(F.col("net") > 0).alias("winners")).orderBy("account")
