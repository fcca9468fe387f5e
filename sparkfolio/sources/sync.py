"""One sync run: landed fills to stored ones, trades, cursor and a line of audit, all in one version of a store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import positions
from . import mapping
from .versions import Store

RUNS = "run long, started timestamp, finished timestamp, status string, received long, mapped long, waiting long, unknown long, cursor_from long, cursor_to long, error string"


def cursor(store: Store) -> int:
    """Where the last run got to; a value that isn't a number counts as the beginning."""
    held = store.value("cursor", 0)
    return held if isinstance(held, int) and not isinstance(held, bool) and held >= 0 else 0


def by_account(mapped: DataFrame, known: DataFrame) -> DataFrame:
    """(account, symbol, known, fills, waiting) of mapped fills: what a run does for each account; an unknown one gets nothing."""
    m = mapped.join(known.select("account", F.lit(True).alias("_known")), "account", "left")
    return m.groupBy("account", "symbol", F.coalesce("_known", F.lit(False)).alias("known")).agg(
        F.count_if(F.col("reason").isNull()).alias("fills"), F.count_if(F.col("reason").isNotNull()).alias("waiting")
    )


def ready(mapped: DataFrame, known: DataFrame) -> DataFrame:
    """Fills, as positions take them, of known accounts that wait for nothing."""
    m = mapped.filter("reason is null").join(known.select("account").distinct(), "account", "left_semi")
    return m.select("account", "symbol", F.col("id").alias("fill_id"), "ts", F.lower("action").alias("side"), "qty", "price", "commission", "fees")


def sync(store: Store, raw: DataFrame, orders: DataFrame, spec: DataFrame, fees: DataFrame, known: DataFrame, now: str, instruments: DataFrame | None = None) -> int:
    """Runs over the raw fills behind the cursor and returns the version that holds their effect.

    Fills of accounts not in ``known`` and fills that wait (mapping.map_fills) hold the cursor below them, so a later run sees them again, and
    what was stored meanwhile is a repeat then.  A run that fails changes nothing but the audit, which says why.
    """
    start, at = cursor(store), datetime.now(timezone.utc).replace(tzinfo=None)
    number = store.value("runs", 0) + 1
    line = {"run": number, "started": at, "cursor_from": start}

    def audit(**more) -> DataFrame:
        names = [x.split()[0] for x in RUNS.split(", ")]
        row = dict.fromkeys(names) | line | {"finished": datetime.now(timezone.utc).replace(tzinfo=None)} | more
        return store.spark.createDataFrame([tuple(row[n] for n in names)], RUNS)

    try:
        mapped = mapping.map_fills(raw.filter(F.col("id") > start), orders, spec, fees, now)
        seen = mapped.join(known.select("account", F.lit(True).alias("_known")).distinct(), "account", "left")
        n = seen.agg(
            F.count("*").alias("received"), F.count_if(F.col("reason").isNull() & F.col("_known")).alias("mapped"), F.count_if(F.col("reason").isNotNull()).alias("waiting"),
            F.count_if(F.col("reason").isNull() & F.col("_known").isNull()).alias("unknown"),
        ).first().asDict()
        end = mapping.next_cursor(mapped, start, known).first()["cursor"] if n["received"] else start
        done = audit(status="done", cursor_to=end, **n)
        return positions.ingest(store, ready(mapped, known), instruments, {"runs": done}, cursor=end, runs=number)
    except Exception as e:
        store.commit({"runs": audit(status="failed", cursor_to=start, error=str(e).split("\n")[0][:500])}, runs=number)
        raise
