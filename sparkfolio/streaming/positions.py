"""Positions resumed from keyed state: fills stream by, trades come out, and the state store holds what is open.

Per (account, symbol) the state is the open lots, the open trade's sums, the number of trades and the last fill: it's as large as what is
open, whatever came before, and no stored fill is read again.  Positions are dealt to BUCKETS groups of CELLS cells by hash: a group's rows come as
one, and a cell that a batch touches is read and written once.  Fills at or before the last one of their position are passed on as late.  The
sink commits each micro-batch as one version of a store: fills, closed trades, open positions and the batch number change together, and a
batch that is replayed after a crash changes nothing.  A late fill that is stored already is a repeat; any other makes its position stale: from
then on the sink rebuilds that position from its stored fills, until a new stream starts from ``opening``, so every split and order of batches
gives the trades of one batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import fifo
from ..sources.versions import Store

KEY = fifo.KEY
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILL = "account long, symbol string, fill_id long, ts timestamp, side string, qty decimal(6,0), price decimal(20,8), commission decimal(20,8), fees decimal(20,8)"
SUMS = (
    "tid long, dir int, opened_at timestamp, last_exit timestamp, qty_opened decimal(22,0), qty_closed decimal(22,0), paid decimal(38,8), got decimal(38,8), "
    "commission decimal(30,8), fees decimal(30,8), entries long, exits long, points decimal(38,8)"
)
#: What the stream puts out: a fill that was applied, a late one, a closed trade's sums, or those of the trade that is open.
OUT = f"{FILL}, kind string, trade struct<{SUMS.replace(' ', ':').replace(',:', ', ')}>"
_KINDS = [x.split() for x in SUMS.split(", ")]
_SUMS = [c for c, _ in _KINDS]
_FILL = [x.split()[0] for x in FILL.split(", ")]
#: Groups that the positions are dealt to by hash, cells of each group, and what stands for no time in a group's rows.
BUCKETS, CELLS, NO_TIME = 512, 16, -(1 << 63)
#: The rows of a group: OUT with the trade's sums side by side.
FLAT = ", ".join([
    FILL.replace("account long", "account string").replace("timestamp", "long"), "kind string", *(f"_{x}" for x in SUMS.replace("timestamp", "long").split(", ")),
])
_FLAT = [x.split()[0] for x in FLAT.split(", ")]
OPENING = f"account long, symbol string, last_ts timestamp, last_id long, {SUMS}, lot_qty decimal(22,0), lot_price decimal(20,8), lot_lo decimal(22,0)"


class Position:
    """One position: lots oldest first, the open trade's sums or None, how many trades there were."""

    def __init__(self, tid: int = 0, trade: dict | None = None, lots: list | None = None):
        self.tid, self.trade, self.lots = tid, trade, lots or []

    def apply(self, fill: dict) -> Iterator[dict]:
        """Takes a fill and yields the trade that it closes, if any."""
        sign, left, price = (1 if fill["side"] == "buy" else -1), fill["qty"], fill["price"]
        costs = {c: fill[c] for c in ("commission", "fees")}
        if self.trade and self.trade["dir"] != sign:
            t, closed = self.trade, min(left, sum(q for q, _ in self.lots))
            share = {c: (v * closed / fill["qty"]).quantize(Decimal("1e-8"), ROUND_HALF_EVEN) for c, v in costs.items()}
            left, matched = left - closed, closed
            while matched:
                q, p = self.lots[0]
                n = min(q, matched)
                t["points"] = (t["points"] or 0) + (price - p) * t["dir"] * n
                matched -= n
                self.lots[:1] = [(q - n, p)] if q > n else []
            t.update(last_exit=fill["ts"], qty_closed=t["qty_closed"] + closed, got=(t["got"] or 0) + price * closed, exits=t["exits"] + 1)
            for c, v in share.items():
                t[c] += v
                costs[c] -= v
            if not self.lots:
                self.trade = None
                yield t
        if left:
            if not self.trade:
                self.tid += 1
                zero = Decimal(0)
                self.trade = dict.fromkeys(_SUMS) | {
                    "tid": self.tid, "dir": sign, "opened_at": fill["ts"], "qty_opened": zero, "qty_closed": zero, "paid": zero, "commission": zero,
                    "fees": zero, "entries": 0, "exits": 0,
                }
            t = self.trade
            self.lots.append((left, price))
            t.update(qty_opened=t["qty_opened"] + left, paid=t["paid"] + price * left, entries=t["entries"] + 1)
            for c, v in costs.items():
                t[c] += v


def _plain(x):
    return None if x is None or x != x else x


class Resume(StatefulProcessor):
    """The positions of one bucket of keys, as cells of a map state: a batch reads and writes each cell that it touches once.

    A group of its own for each position would cost several calls by Arrow, pandas and the state's socket each; a bucket's rows come and
    go as one, and so do the positions of a cell, as a JSON text of which only touched positions are looked into.  Times are microseconds
    (NO_TIME: none), accounts and fill_ids texts, so that no null turns its neighbours into doubles.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "cell long", "held string")

    def _load(self, cell: int) -> dict:
        held = self.cells.getValue((cell,))
        return {} if held is None else {(x[0], x[1]): x for x in json.loads(held[0])}

    def _keep(self, cell: int, held: dict) -> None:
        self.cells.updateValue((cell,), (json.dumps(list(held.values()), separators=(",", ":"), default=str),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[int, dict[tuple, list[dict]]] = {}
        for part in rows:
            for cell, *x in zip(*(part[c].tolist() for c in ("cell", *_FILL))):
                fill = dict(zip(_FILL, x))
                fill["fill_id"] = None if _plain(fill["fill_id"]) is None else int(fill["fill_id"])
                touched.setdefault(cell, {}).setdefault((_plain(fill["account"]), _plain(fill["symbol"])), []).append(fill)
        out, none = [], (None,) * len(_SUMS)
        for cell, positions in touched.items():
            held, changed = self._load(cell), False
            for who, fills in positions.items():
                last, position = unpacked(held[who]) if who in held else (None, Position())
                ends = None
                nothing = (*who, *(None,) * (len(_FILL) - 2))
                for fill in sorted(fills, key=lambda f: _place(f["ts"], f["fill_id"])):
                    at = _place(fill["ts"], fill["fill_id"])
                    late = last is not None and at <= last
                    out.append((*who, *(fill[c] for c in _FILL[2:]), "late" if late else "fill", *none))
                    if not late:
                        out += [(*nothing, "closed", *(t[c] for c in _SUMS)) for t in position.apply(fill)]
                        last, ends = at, fill
                if ends is not None:
                    held[who], changed = packed(who, position, ends["ts"], ends["fill_id"]), True
                if position.trade:
                    out.append((*nothing, "open", *(position.trade[c] for c in _SUMS)))
            if changed:
                self._keep(cell, held)
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(_FLAT, zip(*out))})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        columns, cells = ["account", "symbol", "last_ts", "last_id", *_SUMS, "qtys", "prices"], {}
        for cell, *x in zip(*(initialState[c].tolist() for c in ("cell", *columns))):
            r = dict(zip(columns, x))
            lots = list(zip(r["qtys"], r["prices"]))
            trade = {c: _plain(r[c]) for c in _SUMS} if lots else None
            last_id, who = _plain(r["last_id"]), (_plain(r["account"]), _plain(r["symbol"]))
            cells.setdefault(cell, {})[who] = packed(who, Position(r["tid"], trade, lots), r["last_ts"], None if last_id is None else int(last_id))
        for cell, new in cells.items():  # a bucket may come in several parts
            self._keep(cell, self._load(cell) | new)

    def close(self) -> None:
        pass


def packed(who: tuple, position: Position, ts: int, fill_id: int | None) -> list:
    """A position and its last fill as JSON takes them; numbers with decimals become texts."""
    trade = position.trade and [position.trade[c] for c in _SUMS]
    return [*who, ts, fill_id, position.tid, trade, position.lots]


def unpacked(x: list) -> tuple[tuple, Position]:
    _, _, ts, fill_id, tid, trade, lots = x
    sums = trade and {c: Decimal(v) if v is not None and k.startswith("decimal") else v for (c, k), v in zip(_KINDS, trade)}
    return _place(ts, fill_id), Position(tid, sums, [(Decimal(q), Decimal(p)) for q, p in lots])


def _place(ts: int, fill_id: int | None) -> tuple:
    """Where a fill stands among its position's, as fifo orders them: no fill_id comes before any."""
    return ts, fill_id is not None, fill_id or 0


def opening(fills: DataFrame) -> DataFrame:
    """The state after ``fills``, a row for each open lot and one for a position that is flat: what a new stream starts from."""
    parts = fifo.slices(fills)
    closed = F.max(F.when(F.col("role") == "exit", F.col("hi")))
    now = parts.groupBy(*KEY).agg(F.max("tid").alias("tid"), F.coalesce(closed, F.lit(0)).alias("_closed"), F.max(F.struct("ts", "fill_id")).alias("_last"))
    lots = parts.filter("role = 'entry'").join(now.select(*KEY, "_closed"), KEY).filter("hi > _closed")
    lots = lots.select(*KEY, (F.col("hi") - F.greatest("lo", "_closed")).cast("decimal(22,0)").alias("lot_qty"), F.col("price").alias("lot_price"), F.col("lo").alias("lot_lo"))
    kinds = [x.split(" ") for x in OPENING.split(", ")]
    out = now.join(fifo.measured(fills), [*KEY, "tid"]).join(lots, KEY, "left").withColumns({"last_ts": F.col("_last.ts"), "last_id": F.col("_last.fill_id")})
    return out.select(*(F.col(c).cast(t).alias(c) for c, t in kinds))


def _micros(c: str):
    return F.coalesce(F.unix_micros(c), F.lit(NO_TIME)).alias(c)


def _dealt(df: DataFrame) -> DataFrame:
    cell = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS * CELLS))
    return df.withColumn("cell", cell).withColumn("bucket", F.col("cell") % BUCKETS).withColumn("account", F.col("account").cast("string"))


def trades_of(source: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The streaming rows OUT of a streaming DataFrame of fills; ``start``: rows of opening()."""
    kinds = [x.split(" ") for x in FILL.split(", ")]
    clean = _dealt(fifo.usable_rows(source).select(*(F.col(c).cast(t).alias(c) for c, t in kinds)))
    clean = clean.withColumns({"ts": _micros("ts"), "fill_id": F.col("fill_id").cast("string")})
    first = None
    if start is not None:
        lots = F.array_sort(F.collect_list(F.when(F.col("lot_qty").isNotNull(), F.struct("lot_lo", "lot_qty", "lot_price"))))
        whole = start.groupBy(*KEY, "last_ts", "last_id", *_SUMS).agg(lots.alias("_lots"))  # a row a position, so that no batch of rows parts its lots
        whole = whole.withColumns({c: _micros(c) for c in ("last_ts", "opened_at", "last_exit")} | {"last_id": F.col("last_id").cast("string"), "qtys": F.col("_lots.lot_qty"), "prices": F.col("_lots.lot_price")})
        first = _dealt(whole.drop("_lots")).groupBy("bucket")
    out = clean.groupBy("bucket").transformWithStateInPandas(Resume(), FLAT, "Update", "None", first)
    time = lambda c: F.when(F.col(c) != NO_TIME, F.timestamp_micros(c))
    sums = F.struct(*((time(f"_{c}") if t == "timestamp" else F.col(f"_{c}")).alias(c) for c, t in (x.split(" ") for x in SUMS.split(", "))))
    own = {"account": F.col("account").cast("long"), "ts": time("ts")}
    return out.select(*(own.get(c, F.col(c)).alias(c) for c in _FILL), "kind", F.when(F.col("_tid").isNotNull(), sums).alias("trade"))


def sink(batch: DataFrame, number: int, store: Store, stream: str, instruments: DataFrame | None = None) -> None:
    """Commits one micro-batch of OUT rows; nothing if the store has it already."""
    base = store.version()
    if store.value(f"batch {stream}", -1, base) >= number:
        return
    batch = batch.persist()
    try:
        fills = store.read("fills", FILL, base)
        own = batch.filter("kind = 'fill'").select(_FILL)
        refuse(own, instruments)
        late = batch.filter("kind = 'late'").select(_FILL).dropDuplicates(["account", "fill_id"])
        if not late.isEmpty():  # else the stored fills needn't be read
            late = late.join(fills.unionByName(own).select("account", "fill_id"), ["account", "fill_id"], "left_anti").select(_FILL)
        known = store.read("stale", "account long, symbol string", base)
        stale = known.unionByName(late.select(*KEY)).distinct()
        touched = batch.select(*KEY).distinct()
        sums = lambda kind: batch.filter(F.col("kind") == kind).select(*KEY, "trade.*")
        none = f"account long, symbol string, {SUMS}"
        waiting = store.read("positions", none, base).join(touched, KEY, "left_anti").unionByName(sums("open"))
        append, replace = {"fills": own.unionByName(late), "trades": sums("closed")}, {"positions": waiting}
        again = touched.join(stale, KEY, "left_semi")
        if not again.isEmpty():
            every = fills.unionByName(own).unionByName(late).join(again, KEY, "left_semi")
            kinds = [x.split(" ") for x in none.split(", ")]
            fresh = fifo.measured(every).select(*(F.col(c).cast(t).alias(c) for c, t in kinds))
            replace |= {"stale": stale, "rebuilt": store.read("rebuilt", none, base).join(again, KEY, "left_anti").unionByName(fresh)}
        store.commit(append, replace, base, **{f"batch {stream}": number})
    finally:
        batch.unpersist()


def ingest(store: Store, fills: DataFrame, instruments: DataFrame | None = None, append: dict[str, DataFrame] | None = None, **values) -> int:
    """Commits a batch of fills beside any stream, and its trades with it: a catch-up after a gap, or a sync.

    Fills that are stored already count for nothing.  Touched positions are rebuilt from their stored fills, and stale until a stream is
    restarted; if the stream brings the same fills later, they're repeats.  ``append`` and ``values`` are committed in the same version.
    """
    base = store.version()
    kinds = [x.split(" ") for x in FILL.split(", ")]
    stored = store.read("fills", FILL, base)
    fresh = fifo.usable(fills).select(*(F.col(c).cast(t).alias(c) for c, t in kinds)).join(stored.select("account", "fill_id"), ["account", "fill_id"], "left_anti").select(_FILL)
    refuse(fresh, instruments)
    touched = fresh.select(*KEY).distinct()
    none = f"account long, symbol string, {SUMS}"
    sums = fifo.measured(stored.unionByName(fresh).join(touched, KEY, "left_semi")).select(*(F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in none.split(", "))))
    stale = store.read("stale", "account long, symbol string", base).unionByName(touched).distinct()
    rebuilt = store.read("rebuilt", none, base).join(touched, KEY, "left_anti").unionByName(sums)
    return store.commit({"fills": fresh} | (append or {}), {"stale": stale, "rebuilt": rebuilt}, base, **values)


def refuse(fills: DataFrame, instruments: DataFrame | None) -> None:
    """An error if a fill's symbol isn't among the instruments."""
    if instruments is not None and (odd := fills.join(instruments.select("symbol"), "symbol", "left_anti").select("symbol").distinct().limit(10).collect()):
        raise ValueError(f"no instrument for {sorted(r['symbol'] for r in odd)}: a guessed point value would be wrong by a factor")


def run(spark: SparkSession, source: DataFrame, store: Store, checkpoint: str, stream: str = "fills", instruments: DataFrame | None = None, restart: bool = False):
    """Starts the stream over what is there and returns its query.

    A checkpoint goes on where it was.  With ``restart`` the new checkpoint of a new ``stream`` begins at the store's fills, and no position
    is stale any more.  State of this kind needs RocksDB's provider, which the session gets here.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    start = None
    if restart:
        base = store.version()
        fills = store.read("fills", FILL, base)
        none = f"account long, symbol string, {SUMS}"
        kinds = [x.split(" ") for x in none.split(", ")]
        sums = fifo.measured(fills).select(*(F.col(c).cast(t).alias(c) for c, t in kinds))
        whole = F.col("qty_opened") == F.col("qty_closed")
        gone = {t: spark.createDataFrame([], s) for t, s in (("stale", "account long, symbol string"), ("rebuilt", none))}
        store.commit(replace={"trades": sums.filter(whole), "positions": sums.filter(~whole), **gone}, base=base)
        start = opening(fills)
    out = trades_of(source, start).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return out.foreachBatch(lambda batch, number: sink(batch, number, store, stream, instruments)).start()


def trades(store: Store, instruments: DataFrame, version: int | None = None) -> DataFrame:
    """All trades as of a version, open ones too."""
    version = store.version() if version is None else version
    none = f"account long, symbol string, {SUMS}"
    stale = store.read("stale", "account long, symbol string", version)
    running = store.read("trades", none, version).unionByName(store.read("positions", none, version)).join(stale, KEY, "left_anti")
    return fifo.priced(running.unionByName(store.read("rebuilt", none, version)), instruments)
