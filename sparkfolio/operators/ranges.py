"""Extremes over time ranges from a hierarchy of blocks: a range costs a row for each of a logarithmic number of blocks.

Time is cut into slots of a bar's length.  A block of level k is RADIX**k slots; its low, high and count are stored once.  A
range of slots is the union of few blocks, the coarsest inside and finer ones towards both ends, so ranges and blocks meet in an equi-join
on (symbol, level, block), whatever the ranges' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIX = 4
#: 4**11 slots, four million, are one block of the top level; longer ranges take more of these.
LEVELS = 11
BLOCK = ["symbol", "level", "block"]


def slot(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)


def _up(at: str, level: str) -> str:
    """The block of a level that holds a slot."""
    return f"cast(floor({at} / pow({RADIX}, {level})) as bigint)"


def pyramid(bars: DataFrame, seconds: int, levels: int = LEVELS) -> DataFrame:
    """(symbol, level, block, low, high, n_bars, first, last) of all blocks that hold bars; first and last are the bars' seconds."""
    own = bars.select("symbol", slot(F.col("ts"), seconds).alias("slot"), "low", "high", F.unix_timestamp("ts").alias("at"))
    each = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return each.groupBy("symbol", "level", F.expr(_up("slot", "level")).alias("block")).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n_bars"), F.min("at").alias("first"), F.max("at").alias("last")
    )


def cover(rows: DataFrame, first: Column, last: Column, levels: int = LEVELS) -> DataFrame:
    """``rows`` once for each block (level, block) of the few whose union is the slots from ``first`` to ``last``, both included."""
    a, b = (lambda k: f"cast(ceil(_a / pow({RADIX}, {k})) as bigint)"), (lambda k: _up("_b", k))
    span = lambda x, y: f"if({x} < {y}, sequence({x}, {y} - 1), cast(array() as array<bigint>))"
    inner = f"k < {levels} and {a('k + 1')} < {b('k + 1')}"
    blocks = f"if({inner}, concat({span(a('k'), f'{a("k + 1")} * {RADIX}')}, {span(f'{b("k + 1")} * {RADIX}', b('k'))}), {span(a('k'), b('k'))})"
    taken = f"flatten(transform(sequence(0, {levels}), k -> transform({blocks}, x -> named_struct('level', k, 'block', x))))"
    out = rows.withColumn("_a", first).withColumn("_b", last + 1).withColumn("_c", F.explode(F.expr(taken)))
    return out.withColumns({"level": F.col("_c.level"), "block": F.col("_c.block")}).drop("_a", "_b", "_c")


def over_bars(trades: DataFrame, bars: DataFrame, seconds: int, *keep: str) -> DataFrame:
    """(trade_id, keep.., low, high, n_bars, first, last) over the bars from the one that holds the entry to the one at the exit.

    Bars start at multiples of ``seconds``.  Trades without such bars are left out.
    """
    asked = cover(trades.select("trade_id", "symbol", "opened_at", "closed_at", *keep), slot(F.col("opened_at"), seconds), slot(F.col("closed_at"), seconds))
    met = asked.join(pyramid(bars, seconds), BLOCK)
    return met.groupBy("trade_id", *keep).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_bars").alias("n_bars"), F.min("first").alias("first"), F.max("last").alias("last")
    )


def bars_in_blocks(asked: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """Rows of ``asked`` (symbol, level, block, ..) with each bar of their blocks (``_ts``, low, high), by slots."""
    size = f"cast(pow({RADIX}, level) as bigint)"
    slots = asked.withColumn("_slot", F.explode(F.expr(f"sequence(block * {size}, (block + 1) * {size} - 1)"))).drop("level", "block")
    b = bars.select(F.col("symbol").alias("_symbol"), slot(F.col("ts"), seconds).alias("_at"), F.unix_timestamp("ts").alias("_ts"), "low", "high")
    return slots.join(b, (F.col("symbol") == F.col("_symbol")) & (F.col("_slot") == F.col("_at"))).drop("_symbol", "_at", "_slot")
