"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

#: Documents of a source that are ordered in one task at most, about.
BUCKET = 10_000


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def position_weights(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """Adds ``weight``: the given ones in turn, over the sources by code point, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1).cast("double"))


def water_fill(sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """Adds ``target`` to (source_size, weight): shares of ``total`` by weight, at most ``epochs`` times a source's size.

    Sources that would get more are clamped and the rest is shared anew until none is above; each round is an
    aggregation of which two sums reach the driver.  Sources of no size get 0; if all are clamped, less than ``total``
    is given out.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    level = 0.0
    while True:
        free, given = sources.agg(F.sum(F.when(cap > F.col("weight") * level, F.col("weight"))), F.sum(F.when(~(cap > F.col("weight") * level), cap))).first()
        if not free:
            level = math.inf
            break
        above = (total - (given or 0.0)) / free
        if above <= level:
            break
        level = above
    return sources.withColumn("target", cap if level == math.inf else F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = (3, 1, 2), seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of every row: ``times`` whole repetitions of the document.

    ``share`` of all words is dealt to the sources by weight, each capped at ``epochs`` times its size.  A source
    repeats all its documents floor(target / size) times and, of a seeded order, as many once more as come nearest
    to what is left; long sources are ordered in buckets of about BUCKET documents, each near its own share.
    Null and empty texts have size 0 and take no words; a null source is a source of its own; repeated rows and
    rows without a doc_id are documents of their own.  An empty table gives an empty result.
    The columns ``keep`` are carried along.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), *keep), "sized")
    sources = cut(position_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(sources, share * total, epochs).select(
        "*", F.expr("coalesce(try_divide(target, source_size), 0D)").alias("rate"), F.ceil(F.col("n") / BUCKET).alias("buckets")
    )
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    each = sized.join(filled, sized.source.eqNullSafe(filled.source)).drop(filled.source).withColumn("key", key)
    each = each.withColumn("bucket", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("buckets")))
    order = W.partitionBy("source", "bucket").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    part = each.withColumn("upto", F.sum("size").over(order)).withColumn("all", F.sum("size").over(W.partitionBy("source", "bucket")))
    more = (F.col("size") > 0) & (F.col("upto") - F.col("size") / 2 <= (F.col("rate") - F.floor("rate")) * F.col("all"))
    times = F.floor("rate").cast("long") + more.cast("long")
    return part.withColumn("times", times).select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), *keep)
