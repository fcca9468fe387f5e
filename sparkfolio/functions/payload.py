"""Payload trees: nested columns as rows of dotted paths, and back, by their schema.

A struct's fields add ``.name`` to a path, an array's elements ``[i]``, a map's entries ``.key``.  Both ways are expressions over the row
that holds the tree, made by a walk over its schema: no text is parsed, and no row leaves its task on the way to paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = "array<struct<path:string,value:string>>"


def entries(column: Column, kind: T.DataType, prefix: Column) -> Column:
    """All leaves of a column as an array of (path, value), values as text.  Null arrays and maps have no leaves, null leaves a NULL value."""
    if isinstance(kind, T.StructType):
        each = [entries(column.getField(f.name), f.dataType, F.concat(prefix, F.lit("." + f.name))) for f in kind.fields]
        return F.concat(*each) if each else F.array().cast(_NONE)
    if isinstance(kind, T.ArrayType):
        one = lambda x, i: entries(x, kind.elementType, F.concat(prefix, F.lit("["), i.cast("string"), F.lit("]")))
        return F.coalesce(F.flatten(F.transform(column, one)), F.array().cast(_NONE))
    if isinstance(kind, T.MapType):
        one = lambda e: entries(e["value"], kind.valueType, F.concat(prefix, F.lit("."), e["key"].cast("string")))
        return F.coalesce(F.flatten(F.transform(F.map_entries(column), one)), F.array().cast(_NONE))
    return F.array(F.struct(prefix.alias("path"), column.cast("string").alias("value"))).cast(_NONE)


def dotted(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep.., path, value): a row a leaf of ``column``, paths without the column's own name."""
    leaves = entries(F.col(column), df.schema[column].dataType, F.lit(""))
    each = df.select(*keep, F.explode(leaves).alias("e"))
    return each.select(*keep, F.regexp_replace("e.path", r"^\.", "").alias("path"), F.col("e.value").alias("value"))


def _built(kind: T.DataType, prefix: Column, leaves: Column) -> Column:
    """The tree of ``kind`` under ``prefix`` from the map of paths to values."""
    if isinstance(kind, T.StructType):
        return F.struct(*(_built(f.dataType, F.concat(prefix, F.lit("." + f.name)), leaves).alias(f.name) for f in kind.fields))
    # what stands behind the prefix, up to the next mark, of each leaf below it
    if isinstance(kind, T.ArrayType):
        below = F.filter(F.map_keys(leaves), lambda k: F.startswith(k, F.concat(prefix, F.lit("["))))
        index = F.transform(below, lambda k: F.regexp_extract(F.substring(k, F.length(prefix) + 1, F.length(k)), r"^\[(\d+)\]", 1).cast("int"))
        n = F.coalesce(F.array_max(index) + 1, F.lit(0))
        spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: _built(kind.elementType, F.concat(prefix, F.lit("["), i.cast("string"), F.lit("]")), leaves))
    if isinstance(kind, T.MapType):
        below = F.filter(F.map_keys(leaves), lambda k: F.startswith(k, F.concat(prefix, F.lit("."))))
        keys = F.array_sort(F.array_distinct(F.transform(below, lambda k: F.regexp_extract(F.substring(k, F.length(prefix) + 2, F.length(k)), r"^([^.\[]+)", 1))))
        return F.map_from_arrays(keys.cast(T.ArrayType(kind.keyType)), F.transform(keys, lambda k: _built(kind.valueType, F.concat(prefix, F.lit("."), k), leaves)))
    return F.try_element_at(leaves, prefix).cast(kind)


def rebuilt(rows: DataFrame, kind: T.DataType, name: str, *by: str) -> DataFrame:
    """(by.., name): the trees of dotted() again, one for each ``by``.

    Missing leaves are NULL; null and empty arrays and maps both come back empty.  Map keys must hold neither dots nor brackets.
    """
    path = F.when(F.startswith("path", F.lit("[")), F.col("path")).otherwise(F.concat(F.lit("."), "path"))
    leaves = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(path.alias("k"), F.col("value").alias("v")))).alias("_leaves"))
    return leaves.select(*by, _built(kind, F.lit(""), F.col("_leaves")).alias(name))
