"""Keys of rows: operators that join results back to rows need one that no other row has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores behind it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def keyed(df: DataFrame, key: str, name: str = "rows", of: str = "doc_id") -> DataFrame:
    """``df`` with a long ``key`` of each row: its id, or, in a table with null or repeated ids, a number that is written
    with the rows, so that it is the same whenever they are read.  ``key`` must be a name that ``df`` doesn't have."""
    irregular = df.groupBy(of).agg(F.count("*").alias("n")).filter(F.col(of).isNull() | (F.col("n") > 1))
    if dict(df.dtypes)[of] in ("tinyint", "smallint", "int", "bigint") and irregular.isEmpty():
        return df.withColumn(key, F.col(of).cast("long"))
    return cut(df.withColumn(key, F.monotonically_increasing_id()), name)
