"""Where operators cut lineage: Parquet tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset, a session in one process gets a temporary folder, which is
    then set; on a cluster that is an error, as each executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextlib.contextmanager
def freed(spark: SparkSession, keep: Callable[[], list[str]]) -> Iterator[None]:
    """Removes the scratch tables made inside it, but for those that ``keep`` names at its end, when nothing reads them any more."""
    _made.append([])
    try:
        yield
    finally:
        for path in set(_made.pop()) - set(keep()):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it: later reads survive lost executors.

    The tables are scratch and stay until the folder is cleared, since lazy results still read them.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
