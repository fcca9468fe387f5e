"""Tables that change together: a folder of Parquet parts and manifests, of which the last one committed counts.

A version's manifest lists each table's schema and parts, and a few values (cursors, batch numbers).  Writers put new parts beside the
old ones, then name them in the next manifest, whose file appears by one rename that fails if another writer was first.  So readers
see all tables of a version or none of its changes, whatever stops a writer between two writes; what it left behind is in no
manifest, and ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The last committed version; 0 for a new store."""
        return max((int(n[:-5]) for n in self._names("_commits") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "values": {}}
        stream = self._fs.open(self._path(f"{self.root}/_commits/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def value(self, name: str, default=None, version: int | None = None):
        return self.manifest(version)["values"].get(name, default)

    def read(self, name: str, schema: StructType | str | None = None, version: int | None = None) -> DataFrame:
        """A table as of a version; with a ``schema``, an empty one where there is none yet."""
        table = self.manifest(version)["tables"].get(name)
        if table is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        kind = StructType.fromJson(table["schema"])
        if not table["parts"]:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/data/{p}" for p in table["parts"]))

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, base: int | None = None, **values) -> int:
        """The next version: parts added to tables, tables replaced, values set.  ``base``: the version that the changes were made
        from; Conflict if it isn't the last one any more."""
        base = self.version() if base is None else base
        now = self.manifest(base)
        for name, df, old in [*((n, d, True) for n, d in (append or {}).items()), *((n, d, False) for n, d in (replace or {}).items())]:
            part = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/data/{part}")
            held = now["tables"].get(name, {"parts": []})["parts"] if old else []
            now["tables"][name] = {"schema": json.loads(df.schema.json()), "parts": [*held, part]}
        now["values"] |= values
        self._publish(base + 1, now)
        return base + 1

    def _publish(self, version: int, manifest: dict) -> None:
        """The commit itself: a file written aside and renamed to a name that must not exist."""
        aside, final = (self._path(f"{self.root}/_commits/{n}") for n in (f".{uuid.uuid4().hex}", f"{version:012d}.json"))
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise

    def compact(self, name: str) -> int:
        """A version in which a table's parts are one."""
        base = self.version()
        return self.commit(replace={name: self.read(name, version=base)}, base=base)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes parts that none of the last ``keep`` versions names; not while writers are at work.  Returns their names."""
        last = self.version()
        named = {p for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        gone = [p for p in self._names("data") if p not in named]
        for p in gone:
            self._fs.delete(self._path(f"{self.root}/data/{p}"), True)
        return gone
