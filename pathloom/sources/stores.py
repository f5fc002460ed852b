"""Tables that are upserted: an append log of versions, read with the last row of each key.

A store is a folder; every upsert, removal or compaction is one subfolder ``version=<n>``, written whole and told from a broken
one by Spark's _SUCCESS file.  A caller that tries again under the same version replaces what it wrote before, so a retry
changes nothing.  Compaction writes the state as a snapshot; reading starts from the last snapshot and needs no lock, since what
a snapshot replaces is deleted only after it is complete, and by a call of its own.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


class Store:
    """Rows of ``schema`` (DDL) by the columns ``keys``; null is a key like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _place(self, version: int, kind: str) -> str:
        return f"{self.path}/version={version:020d}-{kind}"

    def versions(self) -> list[tuple[int, str]]:
        """(version, kind) of all that is complete, a log before a snapshot of the same version."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        out = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("version=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                number, kind = name.removeprefix("version=").split("-")
                out.append((int(number), kind))
        return sorted(out, key=lambda x: (x[0], x[1] == "snapshot"))

    def next_version(self) -> int:
        return max((v for v, _ in self.versions()), default=0) + 1

    def _write(self, rows: DataFrame, version: int, kind: str) -> int:
        rows.write.mode("overwrite").parquet(self._place(version, kind))
        return version

    def upsert(self, rows: DataFrame, order: str | None = None, version: int | None = None) -> int:
        """Puts rows in; of several with one key the last by ``order`` counts, without it the greatest by its other columns."""
        version = version or self.next_version()
        rest = F.struct(*([F.col(order).alias("__order")] if order else []), *[F.col(c) for c in self.columns if c not in self.keys])
        last = rows.groupBy(*self.keys).agg(F.max(rest).alias("__last"))
        kept = last.select(*[F.col(c) if c in self.keys else F.col(f"__last.{c}").alias(c) for c in self.columns])
        return self._write(kept.withColumn("__gone", F.lit(False)), version, "log")

    def remove(self, keys: DataFrame, version: int | None = None) -> int:
        """Takes out the rows of these keys."""
        gone = keys.select(*self.keys).distinct()
        for field in self.schema:
            if field.name not in self.keys:
                gone = gone.withColumn(field.name, F.lit(None).cast(field.dataType))
        return self._write(gone.select(*self.columns, F.lit(True).alias("__gone")), version or self.next_version(), "log")

    def clear(self, condition: str, version: int | None = None) -> int:
        """Takes out the rows that meet a condition."""
        return self.remove(self.read().where(condition), version)

    def _rows(self) -> DataFrame:
        """All rows since the last snapshot, with their version."""
        known = self.versions()
        begin = max((i for i, (_, kind) in enumerate(known) if kind == "snapshot"), default=0)
        whole = StructType([*self.schema.fields, StructField("__gone", BooleanType())])
        parts = [self.spark.read.schema(whole).parquet(self._place(*v)).withColumn("__version", F.lit(v[0])) for v in known[begin:]]
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumns({"__gone": F.lit(False), "__version": F.lit(0)})
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self) -> DataFrame:
        """The last row of each key."""
        rest = F.struct(*[F.col(c) for c in self.columns if c not in self.keys], F.col("__gone"))
        last = self._rows().groupBy(*self.keys).agg(F.max_by(rest, F.col("__version")).alias("__last"))
        return last.where("not __last.__gone").select(*[F.col(c) if c in self.keys else F.col(f"__last.{c}").alias(c) for c in self.columns])

    def compact(self) -> int:
        """Writes the state as a snapshot of the last version."""
        version = self.next_version() - 1
        return self._write(self.read().withColumn("__gone", F.lit(False)), version, "snapshot") if version else 0

    def drop_history(self) -> None:
        """Deletes what the last snapshot replaces, and broken leftovers of the versions up to it."""
        fs, path = self._fs()
        last = max((v for v, kind in self.versions() if kind == "snapshot"), default=0)
        for status in fs.listStatus(path) if last else ():
            number, kind = status.getPath().getName().removeprefix("version=").split("-")
            if int(number) < last or int(number) == last and kind == "log":
                fs.delete(status.getPath(), True)
