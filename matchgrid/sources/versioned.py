"""Partitioned tables whose readers see whole commits only.

Rows are staged as Parquet below ``data``, under their keys and a version of their own;
nothing reads them until a commit names the version in ``log``, one small file that
appears at once. A commit adds a version to partitions or replaces what they had. What a
killed writer leaves behind is in no commit, so it is never read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


class VersionedTable:
    """A table of a schema (DDL), partitioned by some of its columns, in a folder that driver and executors share.

    There is one writer at a time: a commit of a number that is there is refused.
    Key columns hold no nulls.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        whole = T.StructType.fromDDL(schema)
        self.schema = T.StructType([f for f in whole if f.name not in keys])
        self.key_schema = T.StructType([whole[k] for k in keys])
        self.columns = whole.names

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _log(self) -> DataFrame:
        more = [T.StructField("version", T.StringType()), T.StructField("replaces", T.BooleanType()), T.StructField("v", T.LongType())]
        return self._read("log", T.StructType([*self.key_schema, *more]))

    def current(self) -> DataFrame:
        """(keys, version) of all commits so far, without what later ones have replaced."""
        last = F.max(F.when(F.col("replaces"), F.col("v"))).over(Window.partitionBy(*self.keys))
        live = self._log().withColumn("_from", F.coalesce(last, F.lit(0))).where("v >= _from and version is not null")
        return live.select(*self.keys, "version")

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows, of some partitions only if their keys are given; other partitions aren't opened."""
        wanted = self.current() if keys is None else self.current().join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        version = T.StructField("version", T.StringType())
        rows = self._read("data", T.StructType([*self.schema, *self.key_schema, version]))
        return rows.join(wanted, [*self.keys, "version"], "left_semi").select(*self.columns)

    def stage(self, rows: DataFrame) -> str:
        """Writes rows without showing them; returns their version."""
        version = uuid.uuid4().hex
        own = rows.select(*self.columns).withColumn("version", F.lit(version))
        own.write.mode("append").partitionBy(*self.keys, "version").parquet(f"{self.path}/data")
        return version

    def staged(self, version: str) -> DataFrame:
        rows = self._read("data", T.StructType([*self.schema, *self.key_schema, T.StructField("version", T.StringType())]))
        return rows.where(F.col("version") == version).select(*self.columns)

    def commit(self, version: str, replaces: bool = False, dropped: DataFrame | None = None) -> int:
        """Shows a staged version, instead of what its partitions had if replaces is set, and empties dropped partitions."""
        number = (self._log().agg(F.max("v")).first()[0] or 0) + 1
        rows = self.staged(version).select(*self.keys).distinct().withColumns({"version": F.lit(version), "replaces": F.lit(replaces)})
        if dropped is not None:
            gone = dropped.select(*self.keys).distinct().withColumns({"version": F.lit(None).cast("string"), "replaces": F.lit(True)})
            rows = rows.unionByName(gone.join(rows, self.keys, "left_anti"))
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/log/v={number}")
        return number
