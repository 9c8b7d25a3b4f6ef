"""Tables that a plan writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none a temporary one is set; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs that begin here leave no shuffle files behind; for plans that run once."""
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again: computed once, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a written table that no plan reads any more."""
    for folder in {uri.rsplit("/", 1)[0] for uri in table.inputFiles()}:
        fs, path = FileSystem.from_uri(folder)
        fs.delete_dir(path)
