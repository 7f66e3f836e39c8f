"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ship import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    the session names none, a local master gets a temporary one; a cluster's
    executors would each write to their own disk, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Spark deletes a query's shuffle files at its end, and not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as ``stage`` returns it, and the folder to ``remove`` in the end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.select("*").write.parquet(path)  # the setting holds for frames made under it
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage: later jobs neither repeat the work nor need the shuffle
    files of executors that may be gone by then.
    """
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stage`` wrote, in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """A ``stage`` whose tables are deleted at the end of the block. What is
    needed behind it has to be staged by itself within."""
    paths = []

    def put(df: DataFrame, name: str) -> DataFrame:
        back, path = written(df, name)
        paths.append(path)
        return back

    try:
        yield put
    finally:
        for path in paths:
            remove(spark, path)


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(df[column].cast("string"), F.lit(""))
