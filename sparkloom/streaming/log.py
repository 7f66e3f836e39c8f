"""An event log on disk: rows are numbered without gaps and read after a cursor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import places
from ..sources.staging import remove, scratch


@dataclass(frozen=True)
class EventLog:
    """Rows lie in ``path``/rows by batch, and for each finished batch its first and
    last number in ``path``/batches, written last. One writer at a time."""

    spark: SparkSession
    path: str
    schema: str
    order: tuple[str, ...]

    def batches(self) -> DataFrame:
        shape = "batch long, first long, last long"
        return self.spark.read.schema(shape).parquet(f"{self.path}/batches") if self._exists("batches") else self.spark.createDataFrame([], shape)

    def _exists(self, at: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Numbers ``rows`` by ``order`` from the last number on. A batch that is
        finished already is left as it is; one that broke off is written anew, under
        the same numbers, as only finished batches before it count. Fits
        ``foreachBatch``. Numbers come from a range sort and counts by partition, so no
        task holds the batch."""
        if self._exists(f"batches/batch={batch}/_SUCCESS"):
            return
        last = self.batches().where(F.col("batch") < batch).agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]
        with scratch(self.spark) as put:
            numbered = places(rows, [], list(self.order), "_place", put)
            out = numbered.select((F.col("_place") + last).alias("cursor"), *rows.columns)
            out.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        held = self.spark.read.schema(f"cursor long, {self.schema}").parquet(f"{self.path}/rows/batch={batch}")
        ends = held.agg(F.coalesce(F.min("cursor"), F.lit(last + 1)).alias("first"), F.coalesce(F.max("cursor"), F.lit(last)).alias("last"))
        ends.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")

    def after(self, cursor: int, limit: int | None = None) -> DataFrame:
        """(cursor, batch, the rows' columns) with a number above ``cursor``; with
        ``limit``, the next so many. Batches without such rows are not read, and rows
        of unfinished ones not seen. A cursor beyond the end gives no rows."""
        ends = self.batches().where((F.col("last") > cursor) & (F.col("last") >= F.col("first")))
        if limit is not None:
            ends = ends.where(F.col("first") <= cursor + limit)
        wanted = sorted(r["batch"] for r in ends.select("batch").collect())
        if not wanted:
            return self.spark.createDataFrame([], f"cursor long, batch long, {self.schema}")
        read = self.spark.read.option("basePath", f"{self.path}/rows").schema(f"cursor long, {self.schema}, batch long")
        found = read.parquet(*(f"{self.path}/rows/batch={b}" for b in wanted)).where(F.col("cursor") > cursor)
        if limit is not None:
            found = found.where(F.col("cursor") <= cursor + limit)
        return found

    def drop(self) -> None:
        remove(self.spark, self.path)
