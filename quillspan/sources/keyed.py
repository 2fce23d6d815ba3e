"""Tables kept by key in hashed partitions, of which a merge rewrites those only that its keys fall into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quillspan.sources.store import _fs


class KeyedTable:
    """A Parquet table in ``buckets`` partitions by a hash of ``key``.

    ``merge`` makes the new rows of the touched partitions beside the table and then puts them in by Spark's dynamic
    partition overwrite; all other partitions' files stay as they are. Merges are numbered. One that was broken
    off after its rows were complete is put in anew before anything is read, and one whose number is done changes
    nothing, so a micro-batch may be delivered again. The number of buckets is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "page_key", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _names(self, path: str) -> list[str]:
        fs, Path = _fs(self.spark, path)
        return [s.getPath().getName() for s in fs.listStatus(Path(path))] if fs.exists(Path(path)) else []

    def done(self) -> int:
        """The number of the last merge, -1 if there was none."""
        return max((int(n[5:]) for n in self._names(f"{self.path}/_merges") if n.startswith("done-")), default=-1)

    def _recover(self) -> None:
        for n in sorted(int(n[6:]) for n in self._names(f"{self.path}/_merges") if n.startswith("stage-")):
            if n <= self.done() or not self._put(n):
                self._forget(f"stage-{n}")

    def read(self, among: list[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        self._recover()
        there = [n for n in self._names(f"{self.path}/rows") if n.startswith("bucket=")]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(f"{self.path}/rows")
        return (df if among is None else df.where(F.col("bucket").isin(among))).drop("bucket")

    def merge(self, number: int, keys: DataFrame, new: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the partitions of ``keys`` by ``new`` of their rows."""
        self._recover()
        if number <= self.done():
            return
        touched = sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # at most as many as buckets
        stage = f"{self.path}/_merges/stage-{number}"
        rows = new(self.read(touched)).select(*self.schema.names).withColumn("bucket", self.bucket())
        self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{stage}/touched")
        # A partition is dealt out by key, so a large one is several files.
        rows.repartition("bucket", self.key).write.mode("overwrite").parquet(f"{stage}/rows")
        self._put(number)

    def _put(self, number: int) -> bool:
        """Puts a complete stage in; the same as often as it is done."""
        stage = f"{self.path}/_merges/stage-{number}"
        fs, Path = _fs(self.spark, self.path)
        if not all(fs.exists(Path(f"{stage}/{part}/_SUCCESS")) for part in ("touched", "rows")):
            return False
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(f"{stage}/rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        full = {r[0] for r in rows.select("bucket").distinct().collect()}
        for r in self.spark.read.parquet(f"{stage}/touched").collect():
            if r[0] not in full:
                fs.delete(Path(f"{self.path}/rows/bucket={r[0]}"), True)
        fs.mkdirs(Path(f"{self.path}/_merges/done-{number}"))
        self._forget(f"stage-{number}")
        for n in self._names(f"{self.path}/_merges"):
            if n.startswith("done-") and int(n[5:]) < number:
                self._forget(n)
        return True

    def _forget(self, name: str) -> None:
        fs, Path = _fs(self.spark, self.path)
        fs.delete(Path(f"{self.path}/_merges/{name}"), True)
