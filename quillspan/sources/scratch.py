"""The folder that all executors see, for tables between jobs."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode; a cluster must set it."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    _own = _own or tempfile.mkdtemp(prefix="quillspan-")
    return _own


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/quillspan-{label}-{uuid.uuid4().hex}"


def new_place(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is put there goes with ``drop_written``."""
    _written.append(scratch(spark, label))
    return _written[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: a cut in the lineage that survives lost executors."""
    path = new_place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """A mark for ``drop_written``."""
    return len(_written)


def release_shuffles(spark: SparkSession) -> None:
    """Has the files of shuffles that no plan needs any more deleted: Spark does so once the driver has collected the plan, which may be half an hour later."""
    for _ in range(2):  # the end of the last job may still be on its way to listeners, which hold its plan
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def drop_written(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables that this driver has written since a mark, but those that ``keep`` reads; call it when the results made from them are saved."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    bare = lambda p: Path.getPathWithoutSchemeAndAuthority(p).toString()
    held = {bare(Path(f).getParent()) for df in keep for f in df.inputFiles()}
    for place in _written[since:]:
        path = Path(place)
        if bare(path) not in held:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _written.remove(place)
