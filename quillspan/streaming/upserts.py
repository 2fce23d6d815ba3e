"""Streams into keyed state: each micro-batch is folded and merged, and a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.operators.events import as_events, replaced, replay
from quillspan.operators.state import apply_failed, apply_fetched, save_parsed
from quillspan.sources.keyed import KeyedTable
from quillspan.sources.scratch import drop_written, written_so_far
from quillspan.sources.store import _fs


class Snapshots:
    """Numbered snapshots of a table in a folder; the one of batch ``n`` is made from the last before it."""

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame):
        self.spark, self.path, self.empty = spark, path, empty

    def _done(self) -> list[int]:
        fs, Path = _fs(self.spark, self.path)
        if not fs.exists(Path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(Path(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        found = [n for n in self._done() if before is None or n < before]
        return self.spark.read.schema(self.empty.schema).parquet(f"{self.path}/v{found[-1]}") if found else self.empty

    def write(self, batch: int, df: DataFrame, keep: int = 3) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        fs, Path = _fs(self.spark, self.path)
        for n in self._done()[:-keep]:
            fs.delete(Path(f"{self.path}/v{n}"), True)


def stream_merge(stream: DataFrame, snapshots: Snapshots, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, good: str = "true", rejects: str | None = None) -> StreamingQuery:
    """Merges each micro-batch into the snapshot; rows for which ``good`` is not true go to ``rejects``.

    A batch that is delivered again after a failure starts from the snapshot before it, so its result is
    the same.
    """

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        fine = F.coalesce(F.expr(good), F.lit(False))
        if rejects:
            df.where(~fine).write.mode("overwrite").parquet(f"{rejects}/batch={n}")
        snapshots.write(n, merge(snapshots.read(before=n), df.where(fine)))
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_updates(pages: DataFrame, updates: DataFrame) -> DataFrame:
    """Merges ``kind, page_key, html, at, error, seq``: what was fetched and what failed, in the order of ``seq``.

    The last update of a key decides its state; all failures of the batch count. A saved page that was only
    fetched again stays saved.
    """
    last = updates.groupBy("page_key").agg(F.max_by("kind", "seq").alias("_last"))
    got = updates.where("kind = 'fetched'").withColumnRenamed("at", "fetched_at").select("page_key", "html", "fetched_at", "seq")
    lost = updates.where("kind = 'failed'").select("page_key", "error", "seq")
    after_failed = apply_failed(pages, lost, ["seq"])
    # A page whose last update is a fetch is fetched again, as if its failures had come before.
    merged = apply_fetched(after_failed.where("page_key is not null"), got, ["seq"]).join(last, "page_key", "left")
    failed_last = F.col("_last") == "failed"
    errors = lost.groupBy("page_key").agg(F.max_by("error", "seq").alias("_e"))
    merged = merged.join(errors, "page_key", "left")
    return merged.withColumns({"status": F.when(failed_last, "fetch_failed").otherwise(F.col("status")), "error": F.when(failed_last, F.col("_e")).otherwise(F.col("error"))}).select(*pages.columns)


def stream_parsed(
    pages_stream: DataFrame, snapshots: dict[str, Snapshots], parse: Callable[[DataFrame], tuple[dict[str, DataFrame], DataFrame]], checkpoint: str, errors: str | None = None
) -> StreamingQuery:
    """Parses pages as they come and saves each micro-batch's child tables into the snapshots.

    Every batch starts from the snapshots before it, so batches add up and one that is delivered again gives
    the same. ``parse`` returns the child tables and the pages that could not be parsed; these go to ``errors``.
    """

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        tables, bad = parse(df)
        store = {name: s.read(before=n) for name, s in snapshots.items()}
        for name, table in save_parsed(store, tables).items():
            snapshots[name].write(n, table)
        if errors:
            bad.write.mode("overwrite").parquet(f"{errors}/batch={n}")
        df.unpersist()

    return pages_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_events(
    stream: DataFrame, tables: dict[str, KeyedTable], parse: Callable[[DataFrame], tuple[dict[str, DataFrame], DataFrame]], checkpoint: str,
    rejects: str | None = None, every: str | None = None, first: int = 0,
) -> StreamingQuery:
    """Fetches and failures as they come, in the form of ``events.EVENTS``, parsed and saved batch by batch.

    A batch's last fetch of a page that isn't saved is parsed, with the page's attributes; one that is saved is
    never parsed again. Parses and parse errors become events right behind their fetch, and all events are
    replayed in order: a page that can't be parsed is ``parse_failed`` with its message and one more retry.
    Only partitions with a page of the batch are rewritten. Children go first and pages last, each under
    the batch's number, so a batch that is delivered again finds what it found before. Rows without a key or
    of another kind go to ``rejects``. With ``every``, a batch begins each such interval; else what is there is
    taken once. The source's own options bound a batch. Batches are numbered from ``first`` on, which must be over
    the number of the tables' last merge when the stream is new.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark, mark = df.sparkSession, written_so_far()
        df = df.persist()
        fine = F.coalesce(F.col("kind").isin("fetched", "failed") & F.col("page_key").isNotNull(), F.lit(False))
        if rejects:
            df.where(~fine).write.mode("overwrite").parquet(f"{rejects}/batch={n}")
        came = df.where(fine)
        last = came.where("kind = 'fetched'").groupBy("page_key").agg(F.max_by(F.struct("html", "fetched_at", "seq"), F.struct("seq", "step")).alias("f"))
        todo = tables["pages"].read().where("status is null or status <> 'saved'").join(last, "page_key")
        todo = todo.withColumns({"html": F.col("f.html"), "fetched_at": F.col("f.fetched_at"), "event_seq": F.col("f.seq")}).drop("f")
        found, bad = parse(todo.drop("event_seq"))
        at = todo.select("page_key", F.col("event_seq").alias("seq")).persist()
        events = came.unionByName(as_events(found["pages"].join(at, "page_key"), "parsed", 1))
        events = events.unionByName(as_events(bad.join(at, "page_key").withColumn("status", F.lit("parse_failed")), "failed", 1))
        for name in ("targets", "units", "progress", "findings"):
            if name in found:
                new = found[name].join(at.withColumnRenamed("seq", "event_seq"), "page_key").withColumn("event_step", F.lit(1))
                tables[name].merge(first + n, found["pages"].select("page_key"), lambda old, new=new: replaced(old, new, events))
        tables["pages"].merge(first + n, came.select("page_key"), lambda old: replay(old, events))
        for x in (df, at):
            x.unpersist()
        drop_written(spark, mark)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
