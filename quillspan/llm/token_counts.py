"""Token counts of texts in flat, unindexed token files, by a separator scan.

A flat file is the ids of many texts end to end, each followed by an end-of-document id, with no index.
A file is read in fixed byte ranges, each opened at its place by the task that takes it, so one large file is
read by many tasks; in each range numpy finds all separators at once. A text may begin in one
block and end in a later one, so the blocks' token counts and last separators are summed up by a prefix
scan (running sum and running maximum), which gives every block the place of the separator before it.
The scan runs inside groups of blocks first and then over the groups, so a file of any length is not
gathered in one task.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.shared import new_place, small_batches, texts, written
from quillspan.llm.tokens import word_ids

#: Blocks that are summed up within one group of the scan.
GROUP = 1024


def _local(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "/")) else os.path.abspath(path))


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts as flat files of raw numbers, one for each task, and returns the list ``file, bytes, ordinal, doc_id``.

    Null and empty texts are a separator alone. Special tokens' strings in a text are ordinary text, so the
    end id never occurs inside one. A task that runs again writes a file of a new name; only files on the list count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(tokenizer, dtype, False).ids, np.asarray([end_id], dtype).tobytes()
        store, base = _local(folder)
        store.create_dir(base, recursive=True)
        name, seen, size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin", 0, 0
        kinds = {"file": pa.string(), "bytes": pa.int64(), "ordinal": pa.int64(), "doc_id": pa.int64()}
        with store.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                for part, found in texts(batch, "text"):
                    flow = b"".join(x for text in found for x in (encode(text), end))
                    out.write(flow)
                    n, size = part.num_rows, size + len(flow)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.nulls(n, pa.int64()), pa.array(range(seen, seen + n), pa.int64()), part.column("doc_id")], list(kinds))
                    seen += n
        yield pa.RecordBatch.from_pylist([{"file": name, "bytes": size}], pa.schema(list(kinds.items())))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(small_batches(own).mapInArrow(run, "file string, bytes long, ordinal long, doc_id long"), "flat-list")


def read_ranges(files: DataFrame, folder: str = "", dtype: str = "<u2", block: int = 1 << 21) -> DataFrame:
    """Blocks ``file, block, payload`` of ``file, bytes``, in ranges of ``block`` ids of any store that Arrow opens.

    ``folder`` stands before a file's name. Each range is a row of its own that is dealt out and read by
    itself, so no task holds more than a range, however large a file is. Empty files give no rows.
    """
    width = block * np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                store, path = _local(f"{folder}/{name}" if folder else name)
                with store.open_input_file(path) as f:
                    payload = f.read_at(width, n * width)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["file", "block", "payload"])

    ranges = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {width}"))).alias("block"))
    tasks = 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "file", "block").mapInArrow(run, "file string, block long, payload binary")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes`` of the files under a path, in any store that Spark lists; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def separator_scan(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """``file, ordinal, start, n_tokens, ended``: each text's place and tokens, without its separator.

    ``blocks`` has ``file, block, payload``; a file's blocks may have any lengths and are in the order of
    ``block``. Tokens after a file's last separator are a text with ``ended`` false. Null or empty payloads
    hold nothing. No blocks give no rows.
    """
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for x in batch.column("payload").to_pylist():
                ids = np.frombuffer(x or b"", dtype)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                ["file", "block", "size", "ends"],
            )

    found = blocks.select("file", F.col("block").cast("long"), "payload").mapInArrow(run, f"file {kind}, block long, size long, ends array<long>")
    found = written(found.withColumn("grp", F.floor(F.col("block") / GROUP)), "ends")
    own = Window.partitionBy("file", "grp").orderBy("block")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    inner = found.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("nth", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    inner = inner.withColumn("last", F.max(F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))).over(before))
    # the same over whole groups
    groups = inner.groupBy("file", "grp").agg(
        F.sum("size").alias("size"), F.sum(F.size("ends")).alias("n"), F.max(F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))).alias("end")
    )
    wide = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("g_at", F.coalesce(F.sum("size").over(wide), F.lit(0))).withColumn("g_nth", F.coalesce(F.sum("n").over(wide), F.lit(0)))
    groups = groups.withColumn("g_last", F.max(F.col("g_at") + F.col("end")).over(wide))
    placed = inner.join(groups.select("file", "grp", "g_at", "g_nth", "g_last"), ["file", "grp"])
    prior = F.coalesce(F.col("g_at") + F.col("last"), F.col("g_last"), F.lit(-1))
    ended = (
        placed.select("file", (F.col("g_nth") + F.col("nth")).alias("nth"), prior.alias("prior"), F.transform("ends", lambda e: e + F.col("g_at") + F.col("at")).alias("ends"))
        .select("file", "nth", "prior", "ends", F.posexplode("ends").alias("i", "end"))
        .withColumn("begin", F.when(F.col("i") == 0, F.col("prior")).otherwise(F.element_at("ends", F.col("i"))) + 1)
        .select("file", (F.col("nth") + F.col("i")).alias("ordinal"), F.col("begin").alias("start"), (F.col("end") - F.col("begin")).alias("n_tokens"), F.lit(True).alias("ended"))
    )
    rest = groups.groupBy("file").agg(F.sum("size").alias("all"), F.sum("n").alias("ordinal"), F.max(F.col("g_at") + F.col("end")).alias("end"))
    rest = rest.withColumn("start", F.coalesce("end", F.lit(-1)) + 1).where("all > start")
    return ended.unionByName(rest.select("file", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u2", block: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, file, ordinal, start, n_tokens``, a row for each row of ``docs``: its tokens as the scan of the flat files counts them.

    Repeated rows and null ids are counted each for itself; other columns are ignored.
    """
    folder = new_place(docs.sparkSession, "flat")
    found = write_flat_files(docs, folder, tokenizer, end_id, dtype, id_col, text_col)
    counts = separator_scan(read_ranges(found.where("bytes is not null").select("file", "bytes"), folder, dtype, block), end_id, dtype)
    return found.where("ordinal is not null").join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
