"""A quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed where the rows are. The trees are fitted on the driver on at most
``fit_rows`` labelled rows and sent out as flat arrays; a batch walks through all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.document_stats import N_FEATURES, Stats
from quillspan.llm.shared import mixed_bits, remainder, small_batches, texts
from quillspan.llm.trees import Forest, boosted

FEATURES = [f"f{i}" for i in range(N_FEATURES)]


def _features(found: list[bytes]) -> np.ndarray:
    return np.asarray([Stats(x).features() for x in found], float).reshape(len(found), N_FEATURES)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, fit_rows: int, id_col: str, text_col: str) -> DataFrame:
    """``text, y`` of the documents of at most ``fit_rows`` labelled ids outside the held-out fold, chosen by a hash of the id.

    An id that is labelled more than once has its highest label; document rows that repeat in full count once.
    """
    some = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, folds) != held_out))
    some = some.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    some = some.orderBy(mixed_bits(F.col("_id"), seed=23), "_id").limit(fit_rows)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return own.join(F.broadcast(some), "_id").distinct().select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """The trees, from labelled rows outside the held-out fold; null labels are none, a repeated label row counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in texts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array(c) for c in _features(found).T)], ["y", *FEATURES])

    rows = labelled_rows(docs, labels, label, folds, held_out, fit_rows, id_col, text_col)
    seen = rows.mapInArrow(run, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    seen = seen.sort_values(["y", *FEATURES])
    return boosted(seen[FEATURES].to_numpy(float), seen["y"].to_numpy(float))


def score(docs: DataFrame, model: Forest, folds: int = 5, held_out: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Null texts count as empty and are scored like any other. Null ids belong to the fold of an empty
    text. Repeated rows are scored each for itself; other columns are no inputs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in texts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.probability(_features(found)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
