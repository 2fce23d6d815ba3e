"""A corpus pipeline: toxic texts, near copies and benchmark leaks go, personal data is masked, the rest is packed.

Each stage takes all documents that the one before it kept; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, packing, pii, simhash, toxicity
from quillspan.llm.queries import tokenizer_path
from quillspan.llm.shared import broadcast_if_small, drop_written, table, written, written_so_far


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"{name}_{i}") not in taken) for name in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; a null text counts as empty and is kept if that scores low."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, F.col("text")) < 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, on shingles of five words at a similarity of 0.8.

    Fingerprints within three bits of 64 and shared samples propose links; those at that exact similarity
    or more hold, and a group is all that links reach. The first is that of the smallest id, rows without an
    id last. Documents without words are no copies of anything and are kept. Rows are told apart by id and
    text: of rows that repeat both, the one of the smallest other columns stays, as JSON; rows of one id and
    different texts are different documents.
    """
    empty = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit("")) == ""
    text = docs.where(~empty)
    found = simhash.similar_documents(text, words=5, similarity=0.8)
    k, t = _free(docs, "key_id", "key_text")
    rows = written(found.groupBy(F.col("doc_id").alias(k), F.col("text_key").alias(t)).agg(F.first("first").alias("kept"), F.count(F.lit(1)).alias("times")), "copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(k)) & (F.xxhash64("text") == F.col(t))
    single = text.join(broadcast_if_small(rows.where("not kept or times > 1").select(k, t)), same, "left_anti")
    repeated = text.join(broadcast_if_small(rows.where("kept and times > 1").select(k, t)), same, "left_semi")
    others = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0)))
    once = repeated.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*docs.columns), others).alias("row")).select("row.*")
    return single.unionByName(once).unionByName(docs.where(empty))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item; ids play no part, so rows without one or with the same one are each judged by their text."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = decontaminate.contained_items(texts, table(spark, sf_dir, "benchmark"), threshold=0.8, words=5)
    (leak,) = _free(docs, "leak")
    found = written(leaks.select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(broadcast_if_small(found), F.xxhash64("text") == F.col(leak), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` is that of the new text, null texts stay null."""
    model = pii.fit(docs)
    masked = pii.masked(docs, model)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids; see ``packing.pack``."""
    return packing.pack(docs, tokenizer_path(), capacity=4096, end_id=2)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("personal_data", mask_personal_data), ("packing", pack)]

#: Language models, fingerprints and the tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; when a stage's result is written, what was written before it goes."""
    docs, mark = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(spark, mark, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
