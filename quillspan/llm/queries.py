"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, fill_in_middle, lexical_search, ngram_join, pii, quality_model, quality_rules, secrets, toxicity
from quillspan.llm.packing import pack
from quillspan.llm.sharding import interleave
from quillspan.llm.shared import table
from quillspan.llm.simhash import near_duplicates
from quillspan.llm.token_counts import document_token_counts


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file; asked for only when a query needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit(docs))
    counts = [F.size(F.filter("base", pii.is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), "quality", folds=5, held_out=0)
    return quality_model.score(docs, model, folds=5, held_out=0, threshold=0.3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", folds=4, held_out=2)
    return toxicity.score(docs, model, folds=4, held_out=2, threshold=0.3)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=49407)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8, words=5)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    language = secrets.language(docs)
    return secrets.scan(docs, language, secrets.fit(secrets.labelled_findings(docs, language)))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents"), words=5, num=4, den=5)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_secret_scan": op10_secret_scan,
    "op11_ngram_join": op11_ngram_join,
    "op12_lexical_search": op12_lexical_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op11_ngram_join": ngram_join.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
