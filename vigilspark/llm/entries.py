"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import CONTAMINATED, contamination
from .html_text import extracted
from .language_model import scored as model_scored
from .licenses import scanned
from .minhash import near_duplicates
from .packing import packed
from .repeats import repeated_bytes
from .toxicity import fitted, fold, scored

from .vectors import near_vectors
from .warc import derivatives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_labels(labels: DataFrame) -> DataFrame:
    """id and label of the rows that toxicity is learned from."""
    return labels.where(fold("doc_id", 5) != 0).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("label"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = scored(docs, fitted(docs, training_labels(_table(spark, sf_dir, "labels"))))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_table(spark, sf_dir, "pages"), carry=["url"])


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # documents has no paths: a tree of three levels by source, language and id, in which every fourth file is named as a licence file
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    depth = F.when(mark % 3 == 0, F.array("source")).when(mark % 3 == 1, F.array("source", "lang")).otherwise(F.array("source", "lang", F.floor(F.col("doc_id") / 100).cast("string")))
    name = F.concat(F.when(mark.bitwiseAND(4096 + 8192) == 0, "LICENSE-").otherwise("file-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.withColumn("path", F.concat(F.array_join(depth, "/"), F.lit("/"), name))
    return scanned(files, carry=["doc_id"]).withColumn("cosine", F.round("cosine", 6))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, which every machine has installed; never copied here."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model_scored(_table(spark, sf_dir, "documents"), training=fold("doc_id", 7) != 2)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_minhash": op2_minhash, "op3_decontaminate": op3_decontaminate, "op4_embeddings": op4_embeddings, "op5_html": op5_html, "op6_licenses": op6_licenses, "op7_repeats": op7_repeats, "op8_warc": op8_warc, "op9_packing": op9_packing, "op10_language_model": op10_language_model, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.ORACLES
