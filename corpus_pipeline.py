"""The corpus pipeline: its stages in order, each a function of (spark, docs, sf_dir).

All stages but the last return the columns of documents. Where docs has further columns they go along too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.llm.decontaminate import CONTAMINATED, contamination
from vigilspark.llm.entries import tokenizer_path, training_labels
from vigilspark.llm.minhash import near_duplicates
from vigilspark.llm.packing import packed
from vigilspark.llm.repeats import repeated_bytes
from vigilspark.llm.shared import Scratch
from vigilspark.llm.toxicity import fitted, scored


#: Documents whose ids are broadcast.
FEW = 500_000


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; learned as op1 is, from what is left of the labelled training rows in docs."""
    model = fitted(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored(docs, model, carry=docs.columns, keep="score < 0.5").select(*_columns(docs))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the least id stays.

    Of rows that share an id one stays. Rows without an id all stay. Texts are shuffled only where more than FEW documents go.
    """
    scratch = Scratch(spark, "kept")
    found = scratch.cut(near_duplicates(docs.select("doc_id", "text"), scratch=scratch), "found").where("doc_id is not null")
    gone, twice = found.where("not kept").select("doc_id").distinct(), found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    few = lambda ids: F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids
    gone, twice = few(gone), few(twice)
    own = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    repeated = own.join(twice, "doc_id", "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("__n = 1").drop("__n")
    return own.join(twice, "doc_id", "left_anti").unionByName(repeated).unionByName(docs.where("doc_id is null")).select(*_columns(docs))


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 100 bytes that also start earlier go; every document stays, and n_chars, where it isn't null, is the length of what is left of its text."""
    out = repeated_bytes(docs, texts=True, carry=[c for c in docs.columns if c != "text"])
    out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out
    return out.select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with the benchmark go."""
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns, keep=f"NOT {CONTAMINATED}")
    return out.select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens, as op9 gives them."""
    return packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("minhash", minhash), ("suffix_array", suffix_array), ("decontaminate", decontaminate), ("packing", packing)]
#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each other stage is written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
