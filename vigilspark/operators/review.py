"""A model's review of files, by a client that the caller gives, and taint flows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prompt
from ..session import ship

#: Bytes of code beyond which a file isn't asked about.
MOST_BYTES = 100 * 1024


def asked(files: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """files (repo, path, language, content) with the model's reply as content, for findings.model_findings.

    client makes, once in a task, a function from prompt to reply. A reply that fails leaves a null content and its error; no other file suffers.
    """
    ship(files.sparkSession)
    rows = files.where(F.octet_length("content") <= MOST_BYTES).select("repo", "path", prompt(F.col("language"), F.col("path"), F.lit(None).cast("string"), F.col("content")).alias("prompt"))

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for b in batches:
            ask = ask or client()
            out, errors = [], []
            for text in b.column("prompt").to_pylist():
                try:
                    out.append(ask(text))
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("repo"), b.column("path"), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["repo", "path", "content", "error"])

    return rows.mapInArrow(replies, "repo string, path string, content string, error string")


def taint_flows(spark: SparkSession) -> DataFrame:
    """The table of flows from sources to sinks, which has no rows: no analysis fills it in the engine that this one follows."""
    return spark.createDataFrame([], "repo string, source_file string, source_line int, sink_file string, sink_line int, kind string, confidence string")
