"""Hard-coded secrets in files, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import files as paths
from ..functions import text

#: Public formats of tokens.
FORMATS = {"aws-access-key": r"\b(AKIA[0-9A-Z]{16})\b", "github-token": r"\b(gh[pousr]_[0-9A-Za-z]{36})\b", "slack-token": r"\b(xox[abprs]-[0-9A-Za-z-]{10,})", "private-key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"}


def scanned(files: DataFrame, threshold: float = 4.5) -> DataFrame:
    """files (repo, path, language, content): values assigned to telling names that look like secrets or are random, and known formats. Tests are left out."""
    own = files.where(~paths.is_test(F.col("path"))).select("repo", "path", F.posexplode(F.split("content", "\r?\n")).alias("n", "l"))
    assigned = F.transform(F.filter(F.regexp_extract_all("l", F.lit(text.ASSIGNMENT), 2), lambda v: text.looks_secret(v)), lambda v: F.struct(F.lit("secret/hardcoded-assignment").alias("rule_id"), v.alias("value"), text.is_random(v, threshold).alias("random")))
    known = [F.transform(F.regexp_extract_all("l", F.lit(rx), 1), lambda v, n=name: F.struct(F.lit(f"secret/{n}").alias("rule_id"), v.alias("value"), F.lit(True).alias("random"))) for name, rx in FORMATS.items()]
    rows = own.select("repo", F.col("path").alias("file"), (F.col("n") + 1).alias("start_line"), F.posexplode(F.concat(assigned, *known)).alias("ordinal", "h"))
    return rows.select("repo", "file", "h.rule_id", F.lit("high").alias("severity"), F.when(F.col("h.random"), "high").otherwise("medium").alias("confidence"), "start_line", "h.value", F.lit("secret").alias("category"), "ordinal")
