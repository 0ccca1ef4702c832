"""Findings: union, counts, filters and reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity

#: Streams of findings in their order.
PHASES = ["sast", "secret", "sca", "ai", "provenance"]


def union(streams: dict[str, DataFrame]) -> DataFrame:
    out = None
    for i, phase in enumerate(PHASES):
        if phase in streams:
            part = streams[phase].withColumn("phase", F.lit(i))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stats(found: DataFrame) -> DataFrame:
    """True counts by category in one row."""
    return found.agg(*[F.count_if(F.col("category") == c).alias(f"{c}_findings") for c in ("sast", "sca", "secret")])


def summary(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])


def greatest(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(F.coalesce(F.max_by("severity", severity.rank(F.col("severity"))), F.lit("none")).alias("max_severity"))


def top(found: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The n most severe, in their order where severities are equal; 0 for all."""
    out = found.orderBy(F.desc(severity.rank(F.col("severity"))), ordinal)
    return out.limit(n) if n else out


def first_of_rule(found: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The first finding of each rule, by a partial minimum."""
    own = [c for c in found.columns if c != "rule_id"]
    return found.groupBy("rule_id").agg(F.min_by(F.struct(*own), F.col(ordinal)).alias("f")).select("rule_id", "f.*")


def rollup(stats_: DataFrame) -> DataFrame:
    return stats_.groupBy("repo").agg(*[F.sum(c).alias(c) for c in stats_.columns if c != "repo"])


def sarif_results(found: DataFrame) -> DataFrame:
    """A SARIF result for each finding, as JSON, with the rule's place in the order of its first finding."""
    first = first_of_rule(found).select("rule_id", F.col("ordinal").alias("first"))
    at = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), severity.level(F.col("severity")).alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(at).alias("locations"))
    return found.withColumn("result", F.to_json(result)).join(first, "rule_id").select("ordinal", "first", "rule_id", "result")


def sarif(found: DataFrame, tool: str = "vigilspark", version: str = "0.1") -> str:
    """SARIF 2.1.0 of one report; rules and results are made by Spark, the document on the driver."""
    rules = [{"id": r.rule_id, "name": r.title, "shortDescription": {"text": r.title}, "fullDescription": {"text": r.description}, "defaultConfiguration": {"level": r.level}, "properties": {"security-severity": str(r.score), "precision": r.confidence}} for r in first_of_rule(found).select("*", severity.level(F.col("severity")).alias("level"), severity.score(F.col("severity")).alias("score")).orderBy("ordinal").toLocalIterator()]
    results = [json.loads(r.result) for r in sarif_results(found).orderBy("ordinal").toLocalIterator()]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": results, "invocations": [{"executionSuccessful": True}]}]}, indent=2)


def text(found: DataFrame, repo: str, most: int = 0) -> str:
    counts = summary(found, []).first()
    rows = [f"Security report: {repo}", "", *(f"{s.upper():9}{counts[s]}" for s in ("critical", "high", "medium", "low")), ""]
    total = found.count()
    if not total:
        return "\n".join([*rows, "No findings."])
    shown = top(found, most).collect() if most else list(top(found, 0).toLocalIterator())
    for r in shown:
        rows += [f"[{r.severity.upper()}] {r.title} ({r.rule_id})", f"  {r.file}:{r.start_line}:{r.start_column}"]
    if total > len(shown):
        rows.append(f"... and {total - len(shown)} more")
    if counts.critical or counts.high:
        rows.append("WARNING: critical or high findings")
    return "\n".join(rows)


def as_json(found: DataFrame) -> str:
    return json.dumps([json.loads(x) for x in found.toJSON().toLocalIterator()], indent=2)


def exit_status(found: DataFrame) -> int:
    return int((found.agg(F.max(severity.rank(F.col("severity"))).alias("m")).first().m or 0) >= 4)


def write_atomic(path: str, content: str, depth: int = 8) -> None:
    """To a file below the working folder or a plain path; parts .. and ~ and too deep paths are refused."""
    parts = [p for p in path.split("/") if p]
    if ".." in parts or any(p.startswith("~") for p in parts) or len(parts) > depth:
        raise ValueError(f"unsafe path: {path}")
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
        f.write(content)
    os.replace(f.name, path)


def model_findings(replies: DataFrame) -> DataFrame:
    """replies (path, content, and repo if there is one): the weaknesses that a model lists, as an object with confidence and more or as a bare array."""
    from ..functions.text import model_json

    item = "array<struct<type:string,severity:string,description:string,line:int,confidence:string,remediation:string,cwe:string>>"
    repo = F.col("repo") if "repo" in replies.columns else F.lit(None).cast("string").alias("repo")
    rows = replies.select(repo, "path", model_json(F.col("content")).alias("j"))
    obj, arr = F.from_json("j", f"vulnerabilities {item}")["vulnerabilities"], F.from_json("j", item)
    rows = rows.select("repo", "path", obj.isNotNull().alias("is_object"), F.posexplode(F.coalesce(F.when(F.startswith(F.trim("j"), F.lit("{")), obj), F.when(F.startswith(F.trim("j"), F.lit("[")), arr))).alias("ordinal", "v"))
    level = F.lower("v.confidence")
    return rows.select(
        "repo", "path", "ordinal", F.concat(F.lit("ai-"), F.regexp_replace(F.lower("v.type"), " ", "-")).alias("rule_id"), severity.parsed(F.col("v.severity"), "unknown").alias("severity"), F.col("v.type").alias("title"), F.col("v.description").alias("description"), F.coalesce("v.line", F.lit(1)).alias("line"),
        F.when(F.col("is_object"), F.when(level.isin("high", "medium"), level).otherwise("low")).otherwise("medium").alias("confidence"), F.when(F.col("is_object") & (F.col("v.remediation") != ""), F.col("v.remediation")).alias("remediation"),
    )


def cache_verdict(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new (key, path, hash): whether each key's files and hashes are the same."""
    o, n = old.withColumnRenamed("hash", "old_hash"), new.withColumnRenamed("hash", "new_hash")
    return o.join(n, [*key, "path"], "full").groupBy(*key).agg(F.bool_and(F.col("old_hash").eqNullSafe(F.col("new_hash"))).alias("valid"))


def unexpired(rows: DataFrame, now, ttl: str = "ttl_secs") -> DataFrame:
    """Rows whose age doesn't exceed their time to live; 0 never ends."""
    return rows.where((F.col(ttl) == 0) | (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("created_at") <= F.col(ttl)))


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("created_at")))).where("r = 1").drop("r")


def vulnerable_dependency_title(name, version, id_):
    return F.concat(F.lit("Vulnerable dependency: "), name, F.lit(" "), version, F.lit(" ("), id_, F.lit(")"))


def reportable(found: DataFrame) -> DataFrame:
    """What a scan gives with all that reports need, filled in where a stream has none. Its order is that of phases, places and rules, so no row is numbered across the table."""
    have = set(found.columns)
    old = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    title = F.coalesce(old("title", "string"), F.initcap(F.regexp_replace(F.regexp_replace("rule_id", "^[^/]*/", ""), "-", " ")))
    out = found.withColumn("title", title).withColumn("description", F.coalesce(old("description", "string"), old("remediation", "string"), title)).withColumn("start_column", F.coalesce(old("start_column", "int"), F.lit(1)))
    out = out.withColumn("end_line", F.coalesce(old("end_line", "int"), F.col("start_line"))).withColumn("end_column", F.coalesce(old("end_column", "int"), F.col("start_column")))
    return out.withColumn("ordinal", F.struct("phase", "repo", "file", "start_line", "start_column", "rule_id"))
