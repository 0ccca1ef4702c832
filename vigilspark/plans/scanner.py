"""A scan as one plan: files and manifests of any number of repositories to one table of findings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import files as names
from ..functions import severity
from ..operators import findings, provenance, sast, sca, secrets
from ..sources import manifests


@dataclass(frozen=True)
class Config:
    sast: bool = True
    secrets: bool = True
    sca: bool = True
    ai: bool = False
    provenance: bool = False
    min_severity: str = "low"
    entropy_threshold: float = 4.5
    max_file_size: int = 1 << 20
    snippet_lines: int = 3
    #: manifests are read at the root of a repository; with this, in its folders too
    nested_manifests: bool = False
    ignore_patterns: tuple[str, ...] = tuple(names.IGNORED)
    languages: tuple[str, ...] = tuple(names.SUPPORTED)

    @classmethod
    def read(cls, path: str) -> Config:
        """From the table analysis of a TOML file; names that aren't ours are passed over."""
        with open(path, "rb") as f:
            got = tomllib.load(f).get("analysis", {})
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in known})


_COLUMNS = ["repo", "file", "rule_id", "severity", "confidence", "start_line", "category"]


def scan(files: DataFrame, config: Config | None = None, *, advisories: DataFrame | None = None, replies: DataFrame | None = None, attestations: DataFrame | None = None) -> DataFrame:
    """files (repo, path, content) and, where they are given, advisories, models' replies (path, content, and repo if there is one) and attestations (package, and repo if there is one) as findings, least severities left out.

    Streams that are switched off aren't planned. Filters on paths and sizes stand before the parser, which Spark can't push them through.
    """
    c = config or Config()
    own = files.withColumn("language", names.language(F.col("path"))).where(~names.is_ignored(F.col("path"), list(c.ignore_patterns)) & (F.octet_length("content") <= c.max_file_size))
    code = own.where(F.col("language").isin(list(c.languages)))
    streams = {}
    if c.sast:
        streams["sast"] = sast.scanned(code, c.snippet_lines).select(*_COLUMNS, "start_column", "end_line", "end_column", "cwe", "remediation", "snippet")
    if c.secrets:
        streams["secret"] = secrets.scanned(own.select("repo", "path", "language", "content"), c.entropy_threshold).select(*_COLUMNS, F.col("ordinal").alias("place"))
    if c.sca and advisories is not None:
        repo_key = files.select(F.concat_ws("\u0000", F.coalesce("repo", F.lit("")), "path").alias("key"), "repo", F.col("path").alias("p"), "content")
        deps = None
        for name, read in manifests.READERS.items():
            here = (F.col("p") == name) | (F.endswith("p", F.lit("/" + name)) if c.nested_manifests else F.lit(False))
            part = read(repo_key.where(here).select(F.col("key").alias("path"), "content")).select("manifest", "ecosystem", "name", "version").where("name is not null")
            deps = part if deps is None else deps.unionByName(part)
        hit = sca.affected(deps.withColumn("ecosystem", F.when(F.col("ecosystem") == "Cargo", "crates.io").otherwise(F.lower("ecosystem"))), advisories.withColumn("ecosystem", F.lower("ecosystem")))
        parts = F.split("manifest", "\u0000")
        streams["sca"] = hit.select(F.get(parts, F.lit(0)).alias("repo"), F.get(parts, F.lit(1)).alias("file"), F.concat(F.lit("sca/"), F.col("id")).alias("rule_id"), "severity", F.lit("high").alias("confidence"), F.lit(0).alias("start_line"), F.lit("sca").alias("category"), findings.vulnerable_dependency_title(F.col("name"), F.col("version"), F.col("id")).alias("title"))
    if c.ai and replies is not None:
        streams["ai"] = findings.model_findings(replies).select("repo", F.col("path").alias("file"), "rule_id", "severity", "confidence", F.col("line").alias("start_line"), F.lit("sast").alias("category"), "title", "description", "remediation", F.col("ordinal").alias("place"))
    if c.provenance and attestations is not None:
        named = attestations if "repo" in attestations.columns else attestations.withColumn("repo", F.lit(None).cast("string"))
        # a package of two repositories has a verdict in each
        broken = provenance.findings(provenance.folded(named.withColumn("package", F.struct("repo", F.col("package").cast("string").alias("name")))))
        streams["provenance"] = broken.select("package.repo", F.col("package.name").alias("file"), "rule_id", "severity", "confidence", F.lit(0).alias("start_line"), F.lit("sast").alias("category"))
    if not streams:
        return files.sparkSession.createDataFrame([], "repo string, file string, rule_id string, severity string, confidence string, start_line int, category string, phase int, finding_id string")
    out = findings.union(streams).where(severity.at_least(F.col("severity"), c.min_severity))
    return out.withColumn("finding_id", finding_id(out))


def finding_id(found: DataFrame) -> F.Column:
    """A hash of all that tells a finding from others: repository, rule, file and place, in which nulls count."""
    have = [c for c in ("repo", "rule_id", "file", "start_line", "start_column", "end_line", "end_column", "place", "title") if c in found.columns]
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in have]), 256)


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose content isn't in cached (repo, path, hash); only these need a scan."""
    return files.withColumn("hash", F.sha2("content", 256)).join(cached.select("repo", "path", "hash"), ["repo", "path", "hash"], "left_anti")


def verify(crates: DataFrame, statements: DataFrame, entries: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Findings of the provenance of crates (crate, version, checksum, repository); see provenance.verified."""
    verdicts = provenance.verified(crates, statements, entries, cached)
    return provenance.findings(verdicts.withColumn("package", F.concat_ws("@", "crate", "version")))


def report(found: DataFrame, form: str = "text", repo: str = "", most: int = 0) -> str:
    """A scan's findings as text, json or sarif."""
    rows = findings.reportable(found)
    return {"text": lambda: findings.text(rows, repo, most), "json": lambda: findings.as_json(rows), "sarif": lambda: findings.sarif(rows)}[form]()
