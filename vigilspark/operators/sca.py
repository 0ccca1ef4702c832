"""Dependencies against advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity, versions

OSV_SCHEMA = "id string, aliases array<string>, summary string, details string, severity array<struct<type:string,score:string>>, affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>, references array<struct<type:string,url:string>>, published string, modified string, database_specific struct<cwes:array<string>,cwe_ids:array<string>>"
#: Kinds of references; all others are web pages.
REFERENCE_KINDS = ["ADVISORY", "ARTICLE", "DETECTION", "DISCUSSION", "REPORT", "FIX", "INTRODUCED", "PACKAGE", "EVIDENCE", "WEB"]


def event_ranges(events: Column) -> Column:
    """Pairs of neighbouring events: introduced from the first, fixed from the second; a single event gives none."""
    first = F.slice(events, 1, F.greatest(F.size(events) - 1, F.lit(0)))
    after = F.slice(events, 2, F.greatest(F.size(events) - 1, F.lit(0)))
    pairs = F.zip_with(first, after, lambda a, b: F.struct(a["introduced"].alias("introduced"), b["fixed"].alias("fixed"), F.lit(None).cast("string").alias("last_affected")))
    return F.filter(pairs, lambda p: p["introduced"].isNotNull() | p["fixed"].isNotNull())


def advisories(raw: DataFrame) -> DataFrame:
    """From a column json of advisories in the open source vulnerability format."""
    d = F.from_json("json", OSV_SCHEMA)
    rows = raw.select(d.alias("d"))
    score = F.try_cast(F.get("d.severity.score", F.lit(0)), "double") if hasattr(F, "try_cast") else F.expr("try_cast(get(d.severity.score, 0) as double)")
    ranges = F.flatten(F.flatten(F.transform("d.affected", lambda a: F.transform(F.coalesce(a["ranges"], F.array()), lambda r: event_ranges(r["events"])))))
    fixes = F.filter(F.transform(F.get(F.get("d.affected", F.lit(0))["ranges"], F.lit(0))["events"], lambda e: e["fixed"]), lambda x: x.isNotNull())
    return rows.select(
        "d.id", F.coalesce("d.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("d.summary", F.lit("No description available")).alias("summary"), "d.details",
        severity.from_cvss(score).alias("severity"), score.alias("cvss_score"),
        F.coalesce(F.get("d.affected", F.lit(0))["package"]["name"], F.lit("unknown")).alias("package"), F.get("d.affected", F.lit(0))["package"]["ecosystem"].alias("ecosystem"),
        F.coalesce(ranges, F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>")).alias("affected_versions"), F.get(fixes, F.lit(0)).alias("fixed_version"),
        F.transform(F.coalesce("d.references", F.array().cast("array<struct<type:string,url:string>>")), lambda r: F.struct(F.when(r["type"].isin(REFERENCE_KINDS), r["type"]).otherwise("WEB").alias("ref_type"), r["url"].alias("url"))).alias("references"),
        F.coalesce("d.database_specific.cwes", "d.database_specific.cwe_ids", F.array().cast("array<string>")).alias("cwes"),
        F.try_to_timestamp(F.col("d.published")).alias("published"), F.try_to_timestamp(F.col("d.modified")).alias("modified"),
    )


def affected(deps: DataFrame, known: DataFrame) -> DataFrame:
    """deps (ecosystem, name, version, ...) with the advisories (ecosystem, package, affected_versions, ...) that hold for them.

    An equi-join on ecosystem and name, then any range; Spark broadcasts advisories only below its own size threshold, and
    splits a package that most dependencies name where it shuffles. An advisory without ranges holds for all versions.
    """
    k = known.withColumnsRenamed({"ecosystem": "a_ecosystem"})
    pairs = deps.join(k, (F.lower(deps.ecosystem) == F.lower(k.a_ecosystem)) & (deps.name == k.package))
    hit = (F.size("affected_versions") == 0) | F.exists("affected_versions", lambda r: versions.in_range(F.col("ecosystem"), F.col("version"), r["introduced"], r["fixed"], r["last_affected"]))
    return pairs.where(hit).drop("a_ecosystem")


def first_cve(id_: Column, aliases: Column) -> Column:
    return F.get(F.filter(F.concat(F.array(id_), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: F.startswith(x, F.lit("CVE-"))), F.lit(0))


def cvss(metrics: Column) -> Column:
    """The first of version 3.1, else of version 3.0."""
    return F.coalesce(F.get(metrics["cvssMetricV31"], F.lit(0)), F.get(metrics["cvssMetricV30"], F.lit(0)))


def cwes(weaknesses: Column) -> Column:
    all_ = F.flatten(F.transform(weaknesses, lambda w: w["description"]))
    return F.transform(F.filter(all_, lambda d: (d["lang"] == "en") & F.startswith(d["value"], F.lit("CWE-"))), lambda d: d["value"])


def enriched(vulns: DataFrame, nvd: DataFrame) -> DataFrame:
    """vulns (id, aliases, source, cvss_score, cwes, details, severity, references) with what nvd (cve, base_score, nvd_cwes, description) adds.

    Scores of other sources are overwritten, and severities with them; weaknesses and details are filled where empty; the reference is added once.
    """
    keyed = vulns.withColumn("cve", first_cve(F.col("id"), F.col("aliases"))).join(nvd, "cve", "left")
    over = F.col("base_score").isNotNull() & (F.col("cvss_score").isNull() | (F.col("source") != "Nvd"))
    url = F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), F.col("cve"))
    known = F.exists("references", lambda r: r["url"] == url)
    found = F.col("base_score").isNotNull() | F.col("description").isNotNull()
    return keyed.select(
        *[c for c in vulns.columns if c not in ("cvss_score", "severity", "cwes", "details", "references")],
        F.when(over, F.col("base_score")).otherwise(F.col("cvss_score")).alias("cvss_score"), F.when(over, severity.from_cvss(F.col("base_score"))).otherwise(F.col("severity")).alias("severity"),
        F.when((F.size("cwes") == 0) & F.col("nvd_cwes").isNotNull(), F.col("nvd_cwes")).otherwise(F.col("cwes")).alias("cwes"), F.coalesce("details", "description").alias("details"),
        F.when(found & ~known, F.array_append("references", F.struct(F.lit("ADVISORY").alias("ref_type"), url.alias("url")))).otherwise(F.col("references")).alias("references"),
    )
