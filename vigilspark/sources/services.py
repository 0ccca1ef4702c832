"""Answers of outside services as tables. Each reader takes rows of (…, json) as a service gave them; what can't be read is left out, as a failed request would be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import purl, severity

#: Names of package systems by package type; others aren't asked about.
SYSTEMS = {"cargo": "CARGO", "npm": "NPM", "pypi": "PYPI", "golang": "GO", "go": "GO", "maven": "MAVEN", "nuget": "NUGET"}
#: Seconds for which the checkpoint of a log holds.
CHECKPOINT_SECONDS = 3600
#: Rows of a page of repositories at most.
PAGE = 100

_CVSS = "array<struct<cvssData:struct<version:string,vectorString:string,baseScore:double,baseSeverity:string>>>"
_CVE = f"id string, descriptions array<struct<lang:string,value:string>>, metrics struct<cvssMetricV31:{_CVSS},cvssMetricV30:{_CVSS}>, weaknesses array<struct<description:array<struct<lang:string,value:string>>>>"
_STATEMENT = "_type string, predicateType string, subject array<struct<name:string,digest:map<string,string>>>, predicate struct<builder:struct<id:string>,buildDefinition:struct<resolvedDependencies:array<struct<uri:string,digest:map<string,string>>>>>"


def coordinates(purls: DataFrame) -> DataFrame:
    """purls (purl, ...) with system, name (namespace and name by a slash) and version (latest where there is none). Types that no system has are left out."""
    p = purl.parse(F.col("purl"))
    rows = purls.withColumn("p", p).withColumn("system", severity.ladder(F.col("p.type"), SYSTEMS, None)).where("system is not null")
    return rows.withColumn("name", F.concat_ws("/", "p.namespace", "p.name")).withColumn("version", F.coalesce("p.version", F.lit("latest"))).drop("p")


def package_advisories(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (system, name, version) against known (system, name, version, advisories): a row for each advisory, with the fields of a vulnerability."""
    rows = asked.join(known, ["system", "name", "version"]).select("name", "version", F.explode("advisories").alias("a"))
    return rows.select("name", "version", F.col("a.id").alias("id"), F.coalesce("a.title", "a.id").alias("summary"), F.col("a.description").alias("details"), severity.parsed(F.col("a.severity"), "unknown").alias("severity"), F.lit(None).cast("double").alias("cvss_score"))


def vulnerabilities(raw: DataFrame) -> DataFrame:
    """raw (cve, json): the first record of each answer to a name that begins with CVE-, as (cve, base_score, cvss_version, nvd_cwes, description)."""
    from ..operators import sca

    d = F.get(F.from_json("json", f"vulnerabilities array<struct<cve:struct<{_CVE.replace(' ', ':').replace(',:', ',')}>>>")["vulnerabilities"], F.lit(0))["cve"]
    rows = raw.where(F.startswith("cve", F.lit("CVE-"))).select("cve", d.alias("d")).where("d is not null")
    score = sca.cvss(F.col("d.metrics"))["cvssData"]
    english = F.get(F.filter("d.descriptions", lambda x: x["lang"] == "en"), F.lit(0))["value"]
    return rows.select("cve", score["baseScore"].alias("base_score"), score["version"].alias("cvss_version"), F.coalesce(F.array_distinct(sca.cwes(F.col("d.weaknesses"))), F.array().cast("array<string>")).alias("nvd_cwes"), english.alias("description"))


def crates(raw: DataFrame) -> DataFrame:
    """raw (crate, version, json): checksum, dl_path and repository; an answer without a version is left out."""
    d = F.from_json("json", "version struct<checksum:string,dl_path:string>, crate struct<repository:string>")
    return raw.select("crate", "version", d.alias("d")).where("d.version is not null").select("crate", "version", "d.version.checksum", "d.version.dl_path", "d.crate.repository")


def attestation_urls(owner: Column, repo: Column, version: Column) -> Column:
    """Places where a release keeps its attestations, in the order in which they are asked."""
    base = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/releases/download/"))
    v = F.concat(F.lit("v"), version)
    #: Names of attestation files.
    return F.array(F.concat(base, v, F.lit("/provenance.intoto.jsonl")), F.concat(base, version, F.lit("/provenance.intoto.jsonl")), F.concat(base, v, F.lit("/"), repo, F.lit("-"), version, F.lit(".intoto.jsonl")), F.concat(base, v, F.lit("/multiple.intoto.jsonl")))


def statements(files: DataFrame) -> DataFrame:
    """files (crate, version, priority, content), one JSON document a line, as (crate, version, priority, ordinal, s).

    Lines that aren't statements are dropped. Of each crate's files the first that holds any counts.
    """
    from ..operators.provenance import preferred

    lines = files.select("crate", "version", "priority", F.posexplode(F.split("content", "\r?\n")).alias("ordinal", "line"))
    rows = lines.select("crate", "version", "priority", "ordinal", F.from_json("line", _STATEMENT).alias("s")).where("s._type is not null and s.predicateType is not null and s.subject is not null")
    return preferred(rows, ["crate", "version"])


def of_version(rows: DataFrame) -> DataFrame:
    """Statements of an index of attestations, of which a subject's name holds the version."""
    return rows.where(F.exists("s.subject", lambda x: F.contains(x["name"], F.col("version"))))


def log_records(raw: DataFrame) -> DataFrame:
    """raw (checksum, ordinal, json), an object by entry id: integrated_time of the first entry. Entries that can't be read are left out."""
    d = F.from_json("json", "map<string,struct<integratedTime:bigint,body:string>>")
    rows = raw.select("checksum", "ordinal", F.get(F.map_entries(d), F.lit(0)).alias("e")).where("e is not null")
    return rows.select("checksum", "ordinal", F.col("e.key").alias("uuid"), F.timestamp_seconds("e.value.integratedTime").alias("integrated_time"), F.col("e.value.body").alias("body"))


def fresh(checkpoints: DataFrame, now, seconds: int = CHECKPOINT_SECONDS) -> DataFrame:
    """Checkpoints (created_at, ...) that aren't older than so many seconds."""
    return checkpoints.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at") <= seconds)


def page(repositories: DataFrame, most: int, ordinal: str = "ordinal") -> DataFrame:
    """The first of repositories (owner, ...), a page at most; those without an owner are dropped after the page is cut."""
    return repositories.orderBy(ordinal).limit(min(most, PAGE)).where("owner is not null")


def active(repositories: DataFrame) -> DataFrame:
    return repositories.where(~F.coalesce("archived", F.lit(False)))


def rate(limits: DataFrame, now: Column) -> DataFrame:
    """limits (remaining, reset), reset in seconds since 1970: is_limited, and wait_seconds, never below 0."""
    return limits.withColumn("is_limited", F.col("remaining") == 0).withColumn("wait_seconds", F.greatest(F.col("reset") - now, F.lit(0)).cast("long"))


def dependency_edges(graphs: DataFrame) -> DataFrame:
    """graphs (nodes, edges) with edges by index of node, each graph in a row, as (from_name, from_version, to_name, to_version, requirement). Edges to no node are left out."""
    rows = graphs.select("nodes", F.explode("edges").alias("e"))
    a, b = F.get(F.col("nodes"), F.col("e.fromNode").cast("int"))["versionKey"], F.get(F.col("nodes"), F.col("e.toNode").cast("int"))["versionKey"]
    return rows.select(a.alias("a"), b.alias("b"), F.col("e.requirement").alias("requirement")).where("a is not null and b is not null").select(F.col("a.name").alias("from_name"), F.col("a.version").alias("from_version"), F.col("b.name").alias("to_name"), F.col("b.version").alias("to_version"), "requirement")
