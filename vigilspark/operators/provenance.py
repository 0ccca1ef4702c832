"""Attestations of builds, folded to a verdict for each package, and the findings that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Builders that are trusted unless others are added.
TRUSTED = ["https://github.com/slsa-framework/slsa-github-generator", "https://github.com/actions/runner", "https://gitlab.com/gitlab-org/gitlab-runner"]
#: Log entries looked at for each checksum.
ENTRIES = 5


def is_trusted(builder: Column, trusted: list[str] = TRUSTED) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in trusted]), lambda t: F.contains(builder, t))


def folded(attestations: DataFrame) -> DataFrame:
    """attestations (package, ordinal, level, signature_valid, builder, source_repo, error): greatest level, any signature, last builder and repository, all errors in order."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    errors = F.transform(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("ordinal", "error")))), lambda x: x["error"])
    return attestations.groupBy("package").agg(F.max("level").alias("level"), F.bool_or("signature_valid").alias("signature_valid"), last("builder"), last("source_repo"), errors.alias("errors"))


def preferred(hits: DataFrame, key: list[str] | None = None) -> DataFrame:
    """hits (package or key, priority, ...): those of the first pattern that found any."""
    return hits.withColumn("r", F.rank().over(Window.partitionBy(*(key or ["package"])).orderBy("priority"))).where("r = 1").drop("r")


def log_entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("r", F.row_number().over(Window.partitionBy("checksum").orderBy("ordinal"))).where(F.col("r") <= ENTRIES).drop("r")


def findings(verdicts: DataFrame) -> DataFrame:
    """A row for each rule that a verdict breaks; rules don't exclude each other."""
    some = F.col("builder").isNotNull()

    def rule(when: Column, name: str, severity: str, confidence: str) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))

    rules = F.array(
        rule(~some & (F.size("errors") > 0), "provenance/missing-attestation", "medium", "high"),
        rule(some & ~is_trusted(F.col("builder")), "provenance/untrusted-builder", "low", "medium"),
        rule((F.col("level") < 2) & some, "provenance/low-slsa-level", "low", "high"),
        rule(some & ~F.col("signature_valid"), "provenance/invalid-signature", "high", "high"),
    )
    return verdicts.select("package", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("f")).select("package", "f.*")


def missing(requested: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(cached, keys, "left_anti")


def verified(crates: DataFrame, statements: DataFrame, entries: DataFrame, cached: DataFrame | None = None, trusted: list[str] = TRUSTED) -> DataFrame:
    """A verdict for each of crates (crate, version, checksum, repository), for findings.

    statements (crate, version, ordinal, s) count where they are of build provenance: level 1, or 2 by a trusted builder; the signature holds if a
    subject has the crate's checksum or the log (checksum, ordinal, integrated_time) knows it. Verdicts of cached (checksum, level, signature_valid,
    builder, source_repo, errors) go before all others, without a build time. Statements are folded by partial aggregates, so no crate's are gathered but its errors.
    """
    own = statements.where(F.contains("s.predicateType", F.lit("slsa.dev/provenance"))).join(crates.select("crate", "version", "checksum"), ["crate", "version"])
    builder = F.col("s.predicate.builder.id")
    matches = F.exists("s.subject", lambda x: F.coalesce(F.lower(x["digest"]["sha256"]) == F.lower("checksum"), F.lit(False)))
    sources = F.filter(F.coalesce("s.predicate.buildDefinition.resolvedDependencies", F.array().cast("array<struct<uri:string,digest:map<string,string>>>")), lambda d: F.contains(d["uri"], F.lit("github.com")))
    wrong = F.filter(F.array(F.when(builder.isNotNull() & ~is_trusted(builder, trusted), F.concat(F.lit("Untrusted builder: "), builder)), F.when(F.col("checksum").isNotNull() & ~matches, F.lit("Subject digest mismatch"))), lambda e: e.isNotNull())
    each = own.select("crate", "version", "ordinal", F.when(is_trusted(builder, trusted), 2).otherwise(1).alias("level"), (F.col("checksum").isNotNull() & matches).alias("matched"), builder.alias("builder"), F.element_at(sources, -1).alias("source"), wrong.alias("wrong"))
    last = lambda c, o: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(o)
    errors = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("wrong") > 0, F.struct("ordinal", "wrong")))), lambda x: x["wrong"]))
    folded_ = each.groupBy("crate", "version").agg(F.max("level").alias("level"), F.bool_or("matched").alias("matched"), last("builder", "builder"), last("source", "source"), errors.alias("wrong"))
    tried = statements.select("crate", "version").distinct().withColumn("tried", F.lit(True))
    logged = log_entries(entries).groupBy("checksum").agg(F.struct(F.min_by("integrated_time", "ordinal").alias("at")).alias("log"))
    rows = crates.join(tried, ["crate", "version"], "left").join(folded_, ["crate", "version"], "left").join(logged, "checksum", "left")
    none = F.when(F.col("repository").isNull(), F.array(F.lit("No repository in the metadata"))).when(F.col("tried").isNull(), F.array(F.lit("No attestation found")))
    source = F.col("source")
    out = rows.select(
        "crate", "version", "checksum", F.coalesce("level", F.lit(0)).alias("level"), (F.coalesce("matched", F.lit(False)) | F.col("log").isNotNull()).alias("signature_valid"), "builder", source["uri"].alias("source_repo"),
        F.coalesce(source["digest"]["sha1"], source["digest"]["gitCommit"]).alias("source_commit"), F.coalesce(none, F.col("wrong"), F.array().cast("array<string>")).alias("errors"), F.col("log.at").alias("build_time"),
    )
    if cached is None:
        return out
    names = ["level", "signature_valid", "builder", "source_repo", "errors"]
    held = cached.select("checksum", F.struct(*names).alias("held"))
    pick = lambda c: F.when(F.col("held").isNotNull(), F.col(f"held.{c}") if c in names else F.lit(None)).otherwise(F.col(c)).alias(c)
    return out.join(held, "checksum", "left").select("crate", "version", "checksum", *[pick(c) for c in out.columns if c not in ("crate", "version", "checksum")])
