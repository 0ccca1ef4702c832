"""Queries over answers of outside services, verification of packages and caches; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files, purl, versions
from ..operators import cache, findings, provenance, review, sca
from ..sources import services
from . import scanner
from .catalogue import query, table, values

_NOW = "2024-06-01 12:00:00"


@query("SELECT * FROM (VALUES ('https://github.com/tokio-rs/tokio', 'tokio-rs', 'tokio'), ('https://github.com/serde-rs/serde.git', 'serde-rs', 'serde'), ('git@github.com:rust-lang/rust.git', 'rust-lang', 'rust'), ('x', NULL, NULL)) t(url, owner, name)")
def release_repository(spark, sf):
    urls = values(spark, "('https://github.com/tokio-rs/tokio'), ('https://github.com/serde-rs/serde.git'), ('git@github.com:rust-lang/rust.git'), ('x')", "url")
    return urls.select("url", files.release_repository(F.col("url")).alias("r")).select("url", "r.owner", "r.name")


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'NPM' ELSE 'CARGO' END AS system, CASE WHEN p_partkey % 3 = 0 THEN '@s/' ELSE '' END || 'n' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN '1.' || p_size ELSE 'latest' END AS version FROM part WHERE p_partkey % 3 < 2")
def depsdev_coordinates(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "pkg:npm/%40s/n").when(k % 3 == 1, "pkg:cargo/n").otherwise("pkg:hex/n")
    purls = table(spark, sf, "part").select(F.concat(kind, k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("@1."), F.col("p_size").cast("string"))).otherwise("")).alias("purl"))
    return services.coordinates(purls).select("system", "name", "version")


@query("SELECT 'b' || p_size AS name, p_partkey::VARCHAR AS version, 'GHSA-' || p_size AS id, CASE WHEN p_size % 2 = 0 THEN 'GHSA-' || p_size ELSE 't' END AS summary, CASE p_size % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'critical' ELSE 'unknown' END AS severity FROM part WHERE p_size <= 20")
def depsdev_package_advisories(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    key = [F.lit("NPM").alias("system"), F.concat(F.lit("b"), size.cast("string")).alias("name"), F.col("p_partkey").cast("string").alias("version")]
    advisory = F.struct(F.concat(F.lit("GHSA-"), size.cast("string")).alias("id"), F.when(size % 2 == 1, "t").alias("title"), F.lit(None).cast("string").alias("description"), F.when(size % 3 == 0, "MODERATE").when(size % 3 == 1, "Critical").otherwise("?").alias("severity"))
    known = p.where("p_size <= 20").select(*key, F.array(advisory).alias("advisories"))
    return services.package_advisories(p.select(*key), known).select("name", "version", "id", "summary", "severity")


@query("SELECT * FROM (VALUES ('CVE-1', 9.8::DOUBLE, '3.1', 'CWE-89', 'bad'), ('CVE-2', 6.1::DOUBLE, '3.0', '', NULL), ('CVE-3', NULL, NULL, '', NULL)) t(cve, base_score, cvss_version, cwes, description)")
def nvd_records(spark, sf):
    one = '{"vulnerabilities":[{"cve":{"id":"CVE-1","descriptions":[{"lang":"es","value":"malo"},{"lang":"en","value":"bad"}],"metrics":{"cvssMetricV31":[{"cvssData":{"version":"3.1","baseScore":9.8}}],"cvssMetricV30":[{"cvssData":{"version":"3.0","baseScore":1.0}}]},"weaknesses":[{"description":[{"lang":"en","value":"CWE-89"},{"lang":"en","value":"other"}]}]}},{"cve":{"id":"CVE-9"}}]}'
    two = '{"vulnerabilities":[{"cve":{"id":"CVE-2","metrics":{"cvssMetricV30":[{"cvssData":{"version":"3.0","baseScore":6.1}}]}}}]}'
    raw = values(spark, f"('CVE-1', '{one}'), ('CVE-2', '{two}'), ('CVE-3', '{{\"vulnerabilities\":[{{\"cve\":{{\"id\":\"CVE-3\"}}}}]}}'), ('CVE-4', '{{\"vulnerabilities\":[]}}'), ('CVE-5', 'x'), ('GHSA-1', '{two}')", "cve, json")
    return services.vulnerabilities(raw).select("cve", "base_score", "cvss_version", F.array_join("nvd_cwes", ",").alias("cwes"), "description")


@query("SELECT * FROM (VALUES ('a', '1.0', 'AB', '/dl', 'https://github.com/o/a'), ('b', '1.0', NULL, NULL, NULL)) t(crate, version, checksum, dl_path, repository)")
def crate_metadata(spark, sf):
    raw = """('a', '1.0', '{"version":{"checksum":"AB","dl_path":"/dl"},"crate":{"repository":"https://github.com/o/a"}}'), ('b', '1.0', '{"version":{"num":"1.0"}}'), ('c', '1.0', '{"errors":[]}'), ('d', '1.0', 'x')"""
    return services.crates(values(spark, raw, "crate, version, json"))


@query("""WITH s AS (SELECT s_suppkey, 'https://github.com/o/r' || s_suppkey || '/releases/download/' AS b, '1.' || s_nationkey AS v FROM supplier)
SELECT s_suppkey, 0 AS priority, b || 'v' || v || '/provenance.intoto.jsonl' AS url FROM s UNION ALL SELECT s_suppkey, 1, b || v || '/provenance.intoto.jsonl' FROM s
UNION ALL SELECT s_suppkey, 2, b || 'v' || v || '/r' || s_suppkey || '-' || v || '.intoto.jsonl' FROM s UNION ALL SELECT s_suppkey, 3, b || 'v' || v || '/multiple.intoto.jsonl' FROM s""")
def attestation_urls(spark, sf):
    s = table(spark, sf, "supplier")
    urls = services.attestation_urls(F.lit("o"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")), F.concat(F.lit("1."), F.col("s_nationkey").cast("string")))
    return s.select("s_suppkey", F.posexplode(urls).alias("priority", "url"))


def _statement(builder: str, digest: str, name: str = "a-1.0", kind: str = "https://slsa.dev/provenance/v1") -> str:
    return f'{{"_type":"t","predicateType":"{kind}","subject":[{{"name":"{name}","digest":{{"sha256":"{digest}"}}}}],"predicate":{{"builder":{{"id":"{builder}"}},"buildDefinition":{{"resolvedDependencies":[{{"uri":"git+https://github.com/o/a","digest":{{"gitCommit":"c0"}}}}]}}}}}}'


_TRUSTED = "https://github.com/actions/runner/x"


def _statements(spark):
    bundles = [("a", 0, "nothing"), ("a", 1, _statement(_TRUSTED, "AB") + "\\n\\nbroken\\n" + _statement("odd", "ff")), ("a", 2, _statement("late", "AB")), ("b", 0, _statement("odd", "ff", "b-1.0")), ("c", 0, _statement("odd", "ff", kind="other"))]
    return services.statements(values(spark, ", ".join(f"('{c}', '1.0', {p}, '{t}')" for c, p, t in bundles), "crate, version, priority, content"))


def _crates(spark):
    return values(spark, "('a', '1.0', 'ab', 'u'), ('b', '1.0', 'cd', 'u'), ('c', '1.0', 'ef', 'u'), ('d', '1.0', 'gh', CAST(NULL AS STRING)), ('e', '1.0', CAST(NULL AS STRING), 'u'), ('f', '1.0', 'ij', 'u')", "crate, version, checksum, repository")


def _entries(spark):
    return services.log_records(values(spark, """('cd', 1, '{"u2":{"integratedTime":200,"body":"y"}}'), ('cd', 0, '{"u1":{"integratedTime":100,"body":"x"}}'), ('gh', 0, 'broken')""", "checksum, ordinal, json"))


def _cached(spark):
    return values(spark, "('ij', 3, true, 'cached', 'repo', array('old'))", "checksum, level, signature_valid, builder, source_repo, errors")


@query("SELECT * FROM (VALUES ('a', 1, 0, 'AB', true), ('a', 1, 3, 'ff', true), ('b', 0, 0, 'ff', true), ('c', 0, 0, 'ff', true)) t(crate, priority, ordinal, digest, of_version)")
def attestation_statements(spark, sf):
    rows = _statements(spark)
    held = services.of_version(rows).select("crate", "ordinal", F.lit(True).alias("of_version"))
    return rows.join(held, ["crate", "ordinal"], "left").select("crate", "priority", "ordinal", F.get("s.subject", F.lit(0))["digest"]["sha256"].alias("digest"), "of_version")


@query("SELECT * FROM (VALUES ('cd', 0, 'u1', 100::BIGINT, 'x'), ('cd', 1, 'u2', 200::BIGINT, 'y')) t(checksum, ordinal, uuid, logged_at, body)")
def log_records(spark, sf):
    return _entries(spark).select("checksum", "ordinal", "uuid", F.unix_timestamp("integrated_time").alias("logged_at"), "body")


@query("""SELECT * FROM (VALUES ('a', 2, true, 'odd', 'git+https://github.com/o/a', 'c0', 'Untrusted builder: odd|Subject digest mismatch', NULL),
  ('b', 1, true, 'odd', 'git+https://github.com/o/a', 'c0', 'Untrusted builder: odd|Subject digest mismatch', 100::BIGINT), ('c', 0, false, NULL, NULL, NULL, '', NULL), ('d', 0, false, NULL, NULL, NULL, 'No repository in the metadata', NULL),
  ('e', 0, false, NULL, NULL, NULL, 'No attestation found', NULL), ('f', 3, true, 'cached', 'repo', NULL, 'old', NULL)) t(crate, level, signature_valid, builder, source_repo, source_commit, errors, built)""")
def crate_verification(spark, sf):
    out = provenance.verified(_crates(spark), _statements(spark), _entries(spark), _cached(spark))
    return out.select("crate", "level", "signature_valid", "builder", "source_repo", "source_commit", F.array_join("errors", "|").alias("errors"), F.unix_timestamp("build_time").alias("built"))


@query("""SELECT * FROM (VALUES ('a@1.0', 'provenance/untrusted-builder', 'low'), ('b@1.0', 'provenance/untrusted-builder', 'low'), ('b@1.0', 'provenance/low-slsa-level', 'low'), ('d@1.0', 'provenance/missing-attestation', 'medium'),
  ('e@1.0', 'provenance/missing-attestation', 'medium'), ('f@1.0', 'provenance/untrusted-builder', 'low')) t(package, rule_id, severity)""")
def verification_findings(spark, sf):
    return scanner.verify(_crates(spark), _statements(spark), _entries(spark), _cached(spark)).select("package", "rule_id", "severity")


@query(f"SELECT o_orderkey AS id FROM (SELECT o_orderkey, epoch(TIMESTAMP '{_NOW}')::BIGINT - o_orderkey AS made FROM orders) WHERE epoch(TIMESTAMP '{_NOW}')::BIGINT - made <= 3600")
def fresh_checkpoints(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.timestamp_seconds(F.unix_timestamp(F.lit(_NOW).cast("timestamp")) - F.col("o_orderkey")).alias("created_at"))
    return services.fresh(rows, _NOW).select("id")


@query("SELECT c_custkey AS id FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100) WHERE c_custkey % 5 <> 0")
def repository_page(spark, sf):
    repos = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("owner"), F.col("c_custkey").alias("ordinal"))
    return services.page(repos, 150).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE NOT coalesce(CASE c_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, false)")
def active_repositories(spark, sf):
    repos = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 3 == 0, True).when(F.col("c_nationkey") % 3 == 1, False).alias("archived"))
    return services.active(repos).select("id")


@query("SELECT event_id AS id, event_id % 3 = 0 AS is_limited, greatest(event_id - 500, 0)::BIGINT AS wait_seconds FROM events")
def rate_limits(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("remaining"), F.col("event_id").alias("reset"))
    return services.rate(rows, F.lit(500)).select("id", "is_limited", "wait_seconds")


@query("SELECT * FROM (VALUES ('a', '1', 'b', '2', '^2'), ('b', '2', 'c', '3', '*')) t(from_name, from_version, to_name, to_version, requirement)")
def dependency_edges(spark, sf):
    node = "named_struct('versionKey', named_struct('name', '{}', 'version', '{}'))"
    edge = "named_struct('fromNode', {}L, 'toNode', {}L, 'requirement', '{}')"
    nodes = ", ".join(node.format(*x) for x in (("a", 1), ("b", 2), ("c", 3)))
    edges = ", ".join(edge.format(*x) for x in ((0, 1, "^2"), (1, 2, "*"), (2, 9, "?")))
    return services.dependency_edges(spark.sql(f"SELECT array({nodes}) AS nodes, array({edges}) AS edges"))


@query("SELECT ''::VARCHAR AS repo, ''::VARCHAR AS source_file, 0 AS source_line, ''::VARCHAR AS sink_file, 0 AS sink_line, ''::VARCHAR AS kind, ''::VARCHAR AS confidence FROM documents WHERE false")
def taint_flows(spark, sf):
    return review.taint_flows(spark)


@query("SELECT CASE l_linenumber % 3 WHEN 0 THEN 'ast' WHEN 1 THEN 'scan' ELSE 'vulnerability' END AS kind, count(DISTINCT l_orderkey) AS entries FROM lineitem GROUP BY 1")
def cache_stats(spark, sf):
    k = F.col("l_linenumber") % 3
    return cache.stats(table(spark, sf, "lineitem").select(F.when(k == 0, "ast").when(k == 1, "scan").otherwise("vulnerability").alias("kind"), F.col("l_orderkey").alias("key")))


@query("SELECT user_id AS key, id FROM (SELECT user_id, max(event_id) AS id FROM events GROUP BY user_id) WHERE user_id % 2 = 0 OR 10000 - id <= 100")
def cache_latest(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.timestamp_seconds("event_id").alias("created_at"), F.when(F.col("user_id") % 2 == 0, 0).otherwise(100).alias("ttl_secs"))
    return findings.unexpired(findings.latest(rows, ["key"]), "1970-01-01 02:46:40").select("key", "id")


@query("SELECT * FROM (VALUES ('a%20b', 'a b'), ('%zz+', '%zz+'), ('caf%C3', 'cafÃ'), ('', ''), ('%', '%')) t(x, decoded)")
def percent_decode(spark, sf):
    return values(spark, "('a%20b'), ('%zz+'), ('caf%C3'), (''), ('%')", "x").select("x", purl.decoded(F.col("x")).alias("decoded"))


@query("SELECT 'Vulnerable dependency: ' || p_name || ' 1.' || p_size || ' (CVE-' || p_partkey || ')' AS title FROM part")
def dependency_titles(spark, sf):
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf, "part").select(findings.vulnerable_dependency_title(F.col("p_name"), F.concat(F.lit("1."), text("p_size")), F.concat(F.lit("CVE-"), text("p_partkey"))).alias("title"))


@query("SELECT p_partkey AS id, p_size >= 10 AND p_size < 30 AS inside, p_size >= 10 AND p_size <= 20 AS until_last FROM part")
def version_range_contains(spark, sf):
    v = F.concat(F.col("p_size").cast("string"), F.lit(".0.0"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), versions.range_contains(v, F.lit("10.0.0"), F.lit("30.0.0"), F.lit("20.0.0")).alias("inside"), versions.range_contains(v, F.lit("10.0.0"), F.lit("odd"), F.lit("20.0.0")).alias("until_last"))


@query("SELECT * FROM (VALUES ('g', true), ('c', true), ('h', false)) t(id, changed)")
def nvd_changes(spark, sf):
    empty = "CAST(array() AS array<string>), CAST(NULL AS STRING), 'low', CAST(array() AS array<struct<ref_type:string,url:string>>)"
    vulns = values(spark, f"('g', array('CVE-1'), 'Osv', 2.0D, {empty}), ('c', array('CVE-1'), 'Nvd', 2.0D, {empty}), ('h', array('CVE-7'), 'Osv', 2.0D, {empty})", "id, aliases, source, cvss_score, cwes, details, severity, references")
    nvd = values(spark, "('CVE-1', 9.8D, array('CWE-1'), 'd')", "cve, base_score, nvd_cwes, description")
    before = vulns.select("id", F.struct("cvss_score", "cwes", "details", "references").alias("b"))
    after = sca.enriched(vulns, nvd).select("id", F.struct("cvss_score", "cwes", "details", "references").alias("a"))
    return before.join(after, "id").select("id", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
