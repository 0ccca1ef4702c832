"""Queries of the scan engine over the driver's tables or small literal ones, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files, purl, severity, text, versions
from ..operators import findings, provenance, sast, sca
from ..sources import manifests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({names})")


# ---------------------------------------------------------------- texts


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END::BIGINT AS lines FROM documents")
def lines_analyzed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.line_count(F.col("text")).alias("lines"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hash16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars FROM documents")
def octet_vs_char_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, sha256(text) = sha256(text) AS holds, sha256(text) = sha256('test content') AS other FROM documents")
def checksum_verify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.checksum_holds(F.col("text"), F.upper(F.sha2("text", 256))).alias("holds"), text.checksum_holds(F.col("text"), F.sha2(F.lit("test content"), 256)).alias("other"))


_ASSIGNED = r"""SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(api_key|apikey|secret|token|password|passwd|auth|credential)\s*[:=]\s*["'']([^"'']+)["'']', 2)) AS value FROM documents"""


def _assigned(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.ASSIGNMENT), 2)).alias("value"))


@query(_ASSIGNED)
def secret_assignments(spark, sf):
    return _assigned(spark, sf)


_LOOKS = r"""strlen(value) >= 8 AND NOT regexp_matches(value, '^[<\[{]') AND NOT regexp_matches(lower(value), 'none|null|true|false|undefined|n/a|changeme|replace_me|your_|example|test')
  AND regexp_matches(value, '[0-9]|[^\p{L}\p{N}]') AND (strlen(value) >= 16 OR regexp_matches(value, '[0-9]')) AND regexp_matches(value, '[\p{L}0-9]')"""


@query(f"SELECT doc_id, value, {_LOOKS} AS is_secret FROM ({_ASSIGNED})")
def looks_like_real_secret(spark, sf):
    return _assigned(spark, sf).select("doc_id", "value", text.looks_secret(F.col("value")).alias("is_secret"))


@query(f"""WITH v AS (SELECT doc_id, value, row_number() OVER () AS k FROM ({_ASSIGNED})), c AS (SELECT k, unnest(string_split(value, '')) AS ch FROM v)
SELECT doc_id, value, round((SELECT entropy(ch) FROM c WHERE c.k = v.k), 6) AS bits FROM v""")
def token_entropy(spark, sf):
    return _assigned(spark, sf).select("doc_id", "value", F.round(text.entropy(F.col("value")), 6).alias("bits"))


_IS_TEST = "regexp_matches(lower(path), '/test/|/tests/|/__tests__/|/fixtures/|/test_') OR regexp_matches(lower(path), '(_test\\.py|_test\\.go|\\.test\\.js|\\.test\\.ts|\\.spec\\.js|\\.spec\\.ts|_spec\\.rb|_test\\.rs)$')"


@query(f"""SELECT doc_id, path, value FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'src/tests/' ELSE 'src/' END || doc_id || '.py' AS path, value FROM ({_ASSIGNED})) WHERE NOT ({_IS_TEST}) AND {_LOOKS}""")
def secret_scan(spark, sf):
    rows = _assigned(spark, sf).select("doc_id", F.concat(F.when(F.col("doc_id") % 5 == 0, "src/tests/").otherwise("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "value")
    return rows.where(~files.is_test(F.col("path")) & text.looks_secret(F.col("value")))


@query("SELECT doc_id, n, l AS text FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE n BETWEEN 2 AND 8")
def snippet_window(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(text.snippet(F.col("text"), F.lit(5))).alias("s")).select("doc_id", F.col("s.n").cast("long").alias("n"), "s.text")


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?s)<script[^>]*>.*?</script>'))::BIGINT AS scripts FROM pages")
def inline_script_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(?s)<script[^>]*>.*?</script>"), 0)).cast("long").alias("scripts"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ---------------------------------------------------------------- severities, findings and reports

_SEVERITY = "CASE WHEN value IS NULL OR isnan(value) THEN 'unknown' WHEN value >= 9 THEN 'critical' WHEN value >= 7 THEN 'high' WHEN value >= 4 THEN 'medium' WHEN value > 0 THEN 'low' WHEN value = 0 THEN 'none' ELSE 'unknown' END"
_FOUND = f"(SELECT event_id AS ordinal, event_type AS rule_id, user_id AS repo, {_SEVERITY} AS severity FROM (SELECT event_id, event_type, user_id, value / 40 - 0.25 AS value FROM events))"
_RANK = "list_position(['unknown','none','low','medium','high','critical'], severity) - 1"


def _found(spark, sf):
    v = F.col("value") / 40 - 0.25
    return table(spark, sf, "events").select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("rule_id"), F.col("user_id").alias("repo"), severity.from_cvss(v).alias("severity"))


@query(f"SELECT event_id, {_SEVERITY} AS severity FROM events UNION ALL SELECT * FROM (VALUES (-1, 'unknown'), (-2, 'unknown'), (-3, 'none'))")
def severity_from_cvss(spark, sf):
    odd = values(spark, "(-1L, double('NaN')), (-2L, -1.0D), (-3L, 0.0D)", "event_id, value")
    return table(spark, sf, "events").select("event_id", "value").unionByName(odd).select("event_id", severity.from_cvss(F.col("value")).alias("severity"))


@query(f"SELECT * FROM {_FOUND} WHERE {_RANK} >= 3")
def min_severity_filter(spark, sf):
    return _found(spark, sf).where(severity.at_least(F.col("severity"), "medium"))


@query(f"SELECT repo, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM {_FOUND} GROUP BY repo")
def severity_summary(spark, sf):
    return findings.summary(_found(spark, sf), ["repo"])


@query(f"SELECT repo, arg_max(severity, {_RANK}) AS max_severity FROM {_FOUND} GROUP BY repo")
def max_severity(spark, sf):
    return findings.greatest(_found(spark, sf), ["repo"])


@query(f"SELECT * FROM {_FOUND} ORDER BY {_RANK} DESC, ordinal LIMIT 20")
def top_findings(spark, sf):
    return findings.top(_found(spark, sf), 20)


@query("SELECT count(*) FILTER (event_type = 'click') AS sast_findings, count(*) FILTER (event_type = 'view') AS sca_findings, count(*) FILTER (event_type NOT IN ('click', 'view')) AS secret_findings FROM events")
def stats_by_category(spark, sf):
    c = F.when(F.col("event_type") == "click", "sast").when(F.col("event_type") == "view", "sca").otherwise("secret")
    return findings.stats(table(spark, sf, "events").select(c.alias("category")))


@query("SELECT source AS repo, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def multi_repo_rollup(spark, sf):
    return findings.rollup(table(spark, sf, "documents").select(F.col("source").alias("repo"), F.lit(1).alias("files"), F.col("n_chars").alias("chars")))


@query("SELECT 0 AS phase, event_id AS id FROM events UNION ALL SELECT 1, doc_id FROM documents UNION ALL SELECT 2, page_id FROM pages")
def findings_union(spark, sf):
    return findings.union({p: table(spark, sf, t).select(F.col(c).alias("id")) for p, t, c in (("sast", "events", "event_id"), ("secret", "documents", "doc_id"), ("sca", "pages", "page_id"))})


@query(f"SELECT rule_id, ordinal, repo, severity FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ordinal) AS r FROM {_FOUND}) WHERE r = 1")
def sarif_rules(spark, sf):
    return findings.first_of_rule(_found(spark, sf))


@query(f"SELECT ordinal, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' WHEN severity = 'low' THEN 'note' ELSE 'none' END AS level, CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 8.0 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 3.0 ELSE 0.0 END::DOUBLE AS score FROM {_FOUND}")
def sarif_level_score(spark, sf):
    return _found(spark, sf).select("ordinal", severity.level(F.col("severity")).alias("level"), severity.score(F.col("severity")).cast("double").alias("score"))


@query(f"SELECT repo, bool_or({_RANK} >= 4) AS failed FROM {_FOUND} GROUP BY repo")
def exit_status(spark, sf):
    return _found(spark, sf).groupBy("repo").agg(F.bool_or(severity.at_least(F.col("severity"), "high")).alias("failed"))


_RULE_IDS = "('rust/unsafe-block'), ('rust/command-injection'), ('js/innerhtml'), ('go/path-traversal'), ('go/weak-random'), ('python/hardcoded-password'), ('go/hardcoded-cred'), ('python/tempfile-mktemp'), ('js/regex-dos'), ('rust/raw-pointer-deref'), ('rust/unwrap-panic'), ('go/defer-in-loop'), ('js/prototype-pollution'), ('js/eval')"


@query(f"""SELECT id, CASE WHEN contains(id, 'unsafe') THEN 'unsafe-code' WHEN regexp_matches(id, 'injection|sql|cmd') THEN 'injection' WHEN regexp_matches(id, 'xss|innerhtml|document-write') THEN 'xss' WHEN regexp_matches(id, 'path|traversal') THEN 'path-traversal'
  WHEN regexp_matches(id, 'crypto|weak') THEN 'crypto' WHEN regexp_matches(id, 'auth|password|secret') THEN 'auth' WHEN regexp_matches(id, 'race|toctou|mktemp') THEN 'race-condition' WHEN regexp_matches(id, 'dos|timeout') THEN 'dos'
  WHEN regexp_matches(id, 'memory|transmute|pointer|panic|refcell') THEN 'memory-safety' WHEN regexp_matches(id, 'unbounded|defer-in-loop') THEN 'unbounded-resource' WHEN regexp_matches(id, 'prototype|pollution') THEN 'prototype-pollution' ELSE 'other' END AS category FROM (VALUES {_RULE_IDS}) t(id)""")
def categorize_rule(spark, sf):
    return values(spark, _RULE_IDS, "id").select("id", severity.category(F.col("id")).alias("category"))


_CONF = "(1, 'critical', 'eval(x)', 'python', ''), (2, 'low', 'unwrap()', 'rust', ''), (3, 'high', 'latest(x)', 'js', ''), (4, 'medium', '*ptr', 'rust', '// SAFETY: checked'), (5, 'medium', '*ptr', 'go', '// SAFETY: checked'), (6, 'high', 'Mock', 'go', '')"


@query(f"SELECT id, CASE WHEN regexp_matches(code, 'test|mock|example') OR (lang = 'rust' AND regexp_matches(pre, '// SAFETY:|// safety:')) THEN 'low' WHEN sev IN ('critical', 'high') THEN 'high' ELSE 'medium' END AS confidence FROM (VALUES {_CONF}) t(id, sev, code, lang, pre)")
def confidence_ladder(spark, sf):
    return values(spark, _CONF, "id, sev, code, lang, pre").select("id", severity.confidence(F.col("sev"), F.col("code"), F.col("lang"), F.col("pre")).alias("confidence"))


# ---------------------------------------------------------------- versions, packages and advisories

_PARTS = "(p_partkey % 7) || '.' || (p_partkey % 13) || CASE WHEN p_partkey % 3 = 0 THEN '.' || (p_partkey % 5) ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '-beta' || (p_partkey % 3) ELSE '' END"


def _part_version(parts: int = 0):
    s = lambda n: (F.col("p_partkey") % n).cast("string")
    if parts:
        return F.concat(s(7), F.lit("."), s(13), F.lit("."), s(5), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("-beta."), s(3))).otherwise(""))
    return F.concat(s(7), F.lit("."), s(13), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), s(5))).otherwise(""), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("-beta"), s(3))).otherwise(""))


def _duck_key(v: str) -> str:
    return f"list_transform(regexp_extract_all({v}, '[0-9]+|[^0-9.\\-_+]+'), lambda x: {{'k': CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 1 ELSE 0 END, 'n': coalesce(TRY_CAST(x AS HUGEINT), 0), 's': CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '' ELSE x END}})"


@query(f"""SELECT p_partkey, v, {_duck_key('v')} >= {_duck_key("'1.5'")} AND {_duck_key('v')} < {_duck_key("'4.2-beta1'")} AS hit FROM (SELECT p_partkey, {_PARTS} AS v FROM part)""")
def version_fallback_range(spark, sf):
    v = table(spark, sf, "part").select("p_partkey", _part_version().alias("v"))
    return v.select("p_partkey", "v", versions.in_range(F.lit("maven"), F.col("v"), F.lit("1.5"), F.lit("4.2-beta1"), F.lit(None).cast("string")).alias("hit"))


@query("""WITH v AS (SELECT p_partkey, p_partkey % 7 AS a, p_partkey % 13 AS b, p_partkey % 5 AS c, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 3 END AS pre FROM part)
SELECT p_partkey, (a, b, c) >= (1, 5, 0) AND NOT ((a, b, c) = (1, 5, 0) AND pre IS NOT NULL) AND ((a, b, c) < (4, 2, 0) OR ((a, b, c) = (4, 2, 0) AND pre IS NOT NULL AND pre < 1)) AS hit FROM v""")
def version_in_range_semver(spark, sf):
    v = table(spark, sf, "part").select("p_partkey", _part_version(3).alias("v"))
    return v.select("p_partkey", versions.in_range(F.lit("npm"), F.col("v"), F.lit("1.5.0"), F.lit("4.2.0-beta.1"), F.lit(None).cast("string")).alias("hit"))


_RANGE_CASES = "('npm','1.5.0','1.0.0','2.0.0',NULL), ('npm','0.9.0','1.0.0','2.0.0',NULL), ('npm','2.0.0','1.0.0','2.0.0',NULL), ('npm','1.0.0-beta.1','1.0.0-alpha.1','1.0.0',NULL), ('pypi','2.0.0','1.0.0','3.0.0',NULL), ('pypi','1.0a1','1.0a0','1.0',NULL), ('pypi','1.0.post1','1.0','1.1',NULL), ('cargo','1.0.0-alpha.2','1.0.0-alpha.1','1.0.0',NULL), ('go','v1.5.0','v1.0.0','2.0.0',NULL), ('go','1.5.0','v1.0.0','2.0.0',NULL), ('unknown','2.10.0','2.9.0','2.11.0',NULL), ('unknown','2.8.0','2.9.0',NULL,NULL), ('npm','5.0.0','1.0.0','garbage','2.0.0')"


@query("SELECT * FROM (VALUES ('npm','1.5.0',true), ('npm','0.9.0',false), ('npm','2.0.0',false), ('npm','1.0.0-beta.1',true), ('pypi','2.0.0',true), ('pypi','1.0a1',true), ('pypi','1.0.post1',true), ('cargo','1.0.0-alpha.2',true), ('go','v1.5.0',true), ('go','1.5.0',true), ('unknown','2.10.0',true), ('unknown','2.8.0',false), ('npm','5.0.0',true)) t(eco, v, hit)")
def version_in_range_cases(spark, sf):
    t = values(spark, _RANGE_CASES, "eco, v, i, f, l")
    return t.select("eco", "v", versions.in_range(*[F.col(c).cast("string") for c in ("eco", "v", "i", "f", "l")]).alias("hit"))


RANGES = [("npm", "1.2.3", "^1.0.0", True), ("npm", "2.0.0", "^1.0.0", False), ("npm", "1.2.5", "~1.2.0", True), ("npm", "1.3.0", "~1.2.0", False), ("npm", "1.5.0", "1.0.0 - 2.0.0", True), ("pypi", "1.4.2", "~=1.4.0", True), ("pypi", "1.5.0", "~=1.4.0", False), ("pypi", "1.0", "==1.0", True), ("pypi", "1.0.0", "==1.0.*", True), ("pypi", "1.5.0", ">=1.0,<2.0", True), ("pypi", "2.0.0", ">=1.0,<2.0", False), ("cargo", "1.2.3", "^1.0", True), ("cargo", "2.0.0", "^1.0", False), ("cargo", "1.0.0", "=1.0.0", True), ("cargo", "1.0.1", "=1.0.0", False), ("cargo", "1.2.3", "1.*", True), ("cargo", "2.0.0", "1.*", False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{v}', '{r}', {str(x).lower()})" for e, v, r, x in RANGES) + ") t(eco, v, r, ok)")
def version_satisfies(spark, sf):
    out = None
    for e, v, r, _ in RANGES:
        row = spark.range(1).select(F.lit(e).alias("eco"), F.lit(v).alias("v"), F.lit(r).alias("r"), versions.satisfies(e, F.lit(v), r).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


_ADV = "('A-1', 'Brand#11', '1.0', '3.0'), ('A-2', 'Brand#12', NULL, '2.5'), ('A-3', 'Brand#13', '2.0', NULL), ('A-4', 'Brand#11', '5.0', '6.1')"


@query(f"""SELECT p_partkey, id FROM (SELECT p_partkey, p_brand, {_PARTS} AS v FROM part) JOIN (VALUES {_ADV}) a(id, brand, i, f) ON brand = p_brand
WHERE (i IS NULL OR {_duck_key('v')} >= {_duck_key('i')}) AND (f IS NULL OR {_duck_key('v')} < {_duck_key('f')})""")
def sca_range_join(spark, sf):
    deps = table(spark, sf, "part").select("p_partkey", F.lit("Maven").alias("ecosystem"), F.col("p_brand").alias("name"), _part_version().alias("version"))
    known = values(spark, _ADV, "id, package, i, f").select("id", F.lit("Maven").alias("ecosystem"), "package", F.array(F.struct(F.col("i").cast("string").alias("introduced"), F.col("f").cast("string").alias("fixed"), F.lit(None).cast("string").alias("last_affected"))).alias("affected_versions"))
    return sca.affected(deps, known).select("p_partkey", "id")


@query("SELECT user_id, event_id AS introduced, fixed FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS fixed FROM events) WHERE fixed IS NOT NULL")
def osv_event_windows(spark, sf):
    ids = F.sort_array(F.collect_list("event_id"))
    events = F.transform(ids, lambda x: F.struct(x.cast("string").alias("introduced"), x.cast("string").alias("fixed"), F.lit(None).cast("string").alias("last_affected")))
    out = table(spark, sf, "events").groupBy("user_id").agg(events.alias("e")).select("user_id", F.explode(sca.event_ranges(F.col("e"))).alias("r"))
    return out.select("user_id", F.col("r.introduced").cast("long").alias("introduced"), F.col("r.fixed").cast("long").alias("fixed"))


_OSV = """('{"id":"GHSA-1","summary":"s","severity":[{"type":"CVSS_V3","score":"9.8"}],"affected":[{"package":{"name":"lodash","ecosystem":"npm"},"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"1.2"}]}]}]}'), ('{"id":"GHSA-2","severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"}],"affected":[{"ranges":[{"type":"SEMVER","events":[{"introduced":"0"}]}]}]}'), ('{"id":"GHSA-3"}')"""


@query("SELECT * FROM (VALUES ('GHSA-1', 'critical', 9.8::DOUBLE, 'lodash', 's', '1.2', 1), ('GHSA-2', 'unknown', NULL, 'unknown', 'No description available', NULL, 0), ('GHSA-3', 'unknown', NULL, 'unknown', 'No description available', NULL, 0)) t(id, severity, cvss_score, package, summary, fixed_version, n_ranges)")
def osv_convert(spark, sf):
    out = sca.advisories(values(spark, _OSV, "json"))
    return out.select("id", "severity", "cvss_score", "package", "summary", "fixed_version", F.greatest(F.size("affected_versions"), F.lit(0)).alias("n_ranges"))


@query("SELECT * FROM (VALUES ('V-1', 'CVE-2024-1', 9.8::DOUBLE, 'critical', 1, 'CWE-89'), ('V-2', NULL, 5.0::DOUBLE, 'medium', 0, ''), ('CVE-2024-2', 'CVE-2024-2', 7.0::DOUBLE, 'high', 0, '')) t(id, cve, cvss_score, severity, n_references, cwes)")
def nvd_enrich(spark, sf):
    vulns = values(spark, "('V-1', array('CVE-2024-1'), 'Osv', CAST(NULL AS DOUBLE), 'unknown'), ('V-2', array('GHSA-9'), 'Osv', 5.0D, 'medium'), ('CVE-2024-2', array('X'), 'Nvd', 7.0D, 'high')", "id, aliases, source, cvss_score, severity")
    vulns = vulns.withColumn("cwes", F.array().cast("array<string>")).withColumn("details", F.lit(None).cast("string")).withColumn("references", F.array().cast("array<struct<ref_type:string,url:string>>"))
    nvd = values(spark, "('CVE-2024-1', 9.8D, array('CWE-89'), 'd')", "cve, base_score, nvd_cwes, description")
    out = sca.enriched(vulns, nvd)
    return out.select("id", sca.first_cve(F.col("id"), F.col("aliases")).alias("cve"), "cvss_score", "severity", F.size("references").alias("n_references"), F.array_join("cwes", ",").alias("cwes"))


_NVD = "metrics struct<cvssMetricV31:array<struct<cvssData:struct<version:string,baseScore:double>>>,cvssMetricV30:array<struct<cvssData:struct<version:string,baseScore:double>>>>, weaknesses array<struct<description:array<struct<lang:string,value:string>>>>"


@query("SELECT * FROM (VALUES (1, '3.1', 9.8::DOUBLE, 'CWE-89'), (2, '3.0', 6.1::DOUBLE, ''), (3, NULL, NULL, NULL)) t(id, version, score, cwes)")
def nvd_cvss_extract(spark, sf):
    rows = values(spark, """(1, '{"metrics":{"cvssMetricV31":[{"cvssData":{"version":"3.1","baseScore":9.8}}],"cvssMetricV30":[{"cvssData":{"version":"3.0","baseScore":1.0}}]},"weaknesses":[{"description":[{"lang":"en","value":"CWE-89"},{"lang":"es","value":"CWE-1"},{"lang":"en","value":"NVD-noinfo"}]}]}'), (2, '{"metrics":{"cvssMetricV30":[{"cvssData":{"version":"3.0","baseScore":6.1}}]},"weaknesses":[]}'), (3, '{}')""", "id, j")
    d = rows.select("id", F.from_json("j", _NVD).alias("d"))
    return d.select("id", sca.cvss(F.col("d.metrics"))["cvssData"]["version"].alias("version"), sca.cvss(F.col("d.metrics"))["cvssData"]["baseScore"].alias("score"), F.array_join(sca.cwes(F.col("d.weaknesses")), ",").alias("cwes"))


@query("SELECT * FROM (VALUES ('lodash', 'GHSA-1'), ('lodash', 'GHSA-2')) t(name, advisory)")
def depsdev_advisories(spark, sf):
    deps = values(spark, "('npm', 'lodash', '1.0'), ('npm', 'left-pad', '1.0')", "system, name, version")
    known = values(spark, "('npm', 'lodash', '1.0', array('GHSA-1', 'GHSA-2'))", "system, name, version, keys")
    return deps.join(known, ["system", "name", "version"]).select("name", F.explode("keys").alias("advisory"))


_PURLS = "('pkg:cargo/serde@1.0.193'), ('pkg:npm/@types/node@20.10.0'), ('pkg:npm/lodash@4.17.21'), ('pkg:golang/github.com/gin-gonic/gin@1.9.1'), ('pkg:npm/lodash@4.17.21?vcs_url=git://github.com&x'), ('npm/lodash'), ('pkg:maven/a@1'), ('pkg:maven/org.x/a%20b@1')"


@query("SELECT * FROM (VALUES ('pkg:cargo/serde@1.0.193','cargo',NULL,'serde','1.0.193',0), ('pkg:npm/@types/node@20.10.0','npm','@types','node','20.10.0',0), ('pkg:npm/lodash@4.17.21','npm',NULL,'lodash','4.17.21',0), ('pkg:golang/github.com/gin-gonic/gin@1.9.1','golang','github.com','github.com/gin-gonic/gin','1.9.1',0), ('pkg:npm/lodash@4.17.21?vcs_url=git://github.com&x','npm',NULL,'lodash','4.17.21',1), ('npm/lodash',NULL,NULL,NULL,NULL,NULL), ('pkg:maven/a@1',NULL,NULL,NULL,NULL,NULL), ('pkg:maven/org.x/a%20b@1','maven','org.x','a b','1',0)) t(purl, type, namespace, name, version, n_qualifiers)")
def purl_parse(spark, sf):
    out = values(spark, _PURLS, "purl").select("purl", purl.parse(F.col("purl")).alias("p"))
    return out.select("purl", "p.type", "p.namespace", "p.name", "p.version", F.when(F.col("p").isNotNull(), F.size("p.qualifiers")).alias("n_qualifiers"))


@query("SELECT 'pkg:npm/' || CASE WHEN p_partkey % 2 = 0 THEN '%40scope/' ELSE '' END || replace(p_name, ' ', '%20') || '@' || (p_partkey % 7) || '.0.0' AS purl FROM part")
def purl_build(spark, sf):
    p = table(spark, sf, "part")
    return p.select(purl.build(F.lit("npm"), F.when(F.col("p_partkey") % 2 == 0, "@scope"), F.col("p_name"), F.concat((F.col("p_partkey") % 7).cast("string"), F.lit(".0.0"))).alias("purl"))


@query("SELECT * FROM (VALUES ('cargo','Cargo','crates.io'), ('npm','Npm','npm'), ('pypi','PyPI','PyPI'), ('golang','Go','Go'), ('go','Go','Go'), ('maven','Maven','Maven'), ('zig','Unknown','zig')) t(type, ecosystem, advisory)")
def ecosystem_map(spark, sf):
    return values(spark, "('cargo'), ('npm'), ('pypi'), ('golang'), ('go'), ('maven'), ('zig')", "type").select("type", purl.ecosystem(F.col("type")).alias("ecosystem"), purl.advisory_ecosystem(F.col("type")).alias("advisory"))


# ---------------------------------------------------------------- manifests


@query("SELECT * FROM (VALUES ('requests','2.31.0'), ('django','4.0'), ('a','1')) t(name, version)")
def parse_requirements(spark, sf):
    return manifests.requirements(values(spark, r"('r', 'requests==2.31.0\ndjango>=3.0,<4.0\nflask\n# c\na[x]>=1\n')", "path, content")).select("name", "version")


@query("SELECT * FROM (VALUES ('a','1.2.3'), ('b',' 1.0'), ('c','2')) t(name, version)")
def parse_package_json(spark, sf):
    return manifests.package_json(values(spark, """('p', '{"dependencies":{"a":"^1.2.3","b":">= 1.0"},"devDependencies":{"c":"~2"}}')""", "path, content")).select("name", "version")


@query("SELECT * FROM (VALUES ('m','1.0.0'), ('n','0.2.0')) t(name, version)")
def parse_go_sum(spark, sf):
    return manifests.go_sum(values(spark, r"('g', 'm v1.0.0 h1:x\nm v1.0.0/go.mod h1:y\nn v0.2.0 h1:z\nbad\n')", "path, content")).select("name", "version")


@query("SELECT * FROM (VALUES ('serde','1.0.193'), ('app','0.1.0')) t(name, version)")
def parse_cargo_lock(spark, sf):
    lock = values(spark, r"""('c', '[[package]]\nname = "serde"\nversion = "1.0.193"\n\n[[package]]\nname = "app"\nversion = "0.1.0"\ndependencies = ["serde"]\n')""", "path, content")
    return manifests.cargo_lock(lock).where("error is null").select("name", "version")


@query("SELECT * FROM (VALUES ('Cargo','serde','1.0.193'), ('PyPI','requests','2.31.0'), ('Go','m','1.0.0')) t(ecosystem, name, version)")
def manifest_union(spark, sf):
    files_ = values(spark, r"""('Cargo.lock', '[[package]]\nname = "serde"\nversion = "1.0.193"\n'), ('requirements.txt', 'requests==2.31.0'), ('go.sum', 'm v1.0.0 h1:x'), ('sub/go.sum', 'k v1.0.0 h1:x')""", "path, content")
    return manifests.dependencies(files_).select("ecosystem", "name", "version")


# ---------------------------------------------------------------- repositories and files

_URLS = "('https://github.com/tokio-rs/tokio'), ('https://github.com/serde-rs/serde.git'), ('git@github.com:rust-lang/rust.git'), ('owner/repo'), ('plain'), ('https://github.com/a/b/')"


@query("SELECT * FROM (VALUES ('https://github.com/tokio-rs/tokio','tokio-rs','tokio'), ('https://github.com/serde-rs/serde.git','serde-rs','serde'), ('git@github.com:rust-lang/rust.git','rust-lang','rust'), ('owner/repo','owner','repo'), ('plain',NULL,NULL), ('https://github.com/a/b/','a','b')) t(url, owner, name)")
def repo_from_url(spark, sf):
    return values(spark, _URLS, "url").select("url", files.repository(F.col("url"))["owner"].alias("owner"), files.repository(F.col("url"))["name"].alias("name"))


@query("SELECT * FROM (VALUES ('owner/repo','repository','owner/repo'), ('org:myorg','organization','myorg'), ('user:myuser','user','myuser'), ('org:a/b','repository','org:a/b'), ('here','local','here'), ('words to find','search','words to find')) t(target, kind, value)")
def scan_target_parse(spark, sf):
    t = values(spark, "('owner/repo', false), ('org:myorg', false), ('user:myuser', false), ('org:a/b', false), ('here', true), ('words to find', false)", "target, there")
    return t.select("target", files.target(F.col("target"), F.col("there"))["kind"].alias("kind"), files.target(F.col("target"), F.col("there"))["value"].alias("value"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def url_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


_PATHS = "('src/main.rs'), ('src/tests/a.py'), ('tests/x.go'), ('a/b_test.go'), ('web/App.TSX'), ('node_modules/x/y.js'), ('target'), ('lib/x.spec.ts'), ('a.jsx'), ('src/target/x.rs'), ('x.hpp')"
_P = f"(VALUES {_PATHS}) t(path)"


@query(f"SELECT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'hpp' THEN 'cpp' ELSE 'unknown' END AS language FROM {_P}")
def language_detect(spark, sf):
    return values(spark, _PATHS, "path").select("path", files.language(F.col("path")).alias("language"))


@query(f"SELECT path FROM {_P} WHERE NOT regexp_matches(path, '(^|/)(target|node_modules|vendor|dist|build|\\.git)/')")
def ignore_filter(spark, sf):
    return values(spark, _PATHS, "path").where(~files.is_ignored(F.col("path")))


@query(f"SELECT path, {_IS_TEST} AS is_test FROM {_P}")
def test_file_predicate(spark, sf):
    return values(spark, _PATHS, "path").select("path", files.is_test(F.col("path")).alias("is_test"))


# ---------------------------------------------------------------- joins of caches and changes


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_tiles_anti(spark, sf):
    return provenance.missing(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def changed_files_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_anti(spark, sf):
    return provenance.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])


@query("""SELECT coalesce(o.source, n.source) AS repo, bool_and(o.h IS NOT DISTINCT FROM n.h) AS valid FROM (SELECT source, doc_id, sha256(text) AS h FROM documents) o
FULL JOIN (SELECT source, doc_id, sha256(CASE WHEN doc_id % 97 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 101 <> 1) n ON o.doc_id = n.doc_id AND o.source = n.source GROUP BY 1""")
def cache_validity(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), "text")
    old = d.select("repo", "path", F.sha2("text", 256).alias("hash"))
    new = d.where(F.col("path") % 101 != 1).select("repo", "path", F.sha2(F.when(F.col("path") % 97 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return findings.cache_verdict(old, new, ["repo"])


# ---------------------------------------------------------------- provenance

_ATTESTED = "SELECT o_custkey AS package, o_orderkey AS ordinal, (o_orderkey % 4)::INT AS level, o_orderkey % 2 = 0 AS signature_valid, CASE WHEN o_orderkey % 3 = 0 THEN 'https://github.com/actions/runner/x' WHEN o_orderkey % 3 = 1 THEN 'other' END AS builder, CASE WHEN o_orderkey % 5 = 0 THEN 'e' || o_orderkey END AS error FROM orders"
_FOLD = f"SELECT package, max(level) AS level, bool_or(signature_valid) AS signature_valid, arg_max(builder, ordinal) FILTER (builder IS NOT NULL) AS builder, count(error) AS n_errors FROM ({_ATTESTED}) GROUP BY package"


def _attested(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("package"), k.alias("ordinal"), (k % 4).cast("int").alias("level"), (k % 2 == 0).alias("signature_valid"), F.when(k % 3 == 0, "https://github.com/actions/runner/x").when(k % 3 == 1, "other").alias("builder"),
        F.lit(None).cast("string").alias("source_repo"), F.when(k % 5 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("error"),
    )


@query(_FOLD)
def slsa_level(spark, sf):
    return provenance.folded(_attested(spark, sf)).select("package", "level", "signature_valid", "builder", F.size("errors").cast("long").alias("n_errors"))


@query(f"""WITH v AS ({_FOLD})
SELECT package, 'provenance/missing-attestation' AS rule_id, 'medium' AS severity, 'high' AS confidence FROM v WHERE builder IS NULL AND n_errors > 0
UNION ALL SELECT package, 'provenance/untrusted-builder', 'low', 'medium' FROM v WHERE builder IS NOT NULL AND NOT contains(builder, 'https://github.com/actions/runner')
UNION ALL SELECT package, 'provenance/low-slsa-level', 'low', 'high' FROM v WHERE builder IS NOT NULL AND level < 2
UNION ALL SELECT package, 'provenance/invalid-signature', 'high', 'high' FROM v WHERE builder IS NOT NULL AND NOT signature_valid""")
def provenance_findings(spark, sf):
    return provenance.findings(provenance.folded(_attested(spark, sf)))


@query("SELECT user_id AS checksum, event_id AS ordinal FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 5")
def rekor_entries(spark, sf):
    return provenance.log_entries(table(spark, sf, "events").select(F.col("user_id").alias("checksum"), F.col("event_id").alias("ordinal")))


@query("SELECT o_custkey AS package, o_orderkey AS id FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4) AS r FROM orders) WHERE r = 1")
def attestation_priority(spark, sf):
    return provenance.preferred(table(spark, sf, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("priority"))).select("package", "id")


# ---------------------------------------------------------------- models' replies

_REPLIES = """('a', 'Sure:\n```json\n{"vulnerabilities":[{"type":"SQL Injection","severity":"High","description":"d","line":3,"confidence":"high","remediation":"bind"}]}\n```\nDone'), ('b', 'x [{"type":"Xss","severity":"odd","description":"e"}] y'), ('c', 'nothing'), ('d', '```\n{"vulnerabilities":[]}\n```')"""


@query("""SELECT * FROM (VALUES ('a', '{"vulnerabilities":[{"type":"SQL Injection","severity":"High","description":"d","line":3,"confidence":"high","remediation":"bind"}]}'), ('b', '[{"type":"Xss","severity":"odd","description":"e"}]'), ('c', 'nothing'), ('d', '{"vulnerabilities":[]}')) t(path, j)""")
def llm_json_extract(spark, sf):
    return values(spark, _REPLIES, "path, content").select("path", text.model_json(F.col("content")).alias("j"))


@query("SELECT * FROM (VALUES ('a', 'ai-sql-injection', 'high', 3, 'high', 'bind'), ('b', 'ai-xss', 'unknown', 1, 'medium', NULL)) t(path, rule_id, severity, line, confidence, remediation)")
def llm_findings(spark, sf):
    return findings.model_findings(values(spark, _REPLIES, "path, content")).select("path", "rule_id", "severity", "line", "confidence", "remediation")


@query("SELECT conv_id, turn, contains(p, 'File: c.py') AS named, strlen(p) > strlen(text) AS longer FROM (SELECT conv_id, turn, text, 'File: c.py' || text AS p FROM conversations)")
def llm_prompt(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", text.prompt(F.lit("Python"), F.lit("c.py"), F.lit(None).cast("string"), F.col("text")).alias("p"))
    return c.select("conv_id", "turn", F.contains("p", F.lit("File: c.py")).alias("named"), (F.octet_length("p") > F.octet_length("text")).alias("longer"))


# ---------------------------------------------------------------- syntax rules


def _sast(spark, language: str, code: str) -> DataFrame:
    files_ = spark.createDataFrame([("r", "f", language, code)], "repo string, path string, language string, content string")
    return sast.scanned(files_).select("rule_id", "severity", "confidence", "cwe", "start_line", "start_column")


def _expected(*rows: tuple) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(str(r) for r in rows) + ") t(rule_id, severity, confidence, cwe, start_line, start_column)"


@query(_expected(("python/exec-eval", "critical", "high", "CWE-95", 1, 1), ("python/requests-no-timeout", "medium", "medium", "CWE-400", 2, 5), ("python/debug-true", "medium", "medium", "CWE-489", 3, 1)))
def sast_py(spark, sf):
    return _sast(spark, "python", "eval(x)\nr = requests.get(u)\nDEBUG = True\n")


@query(_expected(("js/innerhtml", "high", "high", "CWE-79", 1, 1), ("js/sql-concat", "critical", "high", "CWE-89", 2, 1), ("js/regex-dos", "medium", "medium", "CWE-1333", 3, 11)))
def sast_js(spark, sf):
    return _sast(spark, "javascript", 'el.innerHTML = x;\ndb.query("SELECT " + a);\nconst r = /(a+)b+/;\n')


@query(_expected(("go/unhandled-error", "low", "medium", "CWE-755", 1, 1), ("go/defer-in-loop", "medium", "medium", "CWE-770", 2, 1), ("go/tls-insecure", "high", "high", "CWE-295", 5, 18)))
def sast_go(spark, sf):
    return _sast(spark, "go", "_ = f()\nfor i := 0; i < 3; i++ {\n\tdefer g()\n}\nc := &tls.Config{InsecureSkipVerify: true}\n")


@query(_expected(("rust/unsafe-block", "medium", "low", "CWE-416", 2, 1), ("rust/raw-pointer-deref", "high", "low", "CWE-476", 2, 10), ("rust/unwrap-panic", "low", "low", "CWE-755", 3, 1)))
def sast_rust(spark, sf):
    return _sast(spark, "rust", "// SAFETY: checked\nunsafe { *ptr = 1; }\nx.unwrap();\n")


@query("SELECT split_part(id, '/', 1) AS language, count(*) AS n FROM (VALUES ('rust/', 15), ('python/', 12), ('js/', 12), ('go/', 11)) t(id, k), range(15) r(i) WHERE i < k GROUP BY 1")
def sast_rules(spark, sf):
    return sast.rules(spark).groupBy("language").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- the scan


_SUMMARY = f"""SELECT d.source AS repo, count(*) AS files, sum(CASE WHEN d.text = '' THEN 0 ELSE len(string_split(regexp_replace(d.text, '\\n$', ''), chr(10))) END)::BIGINT AS lines, coalesce(sum(s.n), 0)::BIGINT AS secrets
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_ASSIGNED}) WHERE {_LOOKS} GROUP BY doc_id) s USING (doc_id) GROUP BY d.source"""


@query(_SUMMARY)
def scan_summary(spark, sf):
    """Documents as files, sources as repositories: files, lines and hard-coded secrets of each, in one scan and one shuffle."""
    d = table(spark, sf, "documents")
    found = F.size(F.filter(F.regexp_extract_all("text", F.lit(text.ASSIGNMENT), 2), text.looks_secret))
    return d.groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("files"), F.sum(text.line_count(F.col("text"))).alias("lines"), F.sum(found).cast("long").alias("secrets"))
