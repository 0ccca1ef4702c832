"""Queries over whole scans: all streams of findings, reports of them, all rules of the syntax scan; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files, purl, text
from ..operators import cache, findings, review, sast
from ..sources import syntax
from . import scanner
from .catalogue import query, table, values

# ---------------------------------------------------------------- made repositories: customers are files of 20 repositories

_LINES = [("k % 3 = 0", "eval(x)", "pass"), ("k % 4 = 0", "DEBUG = True", "y = 1"), ("k % 5 = 0", 'password = "hunter2hunter2"', "z = 2"), ("k % 6 = 0", "r = requests.get(u)", "w = 3")]
_CODE = " || chr(10) || ".join(f"CASE WHEN {when} THEN '{yes}' ELSE '{no}' END" for when, yes, no in _LINES)
#: path, by customer: source, a test, an ignored folder, an unknown language
_PATH = "CASE k % 7 WHEN 0 THEN 'src/tests/f' || k || '.py' WHEN 1 THEN 'vendor/f' || k || '.py' WHEN 2 THEN 'notes/f' || k || '.txt' ELSE 'src/f' || k || '.py' END"


def made_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS k").selectExpr("'r' || k % 20 AS repo", f"{_PATH} AS path", f"{_CODE} AS content".replace("chr(10)", "char(10)"))
    manifests = spark.range(20).selectExpr("'r' || id AS repo", "explode(map('requirements.txt', 'requests==2.' || id || '.0' || char(10), 'sub/requirements.txt', 'flask==1.' || id || '.0' || char(10))) AS (path, content)")
    return rows.unionByName(manifests)


def _advisories(spark: SparkSession) -> DataFrame:
    window = "array(named_struct('introduced', '{}', 'fixed', '{}', 'last_affected', CAST(NULL AS STRING)))"
    return spark.sql(f"SELECT 'A-1' AS id, 'PyPI' AS ecosystem, 'requests' AS package, 'critical' AS severity, {window.format('2.5.0', '2.15.0')} AS affected_versions UNION ALL SELECT 'A-2', 'PyPI', 'flask', 'low', {window.format('1.0.0', '1.3.0')}")


def _replies(spark: SparkSession) -> DataFrame:
    return spark.range(20).selectExpr("'r' || id AS repo", "'src/a.py' AS path", """CASE WHEN id % 4 = 0 THEN '{"vulnerabilities":[{"type":"Xss","severity":"high","description":"d","line":7,"confidence":"high"},{"type":"Xss","severity":"high","description":"d","line":7,"confidence":"high"}]}' WHEN id % 4 = 1 THEN '[{"type":"Sql Injection","severity":"odd","description":"e"}]' ELSE 'nothing' END AS content""")


def _attestations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("'r' || o_custkey % 20 AS repo", "'p' || o_custkey AS package", "o_orderkey AS ordinal", "CAST(o_orderkey % 4 AS INT) AS level", "o_orderkey % 2 = 0 AS signature_valid", "CASE WHEN o_custkey % 2 = 0 THEN 'other' END AS builder", "CAST(NULL AS STRING) AS source_repo", "CASE WHEN o_orderkey % 5 = 0 THEN 'e' END AS error")


_MADE = f"(SELECT 'r' || k % 20 AS repo, {_PATH} AS file, k FROM (SELECT c_custkey AS k FROM customer))"
_SCANNED = "NOT contains(file, 'vendor/')"
_SECRET = f"SELECT repo, file, 'secret/hardcoded-assignment' AS rule_id, 'high' AS severity, 'medium' AS confidence, 3 AS start_line, 'secret' AS category, 1 AS phase FROM {_MADE} WHERE k % 5 = 0 AND {_SCANNED} AND k % 7 <> 0"
_SAST = f"""SELECT repo, file, rule_id, severity, confidence, start_line, 'sast' AS category, 0 AS phase FROM {_MADE}, (VALUES (3, 'python/exec-eval', 'critical', 'high', 1), (4, 'python/debug-true', 'medium', 'medium', 2), (5, 'python/hardcoded-password', 'high', 'high', 3), (6, 'python/requests-no-timeout', 'medium', 'medium', 4)) v(m, rule_id, severity, confidence, start_line)
WHERE k % m = 0 AND {_SCANNED} AND k % 7 <> 2"""
_SCA = "SELECT 'r' || i AS repo, 'requirements.txt' AS file, 'sca/A-1' AS rule_id, 'critical' AS severity, 'high' AS confidence, 0 AS start_line, 'sca' AS category, 2 AS phase FROM range(20) t(i) WHERE i >= 5 AND i < 15"
_AI = "SELECT 'r' || i AS repo, 'src/a.py' AS file, 'ai-xss' AS rule_id, 'high' AS severity, 'high' AS confidence, 7 AS start_line, 'sast' AS category, 3 AS phase FROM range(20) t(i), range(2) u(j) WHERE i % 4 = 0"
_FOLD = "SELECT 'r' || o_custkey % 20 AS repo, 'p' || o_custkey AS file, max(o_orderkey % 4) AS level, bool_or(o_orderkey % 2 = 0) AS valid, o_custkey % 2 = 0 AS built, count(*) FILTER (o_orderkey % 5 = 0) AS errors FROM orders GROUP BY ALL"
_PROVENANCE = f"""SELECT repo, file, rule_id, severity, confidence, 0 AS start_line, 'sast' AS category, 4 AS phase FROM ({_FOLD}), (VALUES ('provenance/missing-attestation', 'medium', 'high', 0), ('provenance/untrusted-builder', 'low', 'medium', 1), ('provenance/low-slsa-level', 'low', 'high', 2), ('provenance/invalid-signature', 'high', 'high', 3)) v(rule_id, severity, confidence, n)
WHERE (n = 0 AND NOT built AND errors > 0) OR (built AND (n = 1 OR (n = 2 AND level < 2) OR (n = 3 AND NOT valid)))"""
_ALL = " UNION ALL ".join((_SAST, _SECRET, _SCA, _AI, _PROVENANCE))
_SHOWN = ["repo", "file", "rule_id", "severity", "confidence", "start_line", "category", "phase"]


def _scan(spark: SparkSession, sf: str, **config) -> DataFrame:
    c = scanner.Config(**{"ai": True, "provenance": True, **config})
    return scanner.scan(made_files(spark, sf), c, advisories=_advisories(spark), replies=_replies(spark), attestations=_attestations(spark, sf))


@query(_ALL)
def scan_streams(spark, sf):
    """All five streams of a scan."""
    return _scan(spark, sf).select(*_SHOWN)


@query(f"SELECT count(*) AS findings, count(*) AS ids FROM ({_ALL})")
def scan_ids(spark, sf):
    """Each finding has an id of its own, even two of one rule in one line."""
    return _scan(spark, sf).agg(F.count("*").alias("findings"), F.count_distinct("finding_id").alias("ids"))


@query(f"SELECT * FROM ({_SAST}) WHERE severity IN ('high', 'critical') UNION ALL {_SCA}")
def scan_config(spark, sf):
    """Streams that are switched off and a least severity."""
    return _scan(spark, sf, secrets=False, ai=False, provenance=False, min_severity="high").select(*_SHOWN)


@query(f"{_SCA} UNION ALL SELECT 'r' || i, 'sub/requirements.txt', 'sca/A-2', 'low', 'high', 0, 'sca', 2 FROM range(20) t(i) WHERE i < 3")
def scan_nested_manifests(spark, sf):
    return _scan(spark, sf, sast=False, secrets=False, ai=False, provenance=False, nested_manifests=True).select(*_SHOWN)


@query(f"SELECT repo, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM ({_ALL}) GROUP BY repo")
def scan_by_repository(spark, sf):
    return findings.summary(_scan(spark, sf), ["repo"])


_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"


@query(f"SELECT rule_id, repo, file AS uri, start_line, {_LEVEL} AS level FROM ({_ALL})")
def sarif_results(spark, sf):
    """Results of a SARIF report, read back from their JSON."""
    rows = findings.sarif_results(findings.reportable(_scan(spark, sf)))
    j = F.from_json("result", "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,endLine:int,endColumn:int>>>>")
    at = F.get(j["locations"], F.lit(0))["physicalLocation"]
    return rows.select(j["ruleId"].alias("rule_id"), "ordinal.repo", at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"), j["level"].alias("level"))


@query(f"SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) >= 4 AS fails FROM ({_ALL})")
def report_json(spark, sf):
    """What a report as JSON holds, by rows read back from it."""
    rows = findings.reportable(_scan(spark, sf)).select(F.from_json(F.to_json(F.struct("rule_id", "severity", "file")), "rule_id string, severity string, file string").alias("r")).select("r.*")
    from ..functions import severity

    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), (F.max(severity.rank(F.col("severity"))) >= 4).alias("fails"))


@query(f"SELECT DISTINCT repo, file FROM {_MADE} WHERE {_SCANNED} AND k % 7 <> 2 AND k % 11 = 0")
def scan_changed(spark, sf):
    """Files whose content isn't that of the cache: those of every eleventh customer were changed."""
    now = made_files(spark, sf).where(files.is_supported(files.language(F.col("path"))) & ~files.is_ignored(F.col("path")))
    k = F.regexp_extract("path", "f([0-9]+)", 1).cast("long")
    cached = now.select("repo", "path", F.sha2(F.when(k % 11 == 0, F.concat("content", F.lit("#"))).otherwise(F.col("content")), 256).alias("hash"))
    return scanner.changed(now, cached).select("repo", F.col("path").alias("file"))


@query(f"SELECT repo, file, 1 AS first, 4 AS last FROM {_MADE} WHERE k % 3 = 0 AND {_SCANNED} AND k % 7 <> 2")
def scan_snippets(spark, sf):
    """The lines that are shown with findings in first lines."""
    got = scanner.scan(made_files(spark, sf), scanner.Config(secrets=False, sca=False)).where("rule_id = 'python/exec-eval'")
    return got.select("repo", "file", F.array_min("snippet.n").cast("int").alias("first"), F.array_max("snippet.n").cast("int").alias("last"))


# ---------------------------------------------------------------- all rules

#: For each rule a line that it finds, and then one like it that it doesn't.
EXAMPLES = {
    "rust/unsafe-block": ("fn f() { unsafe { g(); } }", "fn f() { g(); }"), "rust/unsafe-fn": ("unsafe fn f() {}", "fn f() {}"), "rust/unsafe-impl": ("unsafe impl Send for X {}", "impl Send for X {}"),
    "rust/raw-pointer-deref": ("let x = *raw;", "let x = a * raw;"), "rust/transmute": ("let x = std::mem::transmute(v);", "let x = std::mem::swap(v);"), "rust/unwrap-panic": ("y.expect(m);", "y.unwrap_or(1);"),
    "rust/command-injection": ("Command::new(a.to_string());", "Command::new(a);"), "rust/sql-string": ('db::execute("a" + b);', 'db::execute("a");'), "rust/path-traversal": ("std::fs::read(p);", "std::io::read(p);"),
    "rust/hardcoded-secret": ('let token = "ab12cd34ef56";', 'let token = "changeme1234";'), "rust/weak-crypto": ("use md5::Digest;", "use sha2::Digest;"), "rust/panic-in-library": ('panic!("x");', 'print!("x");'),
    "rust/lazy-static-race": ("lazy_static! { static ref A: u8 = 1; }", "static A: u8 = 1;"), "rust/refcell-usage": ("RefCell::new(1);", "Rc::new(1);"), "rust/unbounded-vec-push": ("for x in y { v.push(x) }", "for x in y { v.len() }"),
    "python/exec-eval": ("exec(x)", "run(x)"), "python/sql-injection": ('cur.executemany("a %s" % b)', 'cur.executemany("a %s", b)'), "python/command-injection": ("os.system(x)", "os.stat(x)"), "python/pickle-load": ("pickle.load(x)", "pickle.dump(x)"),
    "python/hardcoded-password": ('api_key = "hunter2hunter2"', 'label = "hunter2hunter2"'), "python/assert-security": ("assert a == b", "assert a"), "python/debug-true": ("DEBUG = True", "DEBUG = False"),
    "python/weak-crypto": ("from Crypto.Cipher.DES import new", "from Crypto.Cipher.AES import new"), "python/requests-no-timeout": ("requests.post(u)", "requests.post(u, timeout=3)"), "python/tempfile-mktemp": ("tempfile.mktemp()", "tempfile.mkdtemp()"),
    "python/logging-format-injection": ('log.error("a %s", b)', 'log.error("a")'), "python/dynamic-import": ("__import__(x)", "importer(x)"),
    "js/eval": ("eval(x);", "evil(x);"), "js/innerhtml": ("el.innerHTML = x;", "el.innerText = x;"), "js/document-write": ("document.write(x);", "file.write(x);"), "js/hardcoded-secret": ('const secret = "abcd1234efgh";', 'const title = "abcd1234efgh";'),
    "js/sql-concat": ('db.execute("DELETE " + a);', 'db.execute("DELETE ?", a);'), "js/shell-exec": ("execSync(cmd);", "spawn(cmd);"), "js/regex-dos": ("const r = /(a+)b+/;", "const r = /a+b/;"), "js/no-csrf": ("app.delete(u, h);", "app.get(u, h);"),
    "js/prototype-pollution": ("Object.assign(dest, s);", "Object.assign({}, s);"), "js/dynamic-require": ("require(x);", 'require("fs");'), "js/mutable-exports": ("export const C = [];", "const C = [];"), "js/unhandled-json-parse": ("JSON.parse(x);", "JSON.stringify(x);"),
    "go/sql-injection": ('db.Exec("a" + b)', 'db.Exec("a", b)'), "go/command-injection": ('exec.Command("ls")', 'exec.LookPath("ls")'), "go/hardcoded-cred": ('secret := "abc12345678"', 'title := "abc12345678"'),
    "go/tls-insecure": ("c := &tls.Config{InsecureSkipVerify: true}", "c := &tls.Config{InsecureSkipVerify: false}"), "go/weak-random": ("rand.Int()", "rand.Perm(5)"), "go/path-traversal": ("ioutil.ReadFile(p)", "ioutil.Discard(p)"),
    "go/unhandled-error": ("_ = f()", "_ = x"), "go/defer-in-loop": ("for i := 0; i < 3; i++ {\n\tdefer g()\n}", "func f() {\n\tdefer g()\n}"), "go/sync-map-assertion": ("sync.Map().Load(k)", "m.Load(k)"),
    "go/unbuffered-channel": ("c := make(chan int)", "c := make([]int, 3)"), "go/context-no-timeout": ("context.Background()", "context.TODO()"),
}
_LANGUAGE = {"rust": "rust", "python": "python", "js": "javascript", "go": "go"}


def rule_files(spark: SparkSession) -> DataFrame:
    rows = [("r", f"{rule}#{k}", _LANGUAGE[rule.split("/")[0]], code + "\n") for rule, pair in EXAMPLES.items() for k, code in zip(("yes", "no"), pair, strict=True)]
    return spark.createDataFrame(rows, "repo string, path string, language string, content string")


@query("SELECT rule_id || '#yes' AS file, rule_id, severity, cwe FROM (VALUES " + ", ".join(f"('{i}', '{s}', '{cwes[-1]}')" for i, s, cwes, *_ in sast.RULES) + ") t(rule_id, severity, cwe)")
def sast_every_rule(spark, sf):
    """Of each rule's two lines, the findings of that rule: one in the first, none in the second."""
    found = sast.scanned(rule_files(spark)).where(F.substring_index("file", "#", 1) == F.col("rule_id"))
    return found.select("file", "rule_id", "severity", "cwe")


# ---------------------------------------------------------------- package URLs, prompts, caches


@query("""SELECT k AS p_partkey, 'pkg:cargo/n' || k || '@1.' || s AS cargo, CASE WHEN k % 2 = 0 THEN 'pkg:npm/%40s/n' || k || '@1.' || s ELSE 'pkg:npm/n' || k || '@1.' || s END AS npm, 'pkg:pypi/my-pkg-' || k || '@1.' || s AS pypi, 'pkg:golang/github.com/o' || s || '/m' || k || '@v1.' || s AS golang FROM (SELECT p_partkey AS k, p_size AS s FROM part)""")
def purl_builders(spark, sf):
    k, v = F.col("p_partkey").cast("string"), F.concat(F.lit("1."), F.col("p_size").cast("string"))
    npm = F.concat(F.when(F.col("p_partkey") % 2 == 0, "@s/n").otherwise("n"), k)
    return table(spark, sf, "part").select("p_partkey", purl.cargo(F.concat(F.lit("n"), k), v).alias("cargo"), purl.npm(npm, v).alias("npm"), purl.pypi(F.concat(F.lit("My_Pkg_"), k), v).alias("pypi"), purl.golang(F.concat(F.lit("github.com/o"), F.col("p_size").cast("string"), F.lit("/m"), k), F.concat(F.lit("v"), v)).alias("golang"))


@query("SELECT doc_id, strlen(text) > 8000 AS cut, least(strlen(text), 8000) - strlen(kept) BETWEEN 0 AND 3 AS whole, strlen(text) > 8000 AS marked FROM (SELECT doc_id, text, CASE WHEN strlen(text) <= 8000 THEN text ELSE left(text, 0) || repeat('x', 8000) END AS kept FROM documents)")
def prompt_cut(spark, sf):
    """Long code is cut in prompts, never within a character, and the cut is marked."""
    code = F.regexp_extract(text.prompt(F.lit("Python"), F.lit("c.py"), F.lit(None).cast("string"), F.col("text")), r"(?s)```\n(.*)\n```\nReply", 1)
    marked = F.endswith(code, F.lit(text.CUT))
    kept = F.octet_length(F.when(marked, F.substring(code, F.lit(1), F.length(code) - len(text.CUT))).otherwise(code))
    size = F.octet_length("text")
    return table(spark, sf, "documents").select("doc_id", (kept < size).alias("cut"), (F.least(size, F.lit(8000)) - kept).between(0, 3).alias("whole"), marked.alias("marked"))


@query(f"SELECT repo, file AS path, 'reply to ' || file AS content, NULL::VARCHAR AS error FROM {_MADE} WHERE k % 7 > 2 AND k % 13 <> 0 UNION ALL SELECT repo, file, NULL, 'ValueError: no answer' FROM {_MADE} WHERE k % 7 > 2 AND k % 13 = 0")
def model_replies(spark, sf):
    """Replies of a client that fails for every thirteenth file."""

    def client():
        def ask(prompt: str) -> str:
            path = prompt.split("File: ")[1].split("\n")[0]
            if int(path.split("/f")[1][:-3]) % 13 == 0:
                raise ValueError("no answer")
            return "reply to " + path

        return ask

    own = made_files(spark, sf).where("path LIKE 'src/f%'").withColumn("language", F.lit("Python"))
    return review.asked(own, client)


@query("SELECT 'k' || o_custkey AS key, max(o_orderkey)::VARCHAR AS value FROM orders GROUP BY o_custkey HAVING max(o_orderkey) % 3 <> 0")
def cache_unexpired(spark, sf):
    """The newest row of each key, where it still holds: every third was written two hours ago, with an hour to live."""
    now = "2024-06-01 12:00:00"
    k = F.col("o_orderkey")
    hours = F.when(k % 3 == 0, 2).otherwise(0)
    rows = table(spark, sf, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key"), k.cast("string").alias("value"), k.alias("created_order"), F.lit(cache.SECONDS["scan"]).alias("ttl_secs"), hours.alias("hours"))
    newest = findings.first_of_rule(rows.withColumnRenamed("key", "rule_id").withColumn("ordinal", -F.col("created_order"))).withColumnRenamed("rule_id", "key")
    at = newest.withColumn("created_at", F.expr(f"timestamp'{now}' - make_interval(0, 0, 0, 0, hours, 0, 0)"))
    return findings.unexpired(at, F.lit(now).cast("timestamp")).select("key", "value")


@query("SELECT * FROM (VALUES (DATE '2024-01-02', 'A'), (NULL, 'B'), (NULL, 'C')) t(published, id)")
def advisory_dates(spark, sf):
    """Dates of advisories; what isn't one is null."""
    from ..operators import sca

    rows = values(spark, """('{"id":"A","published":"2024-01-02T03:04:05Z"}'), ('{"id":"B","published":"soon"}'), ('{"id":"C"}')""", "json")
    return sca.advisories(rows).select(F.to_date("published").alias("published"), "id")


@query("SELECT repo, count(*) AS found FROM (SELECT 'r' || k % 20 AS repo, k FROM (SELECT c_custkey AS k FROM customer)) WHERE k % 3 = 1 GROUP BY repo")
def scan_broken_code(spark, sf):
    """Files with broken or null code take nothing from the findings of others."""
    rows = table(spark, sf, "customer").selectExpr("'r' || c_custkey % 20 AS repo", "'f' || c_custkey AS path", "'python' AS language", "CASE c_custkey % 3 WHEN 0 THEN '((([' || c_name WHEN 1 THEN 'eval(x)' END AS content")
    return sast.matched(syntax.parsed(rows)).where("rule_id = 'python/exec-eval'").groupBy("repo").agg(F.count("*").alias("found"))
