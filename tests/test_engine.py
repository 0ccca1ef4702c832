import json
import subprocess

import duckdb
import pytest

import __spark_entry__ as entry
from vigilspark.functions import purl, severity, versions
from vigilspark.operators import cache, findings, review
from vigilspark.plans import catalogue, scanner
from vigilspark.sources import git, manifests
from vigilspark.streaming import files as streaming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_oracle(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    rel = duck.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(norm(v) for v in r) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr) == want


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fixed_version_that_cant_be_read_leaves_last_affected_in_one_variant(spark):
    from pyspark.sql import functions as F

    args = [F.lit("5.0.0"), F.lit("1.0.0"), F.lit("garbage"), F.lit("2.0.0")]
    r = spark.range(1).select(versions.in_range(F.lit("npm"), *args), versions.range_contains(*args)).first()
    assert tuple(r) == (True, False)


@pytest.mark.parametrize(("older", "newer"), [("1.0.dev1", "1.0a1"), ("1.0a1", "1.0b1"), ("1.0rc1", "1.0"), ("1.0", "1.0.post1"), ("1.0", "1!0.1"), ("1.0.9", "1.0.10")])
def test_pep440_order(spark, older, newer):
    from pyspark.sql import functions as F

    assert spark.range(1).select(versions.pep440_key(F.lit(older)) < versions.pep440_key(F.lit(newer))).first()[0]


def test_percent_codes(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(purl.decoded(F.lit("a%20b%zz+%E9")), purl.encoded(F.lit("@a b")), purl.parse(F.lit(None).cast("string"))).first()
    assert tuple(r) == ("a b%zz+é", "%40a%20b", None)


def test_manifest_that_cant_be_read_stands_alone(spark):
    rows = manifests.cargo_lock(spark.createDataFrame([("a", "[[package"), ("b", '[[package]]\nname = "x"\nversion = "1"\n'), ("c", None)], "path string, content string")).collect()
    assert {(r.manifest, r.name, r.error is None) for r in rows} == {("a", None, False), ("b", "x", True)}


def test_source_files(spark, tmp_path):
    for p, b in (("src/a.py", b"x = 1\n"), ("target/b.py", b"x"), ("c.txt", b"x"), ("d.go", b"\xff"), ("big.rs", b"x" * 50)):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b)
    rows = manifests.source_files(spark, str(tmp_path), most_bytes=49).collect()
    assert {(r.path, r.language, r.content) for r in rows} == {("src/a.py", "python", "x = 1\n"), ("d.go", "go", None)}


def test_scan_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("r", "a.py", "eval(x)\npassword = 'hunter2hunter2'\n"), ("r", "requirements.txt", "requests==2.31.0\n"), ("r", "src/tests/b.py", "token = 'ab12cd34ef56gh78'\n")], "repo string, path string, content string")
    known = spark.sql("SELECT 'A-1' AS id, 'PyPI' AS ecosystem, 'requests' AS package, 'critical' AS severity, array(named_struct('introduced', '2.0', 'fixed', '3.0', 'last_affected', CAST(NULL AS STRING))) AS affected_versions")
    out = scanner.scan(files, advisories=known).persist()
    got = {(r.category, r.rule_id, r.file) for r in out.collect()}
    assert ("sast", "python/exec-eval", "a.py") in got and ("secret", "secret/hardcoded-assignment", "a.py") in got and ("sca", "sca/A-1", "requirements.txt") in got
    assert not any(c == "secret" and f.startswith("src/tests") for c, _, f in got)
    assert scanner.scan(files, scanner.Config(sast=False, secrets=False, sca=False)).count() == 0
    from pyspark.sql import functions as F

    report = out.withColumns({"title": F.col("rule_id"), "description": F.col("rule_id"), "start_column": F.lit(1), "end_line": F.col("start_line"), "end_column": F.lit(1), "ordinal": F.col("phase") * 1000 + F.col("start_line")})
    doc = json.loads(findings.sarif(report))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == out.count()
    assert "CRITICAL" in findings.text(report, "r") and "No findings." in findings.text(report.limit(0), "r") and "more" in findings.text(report, "r", 1)
    assert "Vulnerable dependency: requests 2.31.0 (A-1)" in scanner.report(out, "text", "r") and len(json.loads(scanner.report(out, "json"))) == out.count()
    assert {r["id"] for r in json.loads(scanner.report(out, "sarif"))["runs"][0]["tool"]["driver"]["rules"]} == {x[1] for x in got}
    assert findings.exit_status(out) == 1 and findings.exit_status(out.limit(0)) == 0
    findings.write_atomic(str(tmp_path / "x.json")[-200:], findings.as_json(out)) if str(tmp_path).count("/") < 7 else None
    with pytest.raises(ValueError):
        findings.write_atomic("../x", "")
    cached = files.where("path = 'a.py'").select("repo", "path", F.sha2("content", 256).alias("hash"))
    assert scanner.changed(files, cached).count() == 2


def test_unknown_severities_go_by_default(spark):
    df = spark.createDataFrame([(s,) for s in severity.SEVERITIES], "severity string")
    from pyspark.sql import functions as F

    assert {r.severity for r in df.where(severity.at_least(F.col("severity"), "odd")).collect()} == {"low", "medium", "high", "critical"}


def test_stream_counts_secrets(spark, tmp_path):
    spark.createDataFrame([("r", "a", "token = 'ab12cd34ef56gh78'"), ("q", "b", "x")], streaming.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = streaming.secrets_by_repository(streaming.arriving(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.repo, r.secrets) for r in spark.table("counts").collect()} == {("r", 1), ("q", 0)}


def test_review_asks_each_file_and_a_failure_stands_alone(spark):
    def client():
        def ask(prompt):
            if "bad.py" in prompt:
                raise RuntimeError("down")
            return '{"vulnerabilities":[{"type":"Xss","severity":"high","description":"d"}]}'

        return ask

    files = spark.createDataFrame([("r", "a.py", "python", "x"), ("r", "bad.py", "python", "x"), ("r", "long.py", "python", "x" * (review.MOST_BYTES + 1))], "repo string, path string, language string, content string")
    replies = review.asked(files, client)
    assert {(r.path, r.error) for r in replies.collect()} == {("a.py", None), ("bad.py", "RuntimeError: down")}
    assert [(r.path, r.rule_id, r.severity) for r in findings.model_findings(replies).collect()] == [("a.py", "ai-xss", "high")]


def test_cache_keeps_the_newest_row_until_it_ends(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = lambda k, v: spark.createDataFrame([(k, v)], "key string, value string")
    cache.written(row("a", "old"), path, "scan", "2024-01-01 00:00:00")
    cache.written(row("a", "new"), path, "scan", "2024-01-01 00:30:00")
    cache.written(row("b", "x"), path, "vulnerability", "2024-01-01 00:00:00")
    held = lambda kind, now: [(r.key, r.value) for r in cache.read(spark, path, kind, now).collect()]
    assert held("scan", "2024-01-01 01:30:00") == [("a", "new")] and held("scan", "2024-01-01 01:30:01") == []
    assert held("vulnerability", "2024-01-07 00:00:00") == [("b", "x")]


def test_changed_paths(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("1")
    run("add", ".")
    run("commit", "-qm", "one")
    first = git.head(str(tmp_path))
    assert [r.path for r in git.changed_paths(spark, str(tmp_path)).collect()] == ["a.py"] and git.origin(str(tmp_path)) is None
    (tmp_path / "b.py").write_text("2")
    run("add", ".")
    run("commit", "-qm", "two")
    assert [r.path for r in git.changed_paths(spark, str(tmp_path)).collect()] == ["b.py"] and git.changed_paths(spark, str(tmp_path), git.head(str(tmp_path))).count() == 0
    assert first != git.head(str(tmp_path))
