"""Queries over whole scans against DuckDB, and what a scan keeps of its inputs."""

import glob
import os

import duckdb
import pytest

from vigilspark.operators import findings
from vigilspark.plans import catalogue, catalogue_scan, scanner

NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ == catalogue_scan.__name__]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_duckdb(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf), duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


def test_findings_keep_their_repository_and_an_id_each(spark):
    files = spark.createDataFrame([("a", "x.py", "eval(x); eval(y)\nt = {'token': 'ab12cd34ef56', \"token\": \"ab12cd34ef56\"}\n"), ("b", "x.py", "eval(x)\n"), (None, "x.py", "eval(x)\n")], "repo string, path string, content string")
    replies = spark.createDataFrame([("a", "x.py", '[{"type":"Xss"},{"type":"Xss"}]'), ("b", "x.py", '[{"type":"Xss"}]')], "repo string, path string, content string")
    got = scanner.scan(files, scanner.Config(ai=True, min_severity="none"), replies=replies).collect()
    assert len({r.finding_id for r in got}) == len(got)
    found = scanner.scan(files, scanner.Config(ai=True), replies=replies.drop("repo")).where("phase = 3").collect()
    assert {r.repo for r in found} <= {None}
    assert sorted((r.repo, r.line) for r in findings.model_findings(replies).collect()) == [("a", 1), ("a", 1), ("b", 1)]
