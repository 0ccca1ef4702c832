"""Paths, languages, repositories and targets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension, and those that rules exist for.
EXTENSIONS = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rb": "ruby"}
SUPPORTED = ["rust", "python", "javascript", "typescript", "go"]
#: Directories of built or foreign files.
IGNORED = ["target", "node_modules", "vendor", "dist", "build", ".git"]
#: Parts and ends of paths of tests.
TEST_PARTS = ["/test/", "/tests/", "/__tests__/", "/fixtures/", "/test_"]
TEST_ENDS = ["_test.py", "_test.go", ".test.js", ".test.ts", ".spec.js", ".spec.ts", "_spec.rb", "_test.rs"]


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F
    for k, v in EXTENSIONS.items():
        out = out.when(ext == k, v)
    return out.otherwise("unknown")


def is_supported(lang: Column) -> Column:
    return lang.isin(SUPPORTED)


def is_ignored(path: Column, dirs: list[str] = IGNORED) -> Column:
    """A directory on the path, not the file itself, has one of the names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in dirs]))


def is_test(path: Column) -> Column:
    p = F.lower(path)
    out = F.lit(False)
    for part in TEST_PARTS:
        out = out | F.contains(p, F.lit(part))
    for end in TEST_ENDS:
        out = out | F.endswith(p, F.lit(end))
    return out


def repository(url: Column) -> Column:
    """struct(owner, name), or null where there aren't two parts."""
    t = F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"(\.git)+$", "")
    rest = F.when(F.contains(t, F.lit("github.com")), F.regexp_replace(F.regexp_replace(F.element_at(F.split(t, "github\\.com"), -1), "^/+", ""), "^:+", "")).otherwise(t)
    parts = F.split(rest, "/")
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.size(parts) - 2).alias("owner"), F.get(parts, F.size(parts) - 1).alias("name")))


def target(text: Column, exists: Column) -> Column:
    """struct(kind, value): a local path if it exists, else a repository, an organisation, a user or a search."""
    t = F.trim(text)
    kind = F.when(exists, "local").when(repository(t).isNotNull(), "repository").when(F.startswith(t, F.lit("org:")), "organization").when(F.startswith(t, F.lit("user:")), "user").otherwise("search")
    return F.struct(kind.alias("kind"), F.when(kind == "organization", F.substr(t, F.lit(5))).when(kind == "user", F.substr(t, F.lit(6))).otherwise(t).alias("value"))


def release_repository(url: Column) -> Column:
    """struct(owner, name) of the last two parts of a web or ssh address; null where there aren't two."""
    t = F.replace(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"(\.git)+$", ""), F.lit("git@github.com:"), F.lit("https://github.com/"))
    parts = F.split(t, "/")
    return F.when(F.size(parts) >= 2, F.struct(F.element_at(parts, -2).alias("owner"), F.element_at(parts, -1).alias("name")))
