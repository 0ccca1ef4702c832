"""Package URLs and ecosystem names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ecosystems by package type, and their names in advisories.
TYPES = {"cargo": "Cargo", "npm": "Npm", "pypi": "PyPI", "golang": "Go", "go": "Go", "maven": "Maven"}
ADVISORY_NAMES = {"cargo": "crates.io", "npm": "npm", "pypi": "PyPI", "golang": "Go", "go": "Go", "maven": "Maven", "nuget": "NuGet", "gem": "RubyGems", "composer": "Packagist", "hex": "Hex", "pub": "Pub", "swift": "SwiftURL", "cran": "CRAN"}


def _named(t: Column, table: dict[str, str], other: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(F.lower(t) == k, v)
    return out.otherwise(other)


def ecosystem(kind: Column) -> Column:
    return _named(kind, TYPES, F.lit("Unknown"))


def advisory_ecosystem(kind: Column) -> Column:
    return _named(kind, ADVISORY_NAMES, kind)


def decoded(text: Column) -> Column:
    """Percent codes become the character of that number; others stay as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"(%[0-9A-Fa-f]{2}|[^%]+|%)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))).otherwise(p)), "")


def encoded(text: Column) -> Column:
    """All but letters, digits and -._~ become percent codes of their bytes."""
    parts = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(parts, lambda c: F.when(c.rlike("^[A-Za-z0-9._~-]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")


def parse(purl: Column) -> Column:
    """struct(type, namespace, name, version, qualifiers, subpath); null for what isn't one.

    The version is what follows the last @. A Go package's name is its whole path. Qualifiers without = are dropped.
    """
    body = F.regexp_replace(F.substr(purl, F.lit(5)), "#.*$", "")
    subpath = F.when(F.contains(purl, F.lit("#")), decoded(F.regexp_extract(purl, "#(.*)$", 1)))
    query = F.regexp_extract(body, r"\?(.*)$", 1)
    core = F.regexp_replace(body, r"\?.*$", "")
    at = F.regexp_extract(core, "^(.*)@([^@]*)$", 1)
    has_version = F.contains(core, F.lit("@"))
    path = F.when(has_version, at).otherwise(core)
    version = F.when(has_version, decoded(F.regexp_extract(core, "@([^@]*)$", 1)))
    kind = F.lower(F.regexp_extract(path, "^([^/]+)/", 1))
    rest = F.regexp_extract(path, "^[^/]+/(.+)$", 1)
    cut = F.contains(rest, F.lit("/"))
    head, tail = decoded(F.regexp_extract(rest, "^(.*)/([^/]*)$", 1)), decoded(F.regexp_extract(rest, "([^/]*)$", 1))
    go = kind.isin("golang", "go")
    name = F.when(go, decoded(rest)).otherwise(tail)
    space = F.when(go & cut, decoded(F.substring_index(rest, "/", 1))).when(~go & cut, head)
    pairs = F.filter(F.split(query, "&"), lambda x: F.contains(x, F.lit("=")))
    qualifiers = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v"))))
    sound = F.startswith(purl, F.lit("pkg:")) & (kind != "") & (rest != "") & (name != "") & ~((kind == "maven") & ~cut)
    return F.when(sound, F.struct(kind.alias("type"), space.alias("namespace"), name.alias("name"), version.alias("version"), qualifiers.alias("qualifiers"), subpath.alias("subpath")))


def build(kind: Column, namespace: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.coalesce(F.concat(encoded(namespace), F.lit("/")), F.lit("")), encoded(name), F.coalesce(F.concat(F.lit("@"), encoded(version)), F.lit("")))


def pypi_name(name: Column) -> Column:
    return F.translate(F.lower(name), "_", "-")


def cargo(name: Column, version: Column) -> Column:
    return build(F.lit("cargo"), F.lit(None).cast("string"), name, version)


def npm(name: Column, version: Column) -> Column:
    """A scope, with its @, is the namespace."""
    scoped = F.startswith(name, F.lit("@")) & F.contains(name, F.lit("/"))
    return build(F.lit("npm"), F.when(scoped, F.substring_index(name, "/", 1)), F.when(scoped, F.regexp_replace(name, "^[^/]*/", "")).otherwise(name), version)


def pypi(name: Column, version: Column) -> Column:
    return build(F.lit("pypi"), F.lit(None).cast("string"), pypi_name(name), version)


def golang(path: Column, version: Column) -> Column:
    """All of a module's path but its last part is the namespace, whose slashes stay."""
    cut = F.contains(path, F.lit("/"))
    space = F.when(cut, F.array_join(F.transform(F.split(F.regexp_replace(path, "/[^/]*$", ""), "/"), encoded), "/"))
    return F.concat(F.lit("pkg:golang/"), F.coalesce(F.concat(space, F.lit("/")), F.lit("")), encoded(F.regexp_extract(path, "([^/]*)$", 1)), F.coalesce(F.concat(F.lit("@"), encoded(version)), F.lit("")))
