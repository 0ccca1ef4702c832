"""Dependency manifests as rows: manifest, ecosystem, name, version, source, checksum, is_direct, dependencies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

_KEEP = ["manifest", "ecosystem", "name", "version"]


def requirements(files: DataFrame) -> DataFrame:
    """Of each line the first part is the name and the last the version, whatever stands between."""
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("ordinal", "l")).withColumn("l", F.trim("l"))
    parts = F.split("l", r"[=><~!\[]")
    return lines.where((F.col("l") != "") & ~F.startswith("l", F.lit("#")) & (F.size(parts) >= 2)).select(F.col("path").alias("manifest"), F.lit("PyPI").alias("ecosystem"), F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.element_at(parts, -1)).alias("version"))


def package_json(files: DataFrame) -> DataFrame:
    """Runtime and development dependencies; values that aren't texts are left out."""
    doc = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.create_map().cast("map<string,string>")
    both = files.select("path", doc.alias("d")).select("path", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.coalesce("d.dependencies", none).alias("m")), F.struct(F.lit(1).alias("o"), F.coalesce("d.devDependencies", none).alias("m")))).alias("x"))
    rows = both.select("path", F.explode("x.m").alias("name", "v"))
    return rows.where("v is not null").select(F.col("path").alias("manifest"), F.lit("Npm").alias("ecosystem"), "name", F.regexp_replace("v", "^[\\^~=><]+", "").alias("version"))


def go_sum(files: DataFrame) -> DataFrame:
    """One row for each module and version of a file."""
    lines = files.select("path", F.explode(F.split("content", "\r?\n")).alias("l"))
    parts = F.split(F.trim("l"), r"\s+")
    rows = lines.where(F.size(parts) >= 2).select(F.col("path").alias("manifest"), F.lit("Go").alias("ecosystem"), F.get(parts, F.lit(0)).alias("name"), F.substring_index(F.regexp_replace(F.get(parts, F.lit(1)), "^v+", ""), "/", 1).alias("version"))
    return rows.dropDuplicates(_KEEP)


def _lock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import tomllib

    for batch in batches:
        rows = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                packages = tomllib.loads(text or "").get("package", [])
                rows += [(path, p["name"], p["version"], p.get("source"), p.get("checksum"), [d.split(" ")[0] for d in p.get("dependencies", [])], None) for p in packages]
            except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as e:
                rows.append((path, None, None, None, None, [], f"{type(e).__name__}: {e}"))
        if rows:
            kinds = [pa.string()] * 5 + [pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["manifest", "name", "version", "source", "checksum", "dependencies", "error"])


def cargo_lock(files: DataFrame) -> DataFrame:
    """Every package of a lock file. A file that can't be read gives one row with an error, and no other file suffers."""
    ship(files.sparkSession)
    rows = files.select("path", "content").mapInArrow(_lock, "manifest string, name string, version string, source string, checksum string, dependencies array<string>, error string")
    return rows.select("manifest", F.lit("Cargo").alias("ecosystem"), "name", "version", "source", "checksum", F.lit(False).alias("is_direct"), "dependencies", "error")


#: Names of manifests and their readers, in the order of their rows.
READERS = {"Cargo.lock": cargo_lock, "package.json": package_json, "requirements.txt": requirements, "go.sum": go_sum}


def dependencies(files: DataFrame) -> DataFrame:
    """All manifests at the root of a repository, by name."""
    out = None
    for name, read in READERS.items():
        part = read(files.where(F.col("path") == name)).select(*_KEEP)
        out = part if out is None else out.unionByName(part)
    return out.where("name is not null")


def source_files(spark, root: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Files below a folder: path, language, size, content. Long files, ignored directories and languages without rules are left out before content is read; files that aren't UTF-8 have null content."""
    from ..functions import files as names

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    base = root.rstrip("/") + "/"
    path: Column = F.regexp_replace(F.substring_index("path", base, -1), "^/+", "")
    rows = found.select(path.alias("path"), names.language(F.col("path")).alias("language"), F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    return rows.where(names.is_supported(F.col("language")) & ~names.is_ignored(F.col("path")))
