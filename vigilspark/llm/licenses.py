"""Licence scans in DataFrame operations alone: TF-IDF cosine of lines, and of runs of lines, to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Public licence identifiers and the statements by which files refer to them.
TEMPLATES = [
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Least cosine of a line, or a run of lines, to a template.
LEAST = 0.8
#: Lines of a run at most, over which statements are wrapped.
WRAP = 4
#: Directories of which the nearest licences are broadcast.
FEW = 100_000
#: Names of files whose licence holds for their directory.
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
_CUT = "[^a-z0-9]+"


def tokens(text: str) -> list[str]:
    return [t for t in re.split(_CUT, text.lower()) if t]


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _CUT), "")


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _table(rows: dict[str, list[float]]) -> Column:
    return F.create_map(*[x for t, values in rows.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in values]))])


def _sums(table: Column, terms: Column, width: int) -> Column:
    """The sums of the table's rows of some terms."""
    return F.aggregate(terms, F.array(*[F.lit(0.0)] * width), lambda a, t: F.zip_with(a, F.coalesce(F.try_element_at(table, t), a), lambda x, y: x + y))


def telling_terms(weights: list[dict[str, float]]) -> list[str]:
    """Terms of which a line must hold one to reach LEAST with any of the templates, given as unit vectors, however many files hold them.

    A line's cosine to a template is at most the root of the squared weights of the template's terms in it. So the heaviest
    terms of each template are taken until all its others together stay under LEAST.
    """
    out: set[str] = set()
    for w in weights:
        rest = sum(x * x for x in w.values())
        for t in sorted(w, key=lambda t: (-w[t], t)):
            if rest < LEAST**2 * 0.999999:
                break
            out.add(t)
            rest -= w[t] ** 2
    return sorted(out)


def scanned(files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] | None = None, carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per file: the columns named in carry, path, own (licence of its best line, or null), cosine, license (own or inherited), origin (own, inherited, none), license_path.

    Each line and each run of up to WRAP lines is compared, so statements may be wrapped; "line" below means either. A line's vector has a term's count times its inverse document frequency, counted over all files and 1 for a term that all files hold. Only
    lines that can't reach LEAST even if all files held their words outside the templates (telling_terms, then the cosine under that bound) end before those words are counted. A file's licence is that of the line with the greatest cosine, LEAST at least; ties go to the
    licence that sorts first. A file without one inherits that of the licence file (by name) in the nearest directory on its path to the root, its
    own directory first; of several there, the greatest cosine and then the path that sorts first holds.

    Null texts have no lines. A file without a path keeps its own licence and inherits none. Repeated rows give a row each.
    Templates are few and fixed; nothing else is broadcast by us, and no file is gathered in one place.
    """
    spark = files.sparkSession
    known = [(name, str(k), tokens(text)) for k, (name, text) in enumerate(templates or TEMPLATES)]
    vocabulary = sorted({t for _, _, ts in known for t in ts})
    carry = carry or []
    src = files.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *[F.col(f"`{c}`").alias(f"__c{x}") for x, c in enumerate(carry)])
    words = F.array(*[F.lit(t) for t in vocabulary])
    counts = src.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(_tokens(F.col("__text")), words))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    n = {r.t: r.n for r in counts.collect()}  # as many rows as the templates have terms
    total = n.get("", 0)
    idf = {t: 1 + math.log((1 + total) / (1 + n.get(t, 0))) for t in vocabulary}
    vectors = []
    for name, k, ts in known:
        w = {t: ts.count(t) * idf[t] for t in set(ts)}
        norm = sum(x * x for x in w.values()) ** 0.5
        vectors.append({t: x / norm for t, x in sorted(w.items())})
    telling = telling_terms(vectors)
    own_key = F.xxhash64("path", "__text")
    tell = F.array(*[F.lit(t) for t in telling])
    # of each term a number for each template: what it adds to the greatest cosine that can be reached, and to the dot product
    reach = _table({t: [w.get(t, 0.0) ** 2 for w in vectors] for t in vocabulary})
    adds = _table({t: [w.get(t, 0.0) * idf[t] for w in vectors] for t in vocabulary})
    may = lambda: F.array_max(_sums(reach, F.array_distinct("known"), len(vectors))) >= LEAST**2 * 0.999999
    # what is named more than once is made by a generator, as a plain column would be computed anew wherever it is named
    made = lambda df, column, name, *keep: df.select(*keep, F.explode(F.array(column)).alias(name))
    # texts whose words can't reach the least cosine to any template, nearly all, are told by one look at all their words
    some = src.where(F.arrays_overlap(_tokens(F.col("__text")), tell)) if telling else src.where(F.lit(False))
    some = made(some, F.array_intersect(_tokens(F.col("__text")), words), "known", "path", "__text").where(may())
    cut = made(some, F.transform(F.split("__text", "\n"), _tokens), "ls", own_key.alias("f"))
    # runs that hold a telling line; all others can't reach the least cosine
    at = F.filter(F.transform("ls", lambda ts, i: F.when(F.arrays_overlap(ts, tell), i)), lambda i: i.isNotNull())
    runs = F.flatten(F.transform("at", lambda i: F.array(*[F.struct((i - back).alias("first"), F.lit(n).alias("n")) for n in range(1, WRAP + 1) for back in range(n)])))
    runs = F.filter(F.array_distinct(runs), lambda r: (r["first"] >= 0) & (r["first"] + r["n"] <= F.size("ls")))
    lines = made(cut, at if telling else F.array().cast("array<int>"), "at", "f", "ls")
    lines = lines.select("f", F.explode(F.transform(runs, lambda r: F.flatten(F.slice("ls", r["first"] + 1, r["n"])))).alias("ts"))
    lines = made(lines, F.filter("ts", lambda t: F.array_contains(words, t)), "known", "f", "ts").where(may())
    lines = lines.withColumn("others", F.filter("ts", lambda t: ~F.array_contains(words, t)))
    # each other word weighs 1 at least, so these are bounds
    weight = _map({t: x * x for t, x in idf.items()})
    lines = lines.withColumn("s", F.aggregate(F.array_distinct("known"), F.lit(0.0), lambda a, t: a + weight[t] * F.pow(F.size(F.filter("known", lambda x: x == t)), F.lit(2.0))))
    lines = made(lines, _sums(adds, F.col("known"), len(vectors)), "sums", "f", "ts", "others", "s")
    norm = F.sqrt(F.col("s") + F.size("others"))
    dots = F.transform("sums", lambda x, k: F.struct(F.get(F.array(*[F.lit(name) for name, _, _ in known]), k).alias("license"), x.alias("dot")))
    lines = made(lines, F.filter(dots, lambda d: d["dot"] >= norm * F.lit(LEAST * 0.999999)), "dots", "f", "ts", "others", "s").where(F.size("dots") > 0)
    # equal lines of files and of repeated rows are compared once
    scratch = scratch or Scratch(spark, "licenses")
    lines = lines.select("f", F.array_join("ts", " ").alias("line"), "s", "others", "dots").dropDuplicates(["f", "line"])
    lines = scratch.cut(lines, "lines")
    alike = lines.groupBy("line").agg(F.first("s").alias("s"), F.first("others").alias("others"), F.first("dots").alias("dots"))
    others = alike.select("line", F.explode("others").alias("t")).groupBy("line", "t").agg(F.count("*").cast("double").alias("n"))
    held = src.select(F.explode(F.array_distinct(_tokens(F.col("__text")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    held = held.join(others.select("t").distinct(), "t", "left_semi")
    idf_of = 1 + F.log(F.lit(1.0 + total) / (1 + F.col("df")))
    norms = others.join(held, "t").groupBy("line").agg(F.sum(F.pow(F.col("n") * idf_of, F.lit(2.0))).alias("o"))
    norm = F.sqrt(F.col("s") + F.coalesce("o", F.lit(0.0)))
    reached = alike.join(norms, "line", "left").select("line", F.filter(F.transform("dots", lambda d: F.struct((-F.round(d["dot"] / norm, 9)).alias("c"), d["license"].alias("license"))), lambda d: d["c"] <= -LEAST).alias("cs"))
    reached = reached.where(F.size("cs") > 0).select("line", F.array_min("cs").alias("b"))
    cosines = lines.select("f", "line").join(reached, "line").select("f", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))
    best = cosines.groupBy("f").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("f", F.col("b.license").alias("own"), (-F.col("b.c")).alias("cosine"))
    best = scratch.cut(best, "best")
    told = src.withColumn("f", own_key).drop("__text").join(best, "f", "left").drop("f").withColumn("dir", F.regexp_replace("path", "[^/]*$", ""))

    at_dir = told.where(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("p"), "own")).alias("l"))
    at_dir = at_dir.select(F.col("dir").alias("up"), F.col("l.own").alias("license"), F.col("l.p").alias("license_path"))
    parts = F.split(F.regexp_replace("dir", "/$", ""), "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    own_dirs = src.select(F.regexp_replace("path", "[^/]*$", "").alias("dir")).where("dir is not null").distinct()
    dirs = own_dirs.select("dir", F.explode(F.array_distinct(ups)).alias("up"))
    nearest = dirs.join(at_dir, "up").groupBy("dir").agg(F.max_by(F.struct("license", "license_path"), F.length("up")).alias("near"))
    # one directory may hold a third of all files: where directories are few, none is gathered
    out = told.join(F.broadcast(nearest) if own_dirs.limit(FEW + 1).count() <= FEW else nearest, "dir", "left")
    has_own = F.col("own").isNotNull()
    return out.select(
        *[F.col(f"__c{x}").alias(c) for x, c in enumerate(carry)],
        "path", "own", "cosine", F.coalesce("own", "near.license").alias("license"),
        F.when(has_own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has_own, F.col("path")).otherwise(F.col("near.license_path")).alias("license_path"),
    )

