"""Licence scans against a plain version that compares every run of lines of every file with every template, and inheritance walked directory by directory."""

import math
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from vigilspark.llm import entries
from vigilspark.llm.licenses import LEAST, TEMPLATES, WRAP, scanned

cut = lambda t: re.findall("[a-z0-9]+", t.lower())


def plain(files):
    """files: (path, text). (path, own, cosine, license, origin, license_path) of each."""
    total = len(files)
    df = Counter(t for _, text in files for t in set(cut(text or "")))
    idf = lambda t: 1 + math.log((1 + total) / (1 + df[t]))
    known = []
    for name, text in TEMPLATES:
        v = {t: n * idf(t) for t, n in Counter(cut(text)).items()}
        known.append((name, v, math.sqrt(sum(x * x for x in v.values()))))
    some = {t for _, v, _ in known for t in v}
    own = []
    for _, text in files:
        best, lines = [], [cut(x) for x in (text or "").split("\n")]
        for i in range(len(lines)):
            for n in range(1, min(WRAP, len(lines) - i) + 1):
                ts = [t for x in lines[i : i + n] for t in x]
                if not some & set(ts):
                    continue
                v = {t: k * idf(t) for t, k in Counter(ts).items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                for name, w, size in known:
                    c = round(sum(x * v[t] for t, x in w.items() if t in v) / norm / size, 9)
                    if c >= LEAST:
                        best.append((-c, name))
        own.append(min(best, default=None))
    at = {}
    for (path, _), b in zip(files, own, strict=True):
        if b and path and re.match("(?i)(licen[sc]e|copying|notice)", path.rsplit("/", 1)[-1]):
            d = path.rpartition("/")[0]
            at[d] = min(at.get(d, (1, "", "")), (b[0], path, b[1]))
    out = []
    for (path, _), b in zip(files, own, strict=True):
        if b:
            out.append((path, b[1], -b[0], b[1], "own", path))
            continue
        d, near = path.rpartition("/")[0] if path else None, None
        while d is not None and near is None:
            near, d = at.get(d), d.rpartition("/")[0] if d else None
        out.append((path, None, None, near[2] if near else None, "inherited" if near else "none", near[1] if near else None))
    return out


def rows_of(df):
    return sorted((str(r.path), r.own, None if r.cosine is None else round(r.cosine, 6), r.license, r.origin, r.license_path) for r in df.collect())


def expected(files):
    return sorted((str(p), o, None if c is None else round(c, 6), li, og, lp) for p, o, c, li, og, lp in plain(files))


def key(rows):
    """Rows whose cosines are told to five digits, as the sixth may round either way."""
    return [(r[0], r[1], None if r[2] is None else pytest.approx(r[2], abs=2e-6), *r[3:]) for r in rows]


def test_query_equals_brute_force(spark):
    at = "/root/testdata/sf0.01"
    texts = dict(zip(*pq.read_table(f"{at}/documents.parquet").select(["doc_id", "text"]).to_pydict().values(), strict=True))
    got = entries.op6_licenses(spark, at)
    files = [(r.path, texts[r.doc_id]) for r in got.select("path", "doc_id").collect()]
    got, want = rows_of(got), expected(files)
    assert got == key(want) and sum(r[1] is not None for r in want) > 10 and sum(r[4] == "inherited" for r in want) > 10


WRAPPED = {
    "MIT": "Copyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin it",
    "BSD-3-Clause": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "ISC": " * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided",
    "Apache-2.0": "// Licensed under the Apache License, Version 2.0 (the License);\n// you may not use this file except\n// in compliance with the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "GPL-2.0": "it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.",
    "LGPL-3.0": "it under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "AGPL-3.0": "it under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
}


@pytest.mark.parametrize("others", [0, 1, 30])
def test_statements_wrapped_over_lines(spark, others):
    files = [(f"{k}/{j}/x.c", f"{v}\n\nint main;") for k, v in WRAPPED.items() for j in range(2)] + [(f"q/{i}.c", f"code {i}\nof file {i % 7}") for i in range(others)]
    files += [("n/LICENSE.txt", WRAPPED["MIT"]), ("n/a/b/c.c", "int x;"), ("n/a/b/c.c", None), (None, "nothing"), ("", "")]
    df = spark.createDataFrame(files, "path string, text string")
    got = rows_of(scanned(df))
    assert got == key(expected(files))
    assert {r[0].split("/")[0]: r[1] for r in got if r[0].endswith("x.c")} == {k: k for k in WRAPPED}


def test_very_long_texts_and_repeated_words(spark):
    files = [("a/x", "word " * 200_000 + "\nReleased under the MIT License."), ("a/y", "license " * 50_000), ("a/z", "\n" * 100_000 + "Licensed under CC BY 4.0.\n")]
    got = {r[0]: r[1] for r in rows_of(scanned(spark.createDataFrame(files, "path string, text string")))}
    assert got == {"a/x": "MIT", "a/y": None, "a/z": "CC-BY-4.0"}
