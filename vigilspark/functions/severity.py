"""Severity, confidence and category ladders as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from least to greatest.
SEVERITIES = ["unknown", "none", "low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]
#: The level and the score that a report gives each severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SCORES = {"critical": 10.0, "high": 8.0, "medium": 5.0, "low": 3.0}
PRECISIONS = {"high": "high", "medium": "medium", "low": "low"}


def ladder(value: Column, table: dict[str, object], other: object) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(other))


def from_cvss(score: Column) -> Column:
    """Null, NaN and negative scores are unknown; NaN is told first because it orders above all numbers."""
    return F.when(score.isNull() | F.isnan(score), "unknown").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").when(score == 0, "none").otherwise("unknown")


def rank(severity: Column) -> Column:
    return ladder(severity, {s: i for i, s in enumerate(SEVERITIES)}, 0).cast("int")


def parsed(text: Column, other: str = "low") -> Column:
    """A severity as a user writes it; moderate is medium."""
    t = F.lower(text)
    return F.when(t == "moderate", "medium").when(t.isin(SEVERITIES), t).otherwise(other)


def at_least(severity: Column, least: str) -> Column:
    return rank(severity) >= SEVERITIES.index(least if least in SEVERITIES else "low")


def level(severity: Column) -> Column:
    return ladder(severity, LEVELS, "none")


def score(severity: Column) -> Column:
    return ladder(severity, SCORES, 0.0)


#: The category of a rule by the first of these parts that its id holds.
CATEGORIES = [
    (("unsafe",), "unsafe-code"),
    (("injection", "sql", "cmd"), "injection"),
    (("xss", "innerhtml", "document-write"), "xss"),
    (("path", "traversal"), "path-traversal"),
    (("crypto", "weak"), "crypto"),
    (("auth", "password", "secret"), "auth"),
    (("race", "toctou", "mktemp"), "race-condition"),
    (("dos", "redos", "timeout"), "dos"),
    (("memory", "transmute", "pointer", "panic", "refcell"), "memory-safety"),
    (("unbounded", "defer-in-loop"), "unbounded-resource"),
    (("prototype", "pollution"), "prototype-pollution"),
]


def category(rule_id: Column) -> Column:
    out = F
    for parts, name in CATEGORIES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(rule_id, F.lit(p))
        out = out.when(hit, F.lit(name))
    return out.otherwise("other")


def confidence(severity: Column, text: Column, language: Column, before: Column) -> Column:
    """High for critical and high rules, else medium; low where the text speaks of tests or a safety comment stands before Rust code."""
    testlike = F.contains(text, F.lit("test")) | F.contains(text, F.lit("mock")) | F.contains(text, F.lit("example"))
    safe = (language == "rust") & (F.contains(before, F.lit("// SAFETY:")) | F.contains(before, F.lit("// safety:")))
    return F.when(testlike | F.coalesce(safe, F.lit(False)), "low").when(severity.isin("critical", "high"), "high").otherwise("medium")
