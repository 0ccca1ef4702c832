"""Lines, snippets, hashes, secrets and model replies as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts by which a value is told to be a stand-in.
STANDINS = ["none", "null", "true", "false", "undefined", "n/a", "changeme", "replace_me", "your_", "example", "test"]
#: Assignments of a quoted value to a name that speaks of a secret.
ASSIGNMENT = r"""(?i)(api_key|apikey|secret|token|password|passwd|auth|credential)\s*[:=]\s*["']([^"']+)["']"""


def line_count(content: Column) -> Column:
    """A line feed at the end begins no further line; an empty text has none."""
    return F.when(F.length(content) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(content, "\n$", ""), "\n", -1))).cast("long")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def checksum_holds(content: Column, expected: Column) -> Column:
    return F.sha2(content, 256) == F.lower(expected)


def snippet(content: Column, line: Column, context: int = 3) -> Column:
    """array<struct<n, text>> of the lines from context before to context after a 1-based line."""
    lines = F.split(content, "\r?\n")
    first = F.greatest(line - context, F.lit(1))
    return F.transform(F.slice(lines, first, F.greatest(F.least(line + context, F.size(lines)) - first + 1, F.lit(0))), lambda t, i: F.struct((first + i).cast("int").alias("n"), t.alias("text")))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"']+|[\"']+$", "")


def looks_secret(value: Column) -> Column:
    low = F.lower(value)
    standin = F.lit(False)
    for s in STANDINS:
        standin = standin | F.contains(low, F.lit(s))
    n = F.octet_length(value)
    return (n >= 8) & ~value.rlike(r"^[<\[{]") & ~standin & value.rlike(r"[0-9]|[^\p{L}\p{N}]") & ((n >= 16) | value.rlike("[0-9]")) & value.rlike(r"[\p{L}0-9]")


def entropy(value: Column) -> Column:
    """Shannon bits per character."""
    chars = F.split(value, "")
    kinds = F.array_distinct(chars)
    n = F.size(chars).cast("double")
    return F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def is_random(value: Column, threshold: float = 4.5) -> Column:
    """Entropy over the threshold; hex digits, which hold 4 bits at most, over three quarters of that."""
    return F.when(value.rlike("^[0-9a-fA-F]+$"), entropy(value) >= 0.75 * 4.0).otherwise(entropy(value) >= threshold)


def model_json(reply: Column) -> Column:
    """The JSON of a model's reply: a json fence, else any fence but for its first line, else from the first bracket to its last partner, else all."""
    marked = F.regexp_extract(reply, r"(?s)```json(.*?)```", 1)
    fenced = F.regexp_extract(reply, r"(?s)```[^\n]*\n(.*?)```", 1)
    obj, arr = F.instr(reply, "{"), F.instr(reply, "[")
    by_object = (obj > 0) & ((arr == 0) | (obj < arr))
    raw = F.when(by_object, F.regexp_extract(reply, r"(?s)(\{.*\})", 1)).when(arr > 0, F.regexp_extract(reply, r"(?s)(\[.*\])", 1)).otherwise("")
    return F.regexp_replace(F.when(F.contains(reply, F.lit("```json")) & (marked != ""), marked).when(fenced != "", fenced).when(raw != "", raw).otherwise(reply), r"^\s+|\s+$", "")


#: Marks code that was cut.
CUT = "\n... (truncated)"


def prompt(language: Column, path: Column, function: Column, code: Column, most: int = 8000) -> Column:
    """The question for a model; code is cut after so many bytes, before a character that would be cut in part, and marked."""
    cut = F.when(F.octet_length(code) <= most, code).otherwise(F.concat(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(code, "UTF-8"), 1, most).cast("string")), "�+$", ""), F.lit(CUT)))
    return F.concat(F.lit("Review this "), language, F.lit(" code for security weaknesses.\nFile: "), path, F.coalesce(F.concat(F.lit("\nFunction: "), function), F.lit("")), F.lit("\n```\n"), cut, F.lit("\n```\nReply with a JSON object that has a list named vulnerabilities."))
