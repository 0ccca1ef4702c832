"""Versions as keys that Spark orders, and ranges over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEMVER = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$"
_PEP = r"(?i)^v?(?:(\d+)!)?(\d+(?:\.\d+)*)[-_.]?(?:(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+[a-z0-9._-]+)?$"
_DEC = "decimal(20,0)"


def _part(kind: Column | int, num: Column, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("k"), num.cast(_DEC).alias("n"), text.cast("string").alias("s"))


def semver_key(v: Column) -> Column:
    """Null unless it has three numbers. Releases follow their pre-releases; of pre-release parts numbers precede words; build metadata doesn't count."""
    num = lambda i: _part(1, F.regexp_extract(v, _SEMVER, i), F.lit(""))
    pre = F.regexp_extract(v, _SEMVER, 4)
    parts = F.when(pre == "", F.array().cast(f"array<struct<k:int,n:{_DEC},s:string>>")).otherwise(
        F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), _part(0, F.try_to_number(x, F.lit("99999999999999999999")), F.lit(""))).otherwise(_part(1, F.lit(0), x)))
    )
    return F.when(v.rlike(_SEMVER), F.concat(F.array(num(1), num(2), num(3), _part(1, F.when(pre == "", 1).otherwise(0), F.lit(""))), parts))


def pep440_key(v: Column) -> Column:
    """Null unless it is a version; a local label doesn't count."""
    x = F.trim(v)
    get = lambda i: F.regexp_extract(x, _PEP, i)
    num = lambda c: F.coalesce(F.when(c == "", F.lit(0)).otherwise(c.cast(_DEC)), F.lit(0)).cast(_DEC)
    release = F.transform(F.split(F.regexp_replace(get(2), r"(\.0+)+$", ""), r"\."), lambda p: p.cast(_DEC))
    pre, has_post, has_dev = F.lower(get(3)), (get(5) != "") | (get(6) != ""), get(8) != ""
    kind = F.when(pre.isin("a", "alpha"), 1).when(pre.isin("b", "beta"), 2).when(pre != "", 3).when(has_dev & ~has_post, 0).otherwise(4)
    post = F.when(get(5) != "", num(get(5))).when(get(6) != "", num(get(7))).otherwise(F.lit(-1).cast(_DEC))
    return F.when(
        x.rlike(_PEP),
        F.struct(num(get(1)).alias("epoch"), release.alias("release"), kind.alias("kind"), num(get(4)).alias("pre"), post.cast(_DEC).alias("post"), F.when(has_dev, 0).otherwise(1).alias("final"), num(get(9)).alias("dev")),
    )


def fallback_key(v: Column) -> Column:
    """Runs of digits and of other characters; numbers follow words, and a shorter key precedes those it begins."""
    parts = F.filter(F.regexp_extract_all(v, F.lit(r"([0-9]+|[^0-9.\-_+]+)"), 1), lambda x: ~x.rlike("^[0-9]{20,}$") | (F.length(x) < 20))
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), _part(1, F.try_to_number(x, F.lit("99999999999999999999")), F.lit(""))).otherwise(_part(0, F.lit(0), x)))


def _within(key: Callable[[Column], Column], v: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """Bounds that can't be read are passed over; with a fixed version, read or not, the last affected one doesn't count."""
    k, i, f, a = key(v), key(introduced), key(fixed), key(last)
    return F.when(introduced.isNotNull() & i.isNotNull() & (k < i), False).when(fixed.isNotNull(), ~F.coalesce(k >= f, F.lit(False))).when(last.isNotNull() & a.isNotNull(), k <= a).otherwise(True)


def in_range(ecosystem: Column, v: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """By the order of the ecosystem; versions that it can't read, and other ecosystems, by the fallback's order."""
    e = F.lower(ecosystem)
    other = _within(fallback_key, v, introduced, fixed, last)
    semver = F.when(semver_key(v).isNotNull(), _within(semver_key, v, introduced, fixed, last)).otherwise(other)
    pep = F.when(pep440_key(v).isNotNull(), _within(pep440_key, v, introduced, fixed, last)).otherwise(other)
    return F.when(e.isin("npm", "cargo", "crates.io", "go"), semver).when(e == "pypi", pep).otherwise(other)


def range_contains(v: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """Semantic versions only: a bound that can't be read doesn't bound, and a fixed version that can't leaves the last affected one."""
    k, i, f, a = semver_key(v), semver_key(introduced), semver_key(fixed), semver_key(last)
    return F.when(k.isNull(), False).when(i.isNotNull() & (k < i), False).when(f.isNotNull(), k < f).when(a.isNotNull(), k <= a).otherwise(True)


# ---------------------------------------------------------------- range grammars; ranges are literals, so they are read when the plan is made


def _full(text: str) -> tuple[list[int], str, int]:
    """Numbers filled with 0, the pre-release and how many numbers were given."""
    m = re.fullmatch(r"[v=\s]*(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", text)
    if not m:
        raise ValueError(text)
    nums = []
    for g in m.groups()[:3]:
        if g is None or not g.isdigit():
            break
        nums.append(int(g))
    return nums + [0] * (3 - len(nums)), m[4] or "", len(nums)


def _show(nums: list[int], pre: str = "") -> str:
    return ".".join(map(str, nums)) + (f"-{pre}" if pre else "")


def _next(nums: list[int], at: int) -> list[int]:
    return [*nums[:at], nums[at] + 1, *[0] * (2 - at)]


def _one(op: str, text: str, bare: str) -> list[tuple[str, str]]:
    nums, pre, given = _full(text)
    op = op or bare
    if given == 0:
        return []
    if op == "^":
        at = next((i for i, n in enumerate(nums[:given]) if n), given - 1)
        return [(">=", _show(nums, pre)), ("<", _show(_next(nums, at), "0"))]
    if op == "~":
        return [(">=", _show(nums, pre)), ("<", _show(_next(nums, min(1, given - 1)), "0"))]
    if given < 3:
        top = _show(_next(nums, given - 1), "0")
        return {"=": [(">=", _show(nums)), ("<", top)], ">": [(">=", _show(_next(nums, given - 1)))], ">=": [(">=", _show(nums))], "<": [("<", _show(nums, "0"))], "<=": [("<", top)]}[op]
    return [(op, _show(nums, pre))]


def comparators(ecosystem: str, text: str) -> list[list[tuple[str, str]]]:
    """Alternatives, each a list of (operator, version) that must all hold. Raises ValueError for what isn't a range."""
    if ecosystem == "pypi":
        return [[_pep(x.strip()) for x in text.split(",") if x.strip()]]
    out = []
    for part in text.split("||") if ecosystem == "npm" else [text]:
        part = part.strip()
        hyphen = re.fullmatch(r"(\S+)\s+-\s+(\S+)", part) if ecosystem == "npm" else None
        if hyphen:
            out.append(_one(">=", hyphen[1], "=") + _one("<=", hyphen[2], "="))
            continue
        own = []
        for m in re.finditer(r"(\^|~>?|>=|<=|>|<|=)?\s*([^\s,<>=^~|]+)", part):
            own += _one({"~>": "~"}.get(m[1], m[1]) or "", m[2], "=" if ecosystem == "npm" or "*" in m[2] else "^")
        if re.sub(r"(\^|~>?|>=|<=|>|<|=)?\s*([^\s,<>=^~|]+)", "", part).strip(" ,"):
            raise ValueError(part)
        out.append(own)
    return out


def _pep(text: str) -> tuple[str, str]:
    m = re.fullmatch(r"(~=|===|==|!=|<=|>=|<|>)\s*(\S+)", text)
    if not m:
        raise ValueError(text)
    return m[1], m[2]


def satisfies(ecosystem: str, v: Column, text: str) -> Column:
    """Whether versions meet a range; a range or version that can't be read isn't met. Pre-releases meet a range by its bounds alone."""
    try:
        alternatives = comparators(ecosystem, text)
    except (ValueError, KeyError):
        return F.lit(False)
    key = pep440_key if ecosystem == "pypi" else semver_key
    k, out = key(v), F.lit(False)
    for own in alternatives:
        hold = k.isNotNull()
        for op, bound in own:
            hold = hold & _holds(key, k, v, op, bound)
        out = out | hold
    return F.coalesce(out, F.lit(False))


def _holds(key: Callable[[Column], Column], k: Column, v: Column, op: str, bound: str) -> Column:
    if key is pep440_key and (bound.endswith(".*") or op == "~="):
        release = [int(x) for x in re.findall(r"\d+", bound.removesuffix(".*"))]
        prefix = release if bound.endswith(".*") else release[:-1]
        own = F.transform(F.split(F.regexp_extract(F.trim(v), _PEP, 2), r"\."), lambda p: p.cast("long"))
        same = F.lit(True)
        for i, n in enumerate(prefix):
            same = same & (F.coalesce(F.get(own, F.lit(i)), F.lit(0)) == n)
        return ~same if op == "!=" else same if op != "~=" else same & (k >= key(F.lit(bound)))
    b = key(F.lit(bound))
    return {"=": k == b, "==": k == b, "===": k == b, "!=": k != b, "<": k < b, "<=": k <= b, ">": k > b, ">=": k >= b}[op]
