"""Value patterns, the type ladder and temporal roles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns in order; on equal coverage the earlier wins. Fixed values.
PATTERNS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$",
    "phone": r"^[\+]?[\d\s\-\(\)]{7,20}$",
    "boolean": r"^(true|false|yes|no|0|1|y|n|t|f)$",
    "numeric_code": r"^\d{2,20}$",
    "alphanumeric_code": r"^[A-Za-z0-9\-_]{2,30}$",
}
PATTERN_LEAST = 0.30
KEY_PATTERNS = ("uuid", "numeric_code", "alphanumeric_code")

#: Spellings of truth values. Fixed values.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "y", "n", "t", "f")
TRUE_WORDS = ("true", "yes", "y", "t", "1")
INTEGER = r"^\-?\d{1,19}$"
DECIMAL = r"^\-?\d+\.?\d*$"
#: Timestamp formats in order. Fixed values.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd-HH.mm.ss.SSSSSS", "yyyy-MM-dd-HH.mm.ss.SSS", "yyyy-MM-dd-HH.mm.ss",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mm:ssZ",
    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss.SSS", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss.SSS", "MM-dd-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss",
    "yyyyMMddHHmmss", "yyyy/MM/dd HH:mm:ss", "dd-MMM-yyyy HH:mm:ss", "MMM dd, yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy.MM.dd HH:mm:ss",
)
#: Date formats in order. Fixed values.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyyMMdd", "dd-MMM-yyyy", "MMM dd, yyyy", "dd.MM.yyyy", "yyyy.MM.dd")
TYPE_LEAST, FORMAT_SURE = 0.80, 0.95

#: Roles of temporal columns: the first expression found in the lower-cased name. Fixed values.
ROLES = (
    ("valid_from", r"valid_from|effective_from|eff_from|begin_d(at)?e"),
    ("valid_to", r"valid_to|effective_to|eff_to|expir(y|ation)_d(at)?e"),
    ("valid_from", r"_start$|start_d(at)?e|start_dt|start_ts|^start$"),
    ("valid_to", r"_end$|end_d(at)?e|end_dt|end_ts|^end$"),
    ("effective_date", r"effective_d(at)?e|eff_d(at)?e|as_of_d(at)?e"),
    ("load_date", r"load_d(at)?e|load_ts|loaded_at|ingestion_d(at)?e|etl_d(at)?e"),
    ("snapshot_date", r"snapshot_d(at)?e|snap_d(at)?e|batch_d(at)?e"),
    ("created_date", r"created_(at|d(at)?e|ts|on)|insert_d(at)?e|creat(e|ion)_d(at)?e"),
    ("updated_date", r"updated_(at|d(at)?e|ts|on)|modified_(at|d(at)?e)|last_change|upd(t)?_d(at)?e"),
)
UNNAMED_HINTS = ("date", "time", "ts", "dt", "_at", "_d_")


def pattern_hits(value: Column) -> dict[str, Column]:
    return {name: value.rlike(rx) for name, rx in PATTERNS.items()}


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shape(value: Column) -> Column:
    """The value with every digit as 9 and every letter as A: one pass, against which all formats are tried."""
    return F.translate(value, _DIGITS + _LETTERS, "9" * 10 + "A" * 52)


def format_shapes(fmt: str) -> list[str]:
    """Shapes of the strings that a format can parse: fractions have 1 to n digits, zones a sign."""
    plain = re.sub(r"'([^']*)'", lambda m: "A" * len(m[1]), fmt.replace("MMM", "\0"))
    fraction = re.search("S+", plain)
    fill = lambda s: re.sub("[yMdHms]", "9", s).replace("\0", "AAA")
    heads = [fill(plain)] if not fraction else [fill(plain[: fraction.start()]) + "9" * n + fill(plain[fraction.end() :]) for n in range(1, len(fraction[0]) + 1)]
    return [h[:-1] + z for h in heads for z in ("+9999", "-9999")] if fmt.endswith("Z") else heads


def parses(value: Column, fmt: str) -> Column:
    """Does the trimmed value parse? The parser only sees values of the format's shape."""
    t = F.trim(value)
    return shape(t).isin(format_shapes(fmt)) & F.try_to_timestamp(t, F.lit(fmt)).isNotNull()


def type_hits(value: Column) -> dict[str, Column]:
    """boolean, bigint, double and one entry per format."""
    t = F.trim(value)
    hits = {"boolean": F.lower(t).isin(*BOOLEAN_WORDS), "bigint": t.rlike(INTEGER), "double": t.rlike(DECIMAL)}
    hits |= {f"timestamp:{f}": parses(value, f) for f in TIMESTAMP_FORMATS}
    return hits | {f"date:{f}": parses(value, f) for f in DATE_FORMATS}


def dominant_pattern(counts: dict[str, int], non_null: int) -> tuple[str, float]:
    if not non_null:
        return "unknown", 0.0
    best = max(PATTERNS, key=lambda p: counts.get(p, 0))  # the first of equals
    coverage = counts.get(best, 0) / non_null
    return (best, round(coverage, 4)) if coverage >= PATTERN_LEAST else ("free_text", round(1 - coverage, 4))


def climb(counts: dict[str, int], total: int) -> tuple[str, str | None, float] | None:
    """The type ladder: (type, format, share) of the first rung that enough values reach."""
    if not total:
        return None
    for rung in ("boolean", "bigint", "double"):
        share = counts.get(rung, 0) / total
        if share >= TYPE_LEAST:
            return rung, None, round(share, 4)
    for target, formats in (("timestamp", TIMESTAMP_FORMATS), ("date", DATE_FORMATS)):
        shares = [counts.get(f"{target}:{f}", 0) / total for f in formats]
        sure = next((i for i, s in enumerate(shares) if s >= FORMAT_SURE), None)
        at = sure if sure is not None else max(range(len(shares)), key=lambda i: shares[i])
        if shares[at] >= TYPE_LEAST:
            return target, formats[at], round(shares[at], 4)
    return None


def role_of(name: str) -> str | None:
    low = name.lower()
    return next((role for role, rx in ROLES if re.search(rx, low)), None)


def role_col(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for role, rx in reversed(ROLES):
        out = F.when(F.lower(name).rlike(rx), F.lit(role)).otherwise(out)
    return out


def typed(value: Column, target: str, fmt: str | None) -> Column:
    """The value as its inferred type; what does not parse is null."""
    if target == "boolean":
        low = F.lower(F.trim(value))
        return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*BOOLEAN_WORDS), F.lit(False))
    if target in ("bigint", "double"):
        return F.trim(value).try_cast(target)
    parsed = F.try_to_timestamp(F.trim(value), F.lit(fmt))
    return parsed.cast("date") if target == "date" else parsed
