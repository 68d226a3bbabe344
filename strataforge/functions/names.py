"""Column names: normal form, tokens and similarity, as Python and as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that mark a foreign key, tried in this order. Fixed values.
FK_SUFFIXES = ("_id", "_key", "_code", "_no", "_ref", "_num", "_number")
#: Names that hint at a key. Fixed value.
KEY_HINT = r"(_id|_key|_code|_no|_num|_number|_ref|_identifier)$|^id$|^key$"
FK_LEAST_RATIO = 0.75


def normalize_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def name_tokens(name: str) -> set[str]:
    return {t for t in normalize_name(name).split("_") if t}


def jaccard_similarity(a: set, b: set) -> float:
    union = len(a | b)
    return len(a & b) / union if union else 1.0


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = i
        diagonal = row[0]
        row[0] = i
        for j, y in enumerate(b, 1):
            left = min(row[j] + 1, left + 1, diagonal + (x != y))
            diagonal, row[j] = row[j], left
    return row[-1]


def levenshtein_ratio(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 - levenshtein(a, b) / longest if longest else 1.0


def strip_common_prefixes(name: str) -> str:
    """The normal form without its first token, if there are several."""
    head, _, rest = normalize_name(name).partition("_")
    return rest or head


def fk_stem(name: str) -> str:
    n = normalize_name(name)
    return next((n.removesuffix(s) for s in FK_SUFFIXES if n.endswith(s)), n)


def suggests_fk(child: str, key: str) -> bool:
    """Does a column's name look like a reference to the key column?"""
    c, k = fk_stem(child), fk_stem(key)
    return bool(c and k) and (c == k or levenshtein_ratio(c, k) >= FK_LEAST_RATIO)


def name_similarity(a: str, b: str) -> float:
    return max(levenshtein_ratio(normalize_name(a), normalize_name(b)), jaccard_similarity(name_tokens(a), name_tokens(b)))


# ---- columns ------------------------------------------------------------------------------


def normalized(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized(c), "_"), lambda t: t != ""))


def levenshtein_ratio_col(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def jaccard_col(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def name_similarity_col(a: Column, b: Column) -> Column:
    return F.greatest(levenshtein_ratio_col(normalized(a), normalized(b)), jaccard_col(tokens(a), tokens(b)))


def fk_stem_col(n: Column) -> Column:
    """Stem of a normal form. One alternation would prefer the longest match; the order of FK_SUFFIXES decides here."""
    out = n
    for s in reversed(FK_SUFFIXES):
        out = F.when(F.endswith(n, F.lit(s)), F.substring(n, F.lit(1), F.length(n) - len(s))).otherwise(out)
    return out
