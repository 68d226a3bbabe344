"""Similar columns across tables, and the foreign keys that follow."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.config import AnalysisConfig
from strataforge.functions.names import fk_stem_col, levenshtein_ratio_col, name_similarity, name_similarity_col, normalized, suggests_fk
from strataforge.models import ColumnProfile, PatternType, ProfileResult, Relationship, SimilarityMatch
from strataforge.operators.overlap import overlap_map

CODE_LIKE = {PatternType.UUID, PatternType.NUMERIC_CODE, PatternType.ALPHANUMERIC_CODE}
MIN_DISTINCT, MAX_NULLS = 5, 0.80
PRUNE_SHARE = 0.4
NAME_CONFIDENCE = 0.70


def comparable(p: ColumnProfile) -> bool:
    return p.dominant_pattern not in (PatternType.FREE_TEXT, PatternType.BOOLEAN) and p.distinct_count >= MIN_DISTINCT and p.null_rate <= MAX_NULLS


def compatible(a: ColumnProfile, b: ColumnProfile) -> bool:
    return a.is_numeric == b.is_numeric and (a.dominant_pattern is b.dominant_pattern or {a.dominant_pattern, b.dominant_pattern} <= CODE_LIKE)


def closeness(x: float, y: float) -> float:
    top = max(x, y)
    return 1.0 - abs(x - y) / top if top else 1.0


def stat_similarity(a: ColumnProfile, b: ColumnProfile) -> float:
    parts = [1.0 - abs(a.uniqueness - b.uniqueness), 1.0 - abs(a.null_rate - b.null_rate)]
    for x, y in ((a.mean_length, b.mean_length), (a.max_length, b.max_length)):
        if x is not None and y is not None:
            parts.append(closeness(x, y))
    return sum(parts) / len(parts)


def match_type(name: float, stat: float, value: float) -> str:
    return "exact_name" if name >= 0.95 else "value_overlap" if value >= 0.70 else "statistical" if stat >= 0.85 else "semantic"


def similarity_matches(result: ProfileResult, tables: dict[str, DataFrame], cfg: AnalysisConfig | None = None, changed: set[str] | None = None, previous: tuple[SimilarityMatch, ...] = ()) -> tuple[SimilarityMatch, ...]:
    """Cheap scores prune pairs of columns first; the values of what is left are compared in one job."""
    cfg = cfg or AnalysisConfig()
    columns = [(t.table_name, p) for t in result.tables for p in t.column_profiles if comparable(p)]
    todo = []
    for (ta, a), (tb, b) in combinations(columns, 2):
        if ta == tb or not compatible(a, b) or changed is not None and ta not in changed and tb not in changed:
            continue
        name, stat = name_similarity(a.column_name, b.column_name), stat_similarity(a, b)
        if cfg.name_similarity_weight * name + cfg.stat_similarity_weight * stat >= PRUNE_SHARE * cfg.min_composite_score:
            todo.append(((ta, a.column_name), (tb, b.column_name), name, stat))
    found = overlap_map(tables, [(x, y) for x, y, *_ in todo], None if cfg.exact_overlap else cfg.value_sample_size)
    out = [m for m in previous if changed is not None and m.table_a not in changed and m.table_b not in changed]
    for x, y, name, stat in todo:
        na, nb, both = found.get((x, y), (0, 0, 0))
        value = both / (na + nb - both) if both else 0.0
        total = cfg.name_similarity_weight * name + cfg.stat_similarity_weight * stat + cfg.value_overlap_weight * value
        if total >= cfg.min_composite_score:
            out.append(SimilarityMatch(*x, *y, round(name, 4), round(stat, 4), round(value, 4), round(total, 4), match_type(name, stat, value)))
    return tuple(sorted(out, key=lambda m: -m.composite_score))


def pair_scores(profiles: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Name and statistical similarity of all comparable pairs of columns of different tables, as columns.

    Profile frames have a row per column, so the pairs are those of columns, not of rows.
    """
    keep = profiles.where(~F.col("dominant_pattern").isin("free_text", "boolean") & (F.col("distinct_count") >= MIN_DISTINCT) & (F.col("null_rate") <= MAX_NULLS))
    a = keep.select(*[F.col(c).alias(f"{c}_a") for c in keep.columns])
    b = (keep if other is None else other).select(*[F.col(c).alias(f"{c}_b") for c in keep.columns])
    code = [p.value for p in CODE_LIKE]
    like = (F.col("dominant_pattern_a") == F.col("dominant_pattern_b")) | F.col("dominant_pattern_a").isin(*code) & F.col("dominant_pattern_b").isin(*code)
    j = a.join(F.broadcast(b), (F.col("table_name_a") < F.col("table_name_b")) & (F.col("is_numeric_a") == F.col("is_numeric_b")) & like)  # a row per column
    near = lambda x: F.when(F.greatest(f"{x}_a", f"{x}_b") > 0, 1.0 - F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")) / F.greatest(f"{x}_a", f"{x}_b")).otherwise(F.lit(1.0))
    known = lambda x: F.col(f"{x}_a").isNotNull() & F.col(f"{x}_b").isNotNull()
    parts = F.array_compact(F.array(
        1.0 - F.abs(F.col("uniqueness_a") - F.col("uniqueness_b")), 1.0 - F.abs(F.col("null_rate_a") - F.col("null_rate_b")),
        F.when(known("mean_length"), near("mean_length")), F.when(known("max_length"), near("max_length")),
    ))
    stat = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)
    return j.select(
        F.col("table_name_a").alias("table_a"), F.col("column_name_a").alias("column_a"), F.col("table_name_b").alias("table_b"), F.col("column_name_b").alias("column_b"),
        F.round(name_similarity_col(F.col("column_name_a"), F.col("column_name_b")), 4).alias("name_similarity"), F.round(stat, 4).alias("statistical_similarity"),
    )


def cardinality(child_uniqueness: float, parent_uniqueness: float) -> str:
    return "N:M" if parent_uniqueness < 0.95 else "1:1" if child_uniqueness >= 0.95 else "1:N"


def relationships(result: ProfileResult, keys: dict[str, str], tables: dict[str, DataFrame], matches: tuple[SimilarityMatch, ...] = (), cfg: AnalysisConfig | None = None,
                  changed: set[str] | None = None, previous: tuple[Relationship, ...] = ()) -> tuple[Relationship, ...]:
    """Parent keys and the columns that refer to them, by similarity, by name and by containment.

    keys: table -> key column, in table order. Every pair of columns appears once; all
    containments that remain after the first two rules are measured in one job.
    """
    cfg = cfg or AnalysisConfig()
    found: dict[tuple[str, str, str, str], Relationship] = {}
    touched = lambda *names: changed is None or any(n in changed for n in names)

    def add(parent: str, child: str, column: str, confidence: float, kind: str) -> None:
        found.setdefault((parent, keys[parent], child, column), Relationship(parent, keys[parent], child, column, round(confidence, 4), kind))

    for r in previous:
        if changed is not None and not touched(r.parent_table, r.child_table):
            found[r.parent_table, r.parent_column, r.child_table, r.child_column] = r
    for m in matches:
        sides = [(m.table_a, m.column_a), (m.table_b, m.column_b)]
        is_key = [keys.get(t) == c for t, c in sides]
        if sum(is_key) == 1:
            (parent, _), (child, column) = sides if is_key[0] else sides[::-1]
            add(parent, child, column, m.composite_score, "1:N")
    plain = [(t, p) for t in result.tables for p in t.column_profiles if keys.get(t.table_name) != p.column_name and p.null_rate <= MAX_NULLS]
    for t, p in plain:
        parent = next((n for n, k in keys.items() if n != t.table_name and suggests_fk(p.column_name, k)), None)
        if parent and touched(parent, t.table_name):
            add(parent, t.table_name, p.column_name, NAME_CONFIDENCE, "1:N")
    todo = []
    for t, p in plain:
        for parent, key in keys.items():
            owner = result.table(parent)
            top = owner.column(key) if owner else None
            if parent != t.table_name and top and top.is_numeric == p.is_numeric and touched(parent, t.table_name) and (parent, key, t.table_name, p.column_name) not in found:
                todo.append((parent, top, t.table_name, p))
    shared = overlap_map(tables, [((child, p.column_name), (parent, top.column_name)) for parent, top, child, p in todo], None if cfg.exact_overlap else cfg.value_sample_size)
    for parent, top, child, p in todo:
        n, _, both = shared.get(((child, p.column_name), (parent, top.column_name)), (0, 0, 0))
        if n and both / n >= cfg.containment_threshold:
            add(parent, child, p.column_name, both / n, cardinality(p.uniqueness, top.uniqueness))
    return tuple(sorted(found.values(), key=lambda r: -r.confidence))


def fk_by_name(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Rule two as columns: columns(table_name, column_name, ordinal) and keys(table_name, column_name, rank) -> parent and child; the first parent in rank order wins."""
    stems = lambda df, c, out: df.withColumn("n_", normalized(F.col(c))).withColumn(out, fk_stem_col(F.col("n_"))).drop("n_")  # noqa: E731  once per name, below the join
    k = stems(keys.select(F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"), "rank"), "parent_column", "k_")
    own = F.broadcast(keys.select("table_name", "column_name"))
    rest = stems(columns.join(own, ["table_name", "column_name"], "left_anti"), "column_name", "c_")
    a, b = F.col("c_"), F.col("k_")
    j = rest.join(F.broadcast(k), (F.col("table_name") != F.col("parent_table")) & (a != "") & (b != "") & ((a == b) | (levenshtein_ratio_col(a, b) >= 0.75)))
    best = j.groupBy("table_name", "column_name").agg(F.min_by(F.struct("parent_table", "parent_column"), "rank").alias("p"))
    return best.select("p.parent_table", "p.parent_column", F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"))
