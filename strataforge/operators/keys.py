"""Temporal roles, business keys and historization."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.config import AnalysisConfig
from strataforge.functions.names import KEY_HINT
from strataforge.functions.patterns import KEY_PATTERNS, UNNAMED_HINTS, role_of
from strataforge.models import BusinessKeyCandidate, ColumnProfile, HistorizationInfo, PatternType, SCDType, TableProfile, TemporalColumn
from strataforge.operators.frequency import TEMPORAL, frequencies, quoted

MAX_KEY_NULLS, MIN_KEY_SCORE, KEY_PATTERN_COVERAGE = 0.10, 0.30, 0.80
MIN_DEDUP_GAIN = 0.05
VERSION_RATIO, SNAPSHOT_DATES = 1.3, 5


def temporal_columns(df: DataFrame, table: str, profiles: tuple[ColumnProfile, ...] = ()) -> tuple[TemporalColumn, ...]:
    """From names, types and profiles; no job."""
    by = {p.column_name: p for p in profiles}
    out = []
    for f in df.schema.fields:
        p = by.get(f.name)
        native = isinstance(f.dataType, TEMPORAL)
        looks = p is not None and (p.dominant_pattern is PatternType.DATE_ISO or (p.inferred_type is not None and p.inferred_type.spark_target_type in ("date", "timestamp")))
        role = role_of(f.name)
        if role:
            out.append(TemporalColumn(table, f.name, role, 0.9 if native else 0.75 if looks else 0.5))
        elif (native or looks) and any(h in f.name.lower() for h in UNNAMED_HINTS):
            out.append(TemporalColumn(table, f.name, "unknown_temporal", 0.4))
    return tuple(out)


def roles_of(found: tuple[TemporalColumn, ...]) -> set[str]:
    return {t.role for t in found}


def opens_and_closes(roles: set[str]) -> tuple[bool, bool]:
    return bool(roles & {"valid_from", "effective_date"}), "valid_to" in roles


# ---- business keys ------------------------------------------------------------------------


def dedup_uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, distinct_count, entity_count, dedup_uniqueness): distinct values against the most distinct column.

    For versioned tables, in which every entity has several rows.
    """
    freq = frequencies(df, columns).where("value IS NOT NULL").groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))
    names = df.sparkSession.createDataFrame([(df.columns.index(c), c) for c in columns], "ordinal int, column_name string")
    both = freq.join(F.broadcast(names), "ordinal")
    top = both.agg(F.max("distinct_count").alias("entity_count"))
    return both.crossJoin(F.broadcast(top)).select("column_name", "distinct_count", "entity_count", F.round(F.col("distinct_count") / F.col("entity_count"), 6).alias("dedup_uniqueness"))  # one row beside one per column


def key_candidates(profile: TableProfile, df: DataFrame | None, temporal: tuple[TemporalColumn, ...] = (), cfg: AnalysisConfig | None = None) -> tuple[BusinessKeyCandidate, ...]:
    cfg = cfg or AnalysisConfig()
    away = {t.column_name for t in temporal}
    usable = [p for p in profile.column_profiles if p.column_name not in away and p.null_rate <= MAX_KEY_NULLS]
    deduped: dict[str, float] = {}
    if df is not None and usable and all(opens_and_closes(roles_of(temporal))):
        for r in dedup_uniqueness(df, [p.column_name for p in usable]).collect():
            p = profile.column(r["column_name"])
            raw = r["distinct_count"] / p.total_count if p.total_count else 0.0
            if abs(r["dedup_uniqueness"] - raw) > MIN_DEDUP_GAIN:
                deduped[p.column_name] = r["dedup_uniqueness"]
    out = [c for p in usable if (c := _candidate(profile.table_name, p, deduped.get(p.column_name), cfg)).score >= MIN_KEY_SCORE]
    return tuple(sorted(out, key=lambda c: -c.score))


def _candidate(table: str, p: ColumnProfile, deduped: float | None, cfg: AnalysisConfig) -> BusinessKeyCandidate:
    unique = p.uniqueness if deduped is None else deduped
    why = []
    parts = {"uniqueness": min(1.0, unique / cfg.uniqueness_threshold), "nulls": 1.0 - p.null_rate, "pattern": 0.0, "name": 0.0}
    if unique >= cfg.uniqueness_threshold:
        why.append(f"{unique:.2%} of the values differ" if unique == p.uniqueness else f"{unique:.2%} of the values differ once versions are merged ({p.uniqueness:.2%} of the rows)")
    if p.null_rate <= cfg.null_rate_threshold:
        parts["nulls"] = 1.0
        why.append("hardly a null")
    if p.dominant_pattern.value in KEY_PATTERNS and p.pattern_coverage >= KEY_PATTERN_COVERAGE:
        parts["pattern"] = p.pattern_coverage
        why.append(f"values are {p.dominant_pattern.value}")
    if re.search(KEY_HINT, p.column_name, re.I):
        parts["name"] = 1.0
        why.append(f"{p.column_name} is a name of keys")
    weights = {"uniqueness": cfg.uniqueness_weight, "nulls": cfg.null_rate_weight, "pattern": cfg.pattern_weight, "name": cfg.name_heuristic_weight}
    return BusinessKeyCandidate(table, p.column_name, round(sum(weights[k] * v for k, v in parts.items()), 4), unique, p.null_rate, p.pattern_coverage, tuple(why))


def key_scores(profiles: DataFrame, cfg: AnalysisConfig | None = None) -> DataFrame:
    """The same score as columns, for frames in PROFILE_SCHEMA: (table_name, column_name, score) of the kept ones."""
    cfg = cfg or AnalysisConfig()
    u = F.when(F.col("uniqueness") >= cfg.uniqueness_threshold, 1.0).otherwise(F.col("uniqueness") / cfg.uniqueness_threshold)
    n = F.when(F.col("null_rate") <= cfg.null_rate_threshold, 1.0).otherwise(1.0 - F.col("null_rate"))
    p = F.when(F.col("dominant_pattern").isin(*KEY_PATTERNS) & (F.col("pattern_coverage") >= KEY_PATTERN_COVERAGE), F.col("pattern_coverage")).otherwise(0.0)
    h = F.when(F.col("column_name").rlike(f"(?i){KEY_HINT}"), 1.0).otherwise(0.0)
    score = F.round(cfg.uniqueness_weight * u + cfg.null_rate_weight * n + cfg.pattern_weight * p + cfg.name_heuristic_weight * h, 4)
    return profiles.where(F.col("null_rate") <= MAX_KEY_NULLS).select("table_name", "column_name", score.alias("score")).where(F.col("score") >= MIN_KEY_SCORE)


# ---- historization ------------------------------------------------------------------------


def version_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: n_keys, avg_versions, max_versions. A null key is a key."""
    return df.groupBy(quoted(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_keys"), F.avg("n").alias("avg_versions"), F.max("n").alias("max_versions"))


def versioned(df: DataFrame, key: str, ratio: float = VERSION_RATIO) -> tuple[bool, float]:
    try:
        r = version_stats(df, key).first()
    except AnalysisException:  # a type that can't be grouped
        return False, 0.0
    if r is None or r["avg_versions"] is None or not (r["avg_versions"] >= ratio or r["max_versions"] > 1):
        return False, 0.0
    return True, min(1.0, 0.5 + (r["avg_versions"] - 1.0) * 0.3)


def snapshot_dates(df: DataFrame, column: str) -> DataFrame:
    """One row: n_dates, a null counting as one."""
    return df.groupBy(quoted(column).alias("d")).agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n_dates"))


def historization(profile: TableProfile, df: DataFrame, candidates: tuple[BusinessKeyCandidate, ...], temporal: tuple[TemporalColumn, ...] | None = None) -> HistorizationInfo:
    """At most one job over the table for versions and one for snapshots."""
    temporal = temporal_columns(df, profile.table_name, profile.column_profiles) if temporal is None else temporal
    info = lambda kind, keys, sure: HistorizationInfo(profile.table_name, kind, temporal, keys, sure)
    if not temporal:
        return info(SCDType.NONE, (), 0.9)
    opens, closes = opens_and_closes(roles_of(temporal))
    key = candidates[0].column_name if candidates else None
    is_versioned, sure = versioned(df, key) if key and opens else (False, 0.0)
    if is_versioned and closes:
        return info(SCDType.TYPE2, (key,), sure)
    snapshot = next((t.column_name for t in temporal if t.role == "snapshot_date"), None)
    if snapshot is not None and (n := snapshot_dates(df, snapshot).first()["n_dates"]) >= SNAPSHOT_DATES:
        return info(SCDType.SNAPSHOT, (key,) if key else (), min(1.0, 0.6 + 0.02 * n))
    if is_versioned:
        return info(SCDType.TYPE2, (key,), sure * 0.8)
    return info(SCDType.TYPE1, (), 0.5)
