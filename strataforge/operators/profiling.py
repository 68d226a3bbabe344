"""Table profiles: frequency core or wide aggregation, assembled into dataclasses or rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timezone
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.config import ProfilingConfig
from strataforge.functions.patterns import climb, dominant_pattern
from strataforge.models import PROFILE_SCHEMA, ColumnProfile, InferredType, PatternType, ProfileResult, TableMetrics, TableProfile
from strataforge.operators import frequency as fq
from strataforge.operators.tuning import auto_sample, cached, table_metrics, tune_profiling
from strataforge.progress import ProgressTracker

VERIFY_UNIQUENESS, VERIFY_NULLS = 0.85, 0.10


class ProfileEngine:
    def __init__(self, spark: SparkSession, config: ProfilingConfig | None = None, progress_callback=None):
        self.spark, self.config, self.callback = spark, config or ProfilingConfig(), progress_callback

    def profile_table(self, df: DataFrame, table_name: str, catalog: str | None = None, schema: str | None = None, metrics: TableMetrics | None = None) -> TableProfile:
        """Two actions on a table (statistics and quantiles), a third where keys of a sampled one are verified."""
        metrics = metrics or table_metrics(df)
        cfg = tune_profiling(self.config, metrics)
        part, sampled, fraction = auto_sample(df, cfg.sample_threshold_rows, cfg.sample_fraction, max(metrics.row_count, 0))
        fields = df.schema.fields
        if cfg.approx_distinct:
            by = {r["ordinal"]: r.asDict() for r in fq.wide_statistics(part, cfg.column_batch_size, True, cfg.max_top_values).collect()}  # one row per column
            for r in by.values():
                r["examples"] = sorted(t["value"] for t in r.setdefault("top", None) or () if t["value"].strip(" "))[:5]
        else:
            with cached(fq.frequencies(part)) as freq:
                rows = fq.value_statistics(freq).join(F.broadcast(fq.top_values(freq, cfg.max_top_values)), "ordinal", "left")
                rows = rows.join(F.broadcast(fq.example_values(freq.where("text"))), "ordinal", "left")
                by = {r["ordinal"]: r.asDict() for r in rows.collect()}
        self._limit(part, by, cfg, metrics.row_count)
        numeric = [f.name for f in fields if fq.is_numeric(f.dataType)]
        spread = fq.quantiles(part, numeric, cfg.approx_quantile_error)
        columns = tuple(self._column(i, f, by.get(i), spread.get(f.name)) for i, f in enumerate(fields))
        count = max((c.total_count for c in columns), default=max(metrics.row_count, 0))
        full = metrics.row_count if metrics.row_count >= 0 else count
        if sampled:
            columns = self._verify(df, columns)
        return TableProfile(table_name, full if sampled else count, columns, catalog, schema, sampled, fraction, count if sampled else None)

    def _limit(self, part: DataFrame, by: dict[int, dict], cfg: ProfilingConfig, rows: int) -> None:
        """Where settings bound the rows that patterns or types are judged on, those counts come from as many rows."""
        text = [f.name for f in part.schema.fields if fq.is_string(f.dataType)]
        for limit, counts, base in ((cfg.pattern_sample_rows, "pattern_counts", "pattern_base"), (cfg.type_sample_rows, "type_counts", "type_base")):
            if limit is None or not text or 0 <= rows <= limit:
                continue
            for r in fq.value_statistics(fq.frequencies(part.limit(limit), text)).collect():  # one row per column
                if r["ordinal"] in by:
                    by[r["ordinal"]] |= {counts: r[counts], base: r["total_count"] - r["null_count"] if counts == "pattern_counts" else r["filled_count"]}

    def _column(self, i: int, f, r: dict | None, spread) -> ColumnProfile:
        kind, numeric = str(f.dataType), fq.is_numeric(f.dataType)
        if r is None or not r["total_count"]:
            return ColumnProfile(f.name, kind, 0, 0, 0.0, 0, 0.0, is_numeric=numeric, ordinal=i)
        total, nulls = r["total_count"], r["null_count"]
        filled = total - nulls
        pattern, coverage, inferred = "unknown", 0.0, None
        if fq.is_string(f.dataType) and filled:
            pattern, coverage = dominant_pattern(r["pattern_counts"], r.get("pattern_base", filled))
            got = climb(r["type_counts"], r.get("type_base", r["filled_count"]))
            inferred = InferredType(*got, tuple(r["examples"] or ())) if got else None
        distinct = min(r["distinct_count"], filled)
        return ColumnProfile(
            f.name, kind, total, nulls, round(nulls / total, 6), distinct, round(min(distinct / filled, 1.0), 6) if filled else 0.0, r["min_value"], r["max_value"],
            None if r["mean_length"] is None else round(r["mean_length"], 2), r["max_length"], numeric, PatternType(pattern), coverage,
            tuple((t["value"], t["cnt"]) for t in r["top"] or ()), spread, inferred, i,
        )

    def _verify(self, df: DataFrame, columns: tuple[ColumnProfile, ...]) -> tuple[ColumnProfile, ...]:
        """Exact distinct and null counts, over the whole table, of the columns that look like keys."""
        keys = [c for c in columns if c.uniqueness >= VERIFY_UNIQUENESS and c.null_rate <= VERIFY_NULLS]
        if not keys:
            return columns
        exact = {r["column_name"]: r for r in verified_keys(df, [c.column_name for c in keys]).collect()}

        def fix(c: ColumnProfile) -> ColumnProfile:
            r = exact.get(c.column_name)
            return c if r is None else replace(c, distinct_count=r["distinct_count"], null_rate=r["null_rate"], uniqueness=r["uniqueness"])

        return tuple(map(fix, columns))

    def profile_tables(self, tables: dict[str, DataFrame], metrics: dict[str, TableMetrics] | None = None) -> ProfileResult:
        """Tables in the order given, whatever order their jobs end in."""
        tracker = ProgressTracker("profiling", len(tables), self.callback)
        done, lock = 0, Lock()

        def one(item):
            nonlocal done
            name, df = item
            out = self.profile_table(df, name, metrics=(metrics or {}).get(name))
            with lock:  # tables end in several threads
                done += 1
                tracker.update(done, f"table:{name}", f"Profiled {name}")
            return out

        workers = min(self.config.max_parallel_tables, len(tables))
        if workers > 1:
            with ThreadPoolExecutor(workers) as pool:
                found = tuple(pool.map(one, tables.items()))
        else:
            found = tuple(map(one, tables.items()))
        tracker.complete("Profiling done")
        return ProfileResult(found, datetime.now(timezone.utc).isoformat())


def verified_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, total_count, null_count, distinct_count, null_rate, uniqueness), exact.

    Native-typed values are unpivoted per column as hashes of their type's own form would lose
    exactness, so the string form is counted: equal for all types but binary and signed zeros.
    """
    freq = fq.frequencies(df, columns)
    names = df.sparkSession.createDataFrame([(df.columns.index(c), c) for c in columns], "ordinal int, column_name string")
    s = freq.groupBy("ordinal").agg(F.sum("cnt").alias("total_count"), F.sum(F.when(F.col("value").isNull(), F.col("cnt")).otherwise(0)).alias("null_count"), F.count("value").alias("distinct_count"))
    filled = F.col("total_count") - F.col("null_count")
    return s.join(F.broadcast(names), "ordinal").select(
        "column_name", "total_count", "null_count", "distinct_count", F.round(F.col("null_count") / F.col("total_count"), 6).alias("null_rate"),
        F.when(filled > 0, F.round(F.least(F.col("distinct_count") / filled, F.lit(1.0)), 6)).otherwise(0.0).alias("uniqueness"),
    )


def profile_frame(spark: SparkSession, result: ProfileResult) -> DataFrame:
    """The result as rows, one per column."""
    rows = []
    for t in result.tables:
        for c in t.column_profiles:
            it = c.inferred_type
            rows.append((
                t.table_name, c.ordinal, c.column_name, c.spark_type, c.total_count, c.null_count, float(c.null_rate), c.distinct_count, float(c.uniqueness), c.min_value, c.max_value,
                c.mean_length, c.max_length, c.is_numeric, c.dominant_pattern.value, float(c.pattern_coverage), [tuple(v) for v in c.top_values],
                list(c.approx_quantiles) if c.approx_quantiles else None, (it.spark_target_type, it.format_string, it.confidence, list(it.sample_values)) if it else None,
            ))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)
