"""Table sizes, sampling and the settings that follow from sizes."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.config import AnalysisConfig, ProfilingConfig, changed
from strataforge.models import TableMetrics

SEED = 42
#: (upper bound, setting): the first bound that is not passed counts. Fixed values.
BATCH_BY_COLUMNS = ((20, 50), (100, 30), (300, 15), (1000, 8), (None, 5))
ERROR_BY_ROWS = ((50_000, 0.001), (1_000_000, 0.005), (50_000_000, 0.01), (None, 0.05))
TOP_BY_ROWS = ((1_000, 50), (100_000, 30), (10_000_000, 20), (None, 10))
APPROX_FROM_ROWS = 100_000
VALUES_BY_ROWS = ((10_000, None), (1_000_000, 10_000), (None, 50_000))


def pick(steps, x: int, inclusive: bool = False):
    return next(v for bound, v in steps if bound is None or x < bound or inclusive and x == bound)


def plan_row_count(df: DataFrame) -> int | None:
    """Row count from the optimizer's statistics, where it has one."""
    try:
        n = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
        return int(n.get().toString()) if n.isDefined() else None
    except (AttributeError, Py4JError):  # a session without a JVM, or a plan without statistics
        return None


def table_metrics(df: DataFrame) -> TableMetrics:
    rows = plan_row_count(df)
    if rows is None:
        try:
            rows = df.count()
        except AnalysisException:  # not a table that can be counted; a failed job is an error
            rows = -1
    return TableMetrics(rows, len(df.columns))


def sample_fraction(rows: int, threshold: int, forced: float | None = None) -> float | None:
    """Fraction to sample a table of so many rows by, None for all of it."""
    if forced is not None:
        return max(0.0001, min(1.0, forced))
    return threshold / rows if rows > threshold else None


def auto_sample(df: DataFrame, threshold: int = 10_000_000, forced: float | None = None, rows: int | None = None) -> tuple[DataFrame, bool, float | None]:
    fraction = sample_fraction(df.count() if rows is None and forced is None else rows or 0, threshold, forced)
    return (df, False, None) if fraction is None else (df.sample(fraction, seed=SEED), True, fraction)


def tune_profiling(base: ProfilingConfig, m: TableMetrics) -> ProfilingConfig:
    """Settings by size; named fields stay, and an unknown row count changes the batch only."""
    if not base.auto_tune:
        return base
    found = {"column_batch_size": pick(BATCH_BY_COLUMNS, m.column_count, inclusive=True)}
    if m.row_count >= 0:
        found |= {"approx_distinct": m.row_count >= APPROX_FROM_ROWS, "approx_quantile_error": pick(ERROR_BY_ROWS, m.row_count), "max_top_values": pick(TOP_BY_ROWS, m.row_count)}
    return changed(base, **{k: v for k, v in found.items() if k not in base.named})


def tune_analysis(base: AnalysisConfig, tables: dict[str, TableMetrics]) -> AnalysisConfig:
    known = [m.row_count for m in tables.values() if m.row_count >= 0]
    if not known or "value_sample_size" in base.named:
        return base
    return changed(base, value_sample_size=pick(VALUES_BY_ROWS, min(known)) or min(known))


def tuned_settings(metrics: DataFrame) -> DataFrame:
    """The same rules as columns, for a table of (table_name, row_count, column_count)."""

    def steps(c: str, table, inclusive: bool = False):
        out = None
        for bound, v in reversed(table):
            here = F.lit(v)
            out = here if bound is None else F.when(F.col(c) <= bound if inclusive else F.col(c) < bound, here).otherwise(out)
        return out

    return metrics.select(
        "table_name", "row_count", "column_count", steps("column_count", BATCH_BY_COLUMNS, True).alias("column_batch_size"), (F.col("row_count") >= APPROX_FROM_ROWS).alias("approx_distinct"),
        steps("row_count", ERROR_BY_ROWS).alias("quantile_error"), steps("row_count", TOP_BY_ROWS).alias("max_top_values"),
    )


class cached:
    """with cached(df) as d: d is persisted where the platform allows it, and released after."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __enter__(self) -> DataFrame:
        try:
            self.held = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        except PySparkException:  # a platform without caches
            self.held = None
        return self.held if self.held is not None else self.df

    def __exit__(self, *_):
        if self.held is not None:
            try:
                self.held.unpersist()
            except PySparkException:
                pass
