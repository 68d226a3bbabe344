import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.config import AnalysisConfig, ProfilingConfig
from strataforge.models import PatternType, TableMetrics
from strataforge.operators import frequency as fq
from strataforge.operators import tuning as tn
from strataforge.operators.profiling import ProfileEngine, profile_frame


def strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


@pytest.mark.parametrize("approx", [False, True])
def test_profile_of_customers(spark, customers, approx):
    t = ProfileEngine(spark, ProfilingConfig(approx_distinct=approx, auto_tune=False)).profile_table(customers, "customers")
    assert t.row_count == 5 and len(t.column_profiles) == 6
    key = t.column("customer_id")
    assert key.uniqueness == 1.0 and key.distinct_count == 5 and key.min_value == "C001" and key.mean_length == 4.0
    assert t.column("email").dominant_pattern is PatternType.EMAIL and t.column("email").pattern_coverage >= 0.8
    assert t.column("country").top_values[0] == ("US", 2)
    assert t.column("created_at").mean_length is None
    assert profile_frame(spark, type("R", (), {"tables": (t,)})()).count() == 6


def test_numbers_have_quantiles_and_string_extremes(spark):
    df = spark.createDataFrame([(i,) for i in (9, 10, 2, None)], "n int")
    c = ProfileEngine(spark, ProfilingConfig(approx_distinct=False, auto_tune=False)).profile_table(df, "t").column("n")
    assert (c.min_value, c.max_value) == ("10", "9") and c.is_numeric and c.null_count == 1 and c.null_rate == 0.25
    assert c.approx_quantiles == (2.0, 9.0, 10.0) and c.dominant_pattern is PatternType.UNKNOWN


def test_empty_and_all_null_tables(spark):
    schema = "a int, b string"
    for df in (spark.createDataFrame([], schema), spark.createDataFrame([(None, None)], schema)):
        t = ProfileEngine(spark).profile_table(df, "t")
        assert [c.distinct_count for c in t.column_profiles] == [0, 0] and t.column("a").is_numeric and t.column("b").inferred_type is None


def test_odd_types_and_names(spark):
    df = spark.sql("SELECT array(1, 2) AS `a.b`, map('k', 1) AS m, named_struct('x', 1) AS `s``t`, true AS ok, X'01' AS bin, CAST(1.5 AS DECIMAL(10,2)) AS d")
    for approx in (False, True):
        t = ProfileEngine(spark, ProfilingConfig(approx_distinct=approx, auto_tune=False)).profile_table(df, "odd")
        assert [c.distinct_count for c in t.column_profiles] == [1] * 6 and t.column("d").approx_quantiles


LADDER = [
    ([str(i) for i in range(100)], "bigint", None), (["-10", "20", "-30"], "bigint", None), (["1.5", "2.75", "100.00", "0.99"], "double", None), (["true", "false", "True", "FALSE", "yes"], "boolean", None),
    (["Y", "N", "y"], "boolean", None), (["2024-01-15", "2024-02-20"], "date", "yyyy-MM-dd"), (["01/15/2024", "12/25/2024"], "date", "MM/dd/yyyy"), (["2024-01-15 10:30:00", "2024-02-20 11:00:00"], "timestamp", "yyyy-MM-dd HH:mm:ss"),
    (["2024-01-15T10:30:00"], "timestamp", "yyyy-MM-dd'T'HH:mm:ss"), (["2024-01-15-10.30.45.123456"], "timestamp", "yyyy-MM-dd-HH.mm.ss.SSSSSS"), (["2024-01-15 10:30:45.123456"], "timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    (["hello world", "foo bar"], None, None), (["123", "abc", "2024-01-01", "true", "hello"], None, None), ([], None, None), (["20240115", "20240220"], "bigint", None),
]


@pytest.mark.parametrize("values, target, fmt", LADDER)
def test_type_ladder(spark, values, target, fmt):
    got = fq.inferred_types(strings(spark, values), ["v"]).collect()
    assert (got[0]["target_type"], got[0]["format"]) == (target, fmt) if got else target is None


def test_wide_statistics_agree_with_frequencies(spark, customers, orders):
    for df in (customers, orders):
        text = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
        a = {r["ordinal"]: r.asDict() for r in fq.value_statistics(fq.frequencies(df)).collect()}
        for top in (0, 3):
            b = {r["ordinal"]: r.asDict() for r in fq.wide_statistics(df, batch=2, approx=False, top=top).collect()}
            for i in a:
                assert not top or b[i].pop("top") is not None
                if i not in text:
                    a[i]["pattern_counts"] = a[i]["type_counts"] = {}
                assert a[i] == b[i]
        assert ProfileEngine(spark, ProfilingConfig(approx_distinct=True, auto_tune=False, max_top_values=0)).profile_table(df, "t").column_profiles[0].top_values == ()


def test_basic_statistics_without_a_shuffle_per_column(spark, orders):
    plan = fq.basic_statistics(orders)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "CartesianProduct" not in plan


def test_top_values_break_ties_by_value(spark):
    top = fq.top_values(fq.frequencies(strings(spark, ["b", "a", "b", "a", "c", None])), 2).first()["top"]
    assert [(x["value"], x["cnt"]) for x in top] == [("a", 2), ("b", 2)]


@pytest.mark.parametrize("cols, batch", [(20, 50), (21, 30), (100, 30), (101, 15), (300, 15), (301, 8), (1000, 8), (1001, 5)])
def test_batch_by_columns(cols, batch):
    assert tn.tune_profiling(ProfilingConfig(), TableMetrics(10, cols)).column_batch_size == batch


@pytest.mark.parametrize("rows, approx, error, top", [(999, False, 0.001, 50), (50_000, False, 0.005, 30), (100_000, True, 0.005, 20), (1_000_000, True, 0.01, 20), (10_000_000, True, 0.01, 10), (50_000_000, True, 0.05, 10)])
def test_settings_by_rows(rows, approx, error, top):
    c = tn.tune_profiling(ProfilingConfig(), TableMetrics(rows, 5))
    assert (c.approx_distinct, c.approx_quantile_error, c.max_top_values) == (approx, error, top)


def test_named_settings_and_unknown_sizes_stay():
    c = tn.tune_profiling(ProfilingConfig(max_top_values=7), TableMetrics(10, 5))
    assert c.max_top_values == 7 and c.column_batch_size == 50
    assert tn.tune_profiling(ProfilingConfig(), TableMetrics(-1, 500)).approx_quantile_error == 0.01
    assert tn.tune_profiling(ProfilingConfig(auto_tune=False), TableMetrics(10, 5000)).column_batch_size == 50
    assert tn.tune_analysis(AnalysisConfig(), {"a": TableMetrics(5, 1), "b": TableMetrics(10**6, 1)}).value_sample_size == 5
    assert tn.tune_analysis(AnalysisConfig(), {"a": TableMetrics(10**6, 1)}).value_sample_size == 50_000


def test_sampling(spark):
    df = spark.range(10_000)
    part, sampled, fraction = tn.auto_sample(df, threshold=1_000)
    assert sampled and fraction == 0.1 and 800 < part.count() < 1200
    assert tn.auto_sample(df, threshold=10_000)[1] is False and tn.auto_sample(df, forced=5.0)[2] == 1.0
    t = ProfileEngine(spark, ProfilingConfig(sample_threshold_rows=1_000)).profile_table(df.withColumn("k", F.col("id").cast("string")), "big")
    assert t.sampled and t.row_count == 10_000 and t.sampled_row_count < 1200
    assert t.column("k").distinct_count == 10_000 and t.column("k").uniqueness == 1.0  # verified on the whole table


def test_top_values_of_many_flat_values_are_exact(spark):
    df = spark.range(40_000).select(F.concat(F.lit("k"), F.lpad((F.col("id") % 15_000).cast("string"), 5, "0")).alias("k"), (F.col("id") % 15_000).alias("n"))
    t = ProfileEngine(spark, ProfilingConfig(approx_distinct=True, auto_tune=False)).profile_table(df, "flat")
    n = ProfilingConfig().max_top_values
    assert t.column("k").top_values == tuple((f"k{i:05d}", 3) for i in range(n))
    assert t.column("n").top_values == tuple((x, 3) for x in sorted(str(i) for i in range(10_000))[:n])


def test_exact_quantiles_against_sorted_lists(spark):
    import math
    import random

    rnd = random.Random(2)
    cols = [[rnd.gauss(0, 10) for _ in range(3000)], [float(rnd.randrange(3)) for _ in range(3000)], [None] * 3000, [rnd.choice([None, 5.0, 1e9, -1.0]) for _ in range(3000)]]
    df = spark.createDataFrame(list(zip(*cols)), "a double, b double, c double, d double").repartition(5)
    got = fq.quantiles(df, ["a", "b", "c", "d"], probabilities=(0.0, 0.25, 0.5, 0.75, 0.99, 1.0))
    for name, values in zip("abcd", cols):
        x = sorted(v for v in values if v is not None)
        assert got[name] == (tuple(x[max(0, math.ceil(p * len(x)) - 1)] for p in (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)) if x else None)
    assert fq.quantiles(df.limit(0), ["a"]) == {"a": None}


def test_rows_that_patterns_and_types_are_judged_on(spark):
    """Settings bound the rows; other numbers are of all rows."""
    from strataforge.config import ProfilingConfig
    from strataforge.operators.profiling import ProfileEngine

    df = spark.createDataFrame([(str(i),) for i in range(20)] + [("some words here",)] * 180, "v string").coalesce(1)
    every = ProfileEngine(spark, ProfilingConfig(auto_tune=False, approx_distinct=False)).profile_table(df, "t").column("v")
    some = ProfileEngine(spark, ProfilingConfig(auto_tune=False, approx_distinct=False, pattern_sample_rows=20, type_sample_rows=20)).profile_table(df, "t").column("v")
    assert every.inferred_type is None and every.dominant_pattern.value == "free_text"
    assert some.inferred_type.spark_target_type == "bigint" and some.inferred_type.confidence == 1.0 and some.dominant_pattern.value == "numeric_code"
    assert (some.total_count, some.distinct_count, some.null_count) == (every.total_count, every.distinct_count, every.null_count) == (200, 21, 0)
