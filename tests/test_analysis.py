import pytest

from strataforge.config import AnalysisConfig, ProfilingConfig
from strataforge.models import AnalysisResult, SCDType, SimilarityMatch
from strataforge.operators import keys as ky
from strataforge.operators import overlap as ov
from strataforge.operators import relations as rl
from strataforge.operators.profiling import ProfileEngine, profile_frame


@pytest.fixture(scope="module")
def profiles(spark, sample_tables):
    return ProfileEngine(spark, ProfilingConfig(approx_distinct=False, auto_tune=False)).profile_tables(sample_tables)


def test_tables_keep_their_order(profiles):
    assert [t.table_name for t in profiles.tables] == ["customers", "orders"]


def test_business_keys(profiles, sample_tables):
    c = ky.key_candidates(profiles.table("customers"), None)
    assert c[0].column_name == "customer_id" and c[0].score >= 0.7 and "hardly a null" in c[0].reasoning
    o = ky.key_candidates(profiles.table("orders"), None)
    assert o[0].column_name == "order_id" and "quantity" not in [x.column_name for x in o[:2]]


def test_key_scores_as_columns_agree(spark, profiles):
    got = {(r["table_name"], r["column_name"]): r["score"] for r in ky.key_scores(profile_frame(spark, profiles)).collect()}
    want = {(c.table_name, c.column_name): c.score for t in profiles.tables for c in ky.key_candidates(t, None)}
    assert got == pytest.approx(want)


def profile(spark, df, name):
    return ProfileEngine(spark, ProfilingConfig(approx_distinct=False, auto_tune=False)).profile_table(df, name)


def test_type2_and_dedup(spark, order_history):
    p = profile(spark, order_history, "h")
    temporal = ky.temporal_columns(order_history, "h", p.column_profiles)
    assert {t.role for t in temporal} == {"valid_from", "valid_to"} and all(t.confidence == 0.9 for t in temporal)
    keys = ky.key_candidates(p, order_history, temporal)
    assert keys[0].column_name == "order_id" and keys[0].uniqueness == 1.0 and "versions are merged" in keys[0].reasoning[0]
    h = ky.historization(p, order_history, keys)
    assert h.scd_type is SCDType.TYPE2 and h.confidence > 0.5 and h.version_key_columns == ("order_id",)


def test_type2_from_string_dates(spark):
    rows = [("H1", "A001", "100", "2024-01-01", "2024-06-30"), ("H1", "A001", "150", "2024-07-01", "9999-12-31"), ("H2", "A002", "200", "2024-01-01", "9999-12-31"), ("H3", "A003", "300", "2024-01-01", "2024-03-31"), ("H3", "A003", "350", "2024-04-01", "9999-12-31")]
    df = spark.createDataFrame(rows, "hldg_id string, account string, value string, d_hldg_start string, d_hldg_end string")
    p = profile(spark, df, "holdings")
    temporal = ky.temporal_columns(df, "holdings", p.column_profiles)
    assert [t.confidence for t in temporal] == [0.75, 0.75]
    assert ky.historization(p, df, ky.key_candidates(p, df, temporal)).scd_type is SCDType.TYPE2


def test_snapshot_flat_and_none(spark, customers):
    from datetime import date

    df = spark.createDataFrame([(k, date(2024, 1, d)) for d in range(1, 7) for k in range(3)], "id int, snapshot_date date")
    p = profile(spark, df, "s")
    assert ky.historization(p, df, ky.key_candidates(p, df)).scd_type is SCDType.SNAPSHOT
    c = profile(spark, customers, "c")
    assert ky.historization(c, customers, ky.key_candidates(c, None)).scd_type is SCDType.TYPE1
    bare = customers.select("customer_id")
    assert ky.historization(profile(spark, bare, "b"), bare, ()).scd_type is SCDType.NONE


def brute_overlap(a, b):
    x, y = ({r[0] for r in d.collect() if r[0] is not None} for d in (a, b))
    return len(x), len(y), len(x & y)


def test_overlap_against_brute_force(spark, customers, orders, sample_tables):
    pair = (("orders", "cust_id"), ("customers", "customer_id"))
    assert ov.overlap_map(sample_tables, [pair])[pair] == brute_overlap(orders.select("cust_id"), customers.select("customer_id"))
    assert ov.overlap_map(sample_tables, []) == {}
    with_null = {"a": spark.createDataFrame([(None,), (1,), (2,)], "x int"), "b": spark.createDataFrame([("1",), ("9",), (None,)], "y string")}
    p = (("a", "x"), ("b", "y"))
    assert ov.overlap_map(with_null, [p])[p] == (2, 2, 1)  # compared as strings


def test_similarity_and_relationships(spark, profiles, sample_tables):
    m = rl.similarity_matches(profiles, sample_tables)
    assert any({x.column_a, x.column_b} == {"customer_id", "cust_id"} for x in m) and all(x.table_a != x.table_b for x in m)
    r = rl.relationships(profiles, {"customers": "customer_id", "orders": "order_id"}, sample_tables, m)
    fk = next(x for x in r if x.child_column == "cust_id")
    assert (fk.parent_table, fk.parent_column) == ("customers", "customer_id")
    assert len({(x.parent_table, x.child_table, x.child_column) for x in r}) == len(r)
    contained = rl.relationships(profiles, {"customers": "customer_id", "orders": "order_id"}, sample_tables, ())
    assert any(x.child_column == "cust_id" and x.confidence == 1.0 or x.confidence == 0.7 for x in contained)


def test_cardinality_and_types():
    assert [rl.cardinality(*x) for x in ((1, 1), (0.5, 1), (0.5, 0.5))] == ["1:1", "1:N", "N:M"]
    assert [rl.match_type(*x) for x in ((0.95, 0, 0), (0, 0, 0.7), (0, 0.85, 0), (0, 0, 0))] == ["exact_name", "value_overlap", "statistical", "semantic"]


def test_incremental_similarity_keeps_old_pairs(profiles, sample_tables):
    old = (SimilarityMatch("x", "a", "y", "b", 1, 1, 1, 1, "exact_name"), SimilarityMatch("orders", "a", "y", "b", 1, 1, 1, 1, "exact_name"))
    m = rl.similarity_matches(profiles, sample_tables, AnalysisConfig(), {"orders"}, old)
    assert old[0] in m and old[1] not in m


def test_analysis_result_is_a_value():
    assert AnalysisResult().top_keys() == {}
