"""Queries against their SQL on the small driver tables, where these exist."""

import math
import os

import pytest

import __spark_entry__ as entry
from strataforge.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
FAST = ["profile_basic_orders", "profile_basic_events", "null_profile", "pattern_coverage_nation", "dominant_pattern_region", "type_inference_orders", "timestamp_format_search", "pre_stage_cast", "quantiles_exact",
        "top_values_orders", "temporal_roles", "name_similarity_pairs", "fk_name_heuristic", "dedup_uniqueness", "version_stats", "containment_fk", "hub_load", "link_load", "satellite_history", "auto_tune", "stream_profile",
        "vault_rules", "dbt_models", "historization_kinds", "all_formats", "reports", "approx_statistics_lineitem", "approx_distinct_error", "bottom_hash_sample", "relationships_by_similarity"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, int, str)):
        return v
    try:
        return round(float(v), 6)
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
