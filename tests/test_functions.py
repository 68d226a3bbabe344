import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.functions import names as nm
from strataforge.functions import patterns as pt


@pytest.mark.parametrize("raw, want", [("Customer ID", "customer_id"), ("customerId", "customerid"), ("  __a--b__ ", "a_b"), ("", "")])
def test_normalize(raw, want):
    assert nm.normalize_name(raw) == want


def test_levenshtein_and_jaccard():
    assert nm.levenshtein_ratio("", "") == 1 and nm.levenshtein_ratio("a", "") == 0
    assert nm.levenshtein_ratio("kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert nm.jaccard_similarity(set(), set()) == 1 and nm.jaccard_similarity({1}, set()) == 0
    assert nm.jaccard_similarity({1, 2}, {2, 3}) == pytest.approx(1 / 3)
    assert nm.name_tokens("Customer_Order-ID") == {"customer", "order", "id"}
    assert nm.strip_common_prefixes("tbl_customer_id") == "customer_id" and nm.strip_common_prefixes("customer") == "customer"


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_levenshtein_is_a_metric(a, b):
    d = nm.levenshtein(a, b)
    assert d == nm.levenshtein(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def test_fk_stems():
    assert nm.fk_stem("x_key_id") == "x_key" and nm.fk_stem("cust_code") == "cust"
    assert nm.suggests_fk("customer_ref", "customer_id") and not nm.suggests_fk("qty", "customer_id")


def test_columns_agree_with_python(spark):
    words = ["Customer ID", "cust_id", "orderNumber", "order_no", "x_key_id", "", "a--b", "Region"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    rows = df.select("a", "b", nm.name_similarity_col(F.col("a"), F.col("b")).alias("s"), nm.normalized(F.col("a")).alias("n")).withColumn("stem", nm.fk_stem_col(F.col("n"))).collect()
    for r in rows:
        assert r["s"] == pytest.approx(nm.name_similarity(r["a"], r["b"])) and r["n"] == nm.normalize_name(r["a"]) and r["stem"] == nm.fk_stem(r["a"])


@pytest.mark.parametrize("name, role", [("valid_from", "valid_from"), ("D_HLDG_START", "valid_from"), ("period_end", "valid_to"), ("created_at", "created_date"), ("payload_date", "load_date"), ("o_orderdate", None)])
def test_roles(spark, name, role):
    assert pt.role_of(name) == role
    assert spark.createDataFrame([(name,)], "n string").select(pt.role_col(F.col("n"))).first()[0] == role


def test_dominant_pattern():
    assert pt.dominant_pattern({}, 0) == ("unknown", 0.0)
    assert pt.dominant_pattern({"phone": 8, "numeric_code": 8}, 10) == ("phone", 0.8)
    assert pt.dominant_pattern({"uuid": 2}, 10) == ("free_text", 0.8)


def test_every_format_parses_its_own_stamps(spark):
    df = spark.sql("SELECT timestamp'2024-03-15 10:30:45.123456' AS t")
    for f in (*pt.TIMESTAMP_FORMATS, *pt.DATE_FORMATS):
        assert df.select(pt.parses(F.date_format("t", f), f)).first()[0], f
    bad = spark.createDataFrame([("1/5/2024",), ("2024-02-30",), ("",), (None,)], "v string")
    assert [r[0] for r in bad.select(pt.parses(F.col("v"), "MM/dd/yyyy") | pt.parses(F.col("v"), "yyyy-MM-dd")).collect()] in ([False, False, False, None], [False, False, False, False])
