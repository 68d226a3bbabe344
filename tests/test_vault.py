import pytest

from strataforge import DbtConfig, ForgePipeline
from strataforge.models import AnalysisResult, BusinessKeyCandidate, ColumnProfile, DataVaultSpec, HistorizationInfo, HubSpec, InferredType, LinkSpec, ProfileResult, Relationship, SatelliteSpec, SCDType, SimilarityMatch, TableProfile, TemporalColumn
from strataforge.plans import materialize as mz
from strataforge.plans.dbt import DbtGenerator
from strataforge.plans.report import GREEN, Report
from strataforge.plans.vault import VaultDesigner
from strataforge.sources.store import decode, encode, load_results, save_results

yaml = pytest.importorskip("yaml")


def column(name, **kw):
    return ColumnProfile(name, "StringType()", 1000, 0, 0.0, 1000, 1.0, **kw)


def table(name, *columns):
    return TableProfile(name, 1000, columns)


PROFILE = ProfileResult((
    table("customers", column("customer_id", approx_quantiles=(25.0, 50.0, 75.0), top_values=(("a", 3),)), column("customer_name")),
    table("orders", column("order_id"), column("cust_id"), column("amount", inferred_type=InferredType("double", None, 1.0, ("1.5",))), column("day", inferred_type=InferredType("date", "MM/dd/yyyy", 0.9)), column("valid_from")),
), "2024-01-01T00:00:00+00:00")
ANALYSIS = AnalysisResult(
    {"customers": (BusinessKeyCandidate("customers", "customer_id", 0.95, 1.0, 0.0, 1.0, ("Low null rate",)),), "orders": (BusinessKeyCandidate("orders", "order_id", 0.9, 1.0, 0.0, 1.0),)},
    (SimilarityMatch("customers", "customer_id", "orders", "cust_id", 0.7, 0.9, 1.0, 0.82, "value_overlap"),),
    (Relationship("customers", "customer_id", "orders", "cust_id", 0.92, "1:N"),),
    {"orders": HistorizationInfo("orders", SCDType.TYPE2, (TemporalColumn("orders", "valid_from", "valid_from", 0.9),), ("order_id",), 0.8)},
)
SPEC = VaultDesigner().suggest(PROFILE, ANALYSIS)


def test_design():
    assert [h.hub_name for h in SPEC.hubs] == ["hub_customer", "hub_order"]
    assert [x.link_name for x in SPEC.links] == ["lnk_customer_order"] and SPEC.links[0].foreign_key_columns == {"hub_customer": ("cust_id",), "hub_order": ("order_id",)}
    sats = {s.satellite_name: s for s in SPEC.satellites}
    assert sats["sat_customer_customers"].descriptive_columns == ("customer_name",)
    assert sats["sat_order_orders"].descriptive_columns == ("amount", "day") and sats["sat_eff_customer_order"].is_effectivity
    assert SPEC.source_mappings["orders"] == ["hub_order", "lnk_customer_order", "sat_order_orders", "sat_eff_customer_order"]


def test_hubs_merge_and_names_do_not_collide():
    keys = {t: (BusinessKeyCandidate(t, c, 1.0, 1, 0, 1),) for t, c in (("a", "cust_id"), ("b", "customer"), ("c", "cust_key"))}
    m = (SimilarityMatch("a", "cust_id", "b", "customer", 1, 1, 1, 1, "exact_name"),)
    v = VaultDesigner().suggest(ProfileResult((), ""), AnalysisResult(keys, m))
    assert [h.hub_name for h in v.hubs] == ["hub_cust", "hub_cust_c"] and v.hubs[0].source_tables == ("a", "b") and v.hubs[0].key_by_source == {"a": "cust_id", "b": "customer"}


def test_dbt_files(tmp_path):
    g = DbtGenerator(SPEC, DbtConfig(load_date_column="ldts", record_source_column="rsrc"), PROFILE)
    files = g.generate_all()
    hub, link = files["models/raw_vault/hubs/hub_customer.sql"], files["models/raw_vault/links/lnk_customer_order.sql"]
    assert "automate_dv.hub" in hub and '"customer_hk"' in hub and "ldts" in hub and "rsrc" in hub and 'source_model = "stg_customers"' in hub
    assert "automate_dv.link" in link and 'src_fk = ["customer_hk", "order_hk"]' in link
    sat = files["models/raw_vault/satellites/sat_order_orders.sql"]
    assert "automate_dv.sat" in sat and '{"is_hashdiff": true, "columns": ["amount", "day"]}' in sat
    eff = files["models/raw_vault/satellites/sat_eff_customer_order.sql"]
    assert "automate_dv.eff_sat" in eff and 'src_dfk = "customer_hk"' in eff and 'src_sfk = ["order_hk"]' in eff and '"effective_to"' in eff
    pre = files["models/staging/pre_stg_orders.sql"]
    assert "TO_DATE(`day`, 'MM/dd/yyyy') AS day" in pre and "CAST(`amount` AS DOUBLE)" in pre and "source('staging', 'orders')" in pre
    assert "models/staging/pre_stg_customers.sql" not in files
    stage = files["models/staging/stg_orders.sql"]
    meta = yaml.safe_load(stage.split("-%}")[1].split("{%-")[0])
    assert meta["source_model"] == {"staging": "pre_stg_orders"} and meta["hashed_columns"]["customer_hk"] == ["cust_id"]
    assert meta["hashed_columns"]["hashdiff"] == {"is_hashdiff": True, "columns": ["amount", "day"]}
    assert yaml.safe_load(files["models/staging/sources.yml"])["sources"][0]["tables"] == [{"name": "customers"}, {"name": "orders"}]
    models = yaml.safe_load(files["models/raw_vault/schema.yml"])["models"]
    assert models[0]["columns"][0]["tests"] == ["unique", "not_null"] and len(models) == 6
    written = g.write_to_disk(str(tmp_path))
    assert sorted(written) == sorted(str(tmp_path / k) for k in files) and (tmp_path / "models/staging/sources.yml").exists()


def test_report():
    text = Report(PROFILE, ANALYSIS, SPEC, {"models/raw_vault/hubs/hub_customer.sql": "", "models/staging/stg_customers.sql": ""})
    out = text.to_text()
    for s in ("PROFILING SUMMARY", "1,000", "BUSINESS KEY CANDIDATES", "0.95", "CROSS-TABLE MATCHES", "cust_id", "1:N", "HISTORIZATION", "type2", "valid_from", "DATA VAULT SUGGESTION", "lnk_customer_order", "GENERATED FILES", "stg_customers.sql"):
        assert s in out
    html = text.to_html()
    assert all(s in html for s in ("<h1", "<table", "<details>", "<summary", GREEN, "hub_customer"))
    assert "<script>" not in Report(ProfileResult((table("<script>", column("x")),), "")).to_html()
    assert "PROFILING" not in Report().to_text()


def test_json_round_trip(tmp_path):
    path = str(tmp_path / "d" / "r.json")
    save_results(path, PROFILE, ANALYSIS)
    assert load_results(path) == (PROFILE, ANALYSIS)
    save_results(path, PROFILE)
    assert load_results(path) == (PROFILE, None)
    assert decode(DataVaultSpec, encode(SPEC)) == SPEC
    assert decode(ColumnProfile, encode(column("x")) | {"approx_quantiles": [], "unknown": 1}).approx_quantiles is None


def test_materialized_vault(spark, customers, orders, order_history):
    spec = DataVaultSpec(
        (HubSpec("hub_customer", ("customer_id", "cust_id"), ("customers", "orders"), "customer_hk", {"customers": "customer_id", "orders": "cust_id"}), HubSpec("hub_order", ("order_id",), ("orders",), "order_hk")),
        (LinkSpec("lnk", ("hub_customer", "hub_order"), {"hub_customer": ("cust_id",), "hub_order": ("order_id",)}, ("orders",), "lnk_hk"),),
    )
    tables = {"customers": customers, "orders": orders}
    hub = mz.hub_rows(spec.hubs[0], tables)
    assert hub.count() == 5 and {r["record_source"] for r in hub.collect()} == {"customers"}
    link = mz.link_rows(spec.links[0], spec, tables)
    assert link.count() == 6 and link.select("customer_hk").subtract(hub.select("customer_hk")).count() == 0
    sat = mz.satellite_rows(SatelliteSpec("s", "hub_order", "hub", ("status",), "order_history"), spec, order_history, "valid_from")
    assert sat.count() == 5
    assert mz.satellite_rows(SatelliteSpec("s", "hub_order", "hub", ("total_amount",), "order_history"), spec, order_history, "valid_from").count() == 3


def test_pipeline(spark, sample_tables, order_history, tmp_path):
    events = []
    p = ForgePipeline(spark, sample_tables, progress_callback=events.append)
    files = p.run_all()
    assert files and p.profile_result and p.analysis_result and p.vault_spec and p.write_dbt_project(str(tmp_path / "out"))
    assert {e.stage for e in events} == {"profiling", "analysis"} and events[-1].step == "complete"
    assert "customers" in p.report() and "customers" in p.report("html")
    with pytest.raises(ValueError):
        p.report("pdf")
    p.override_business_keys({"customers": ["email"]})
    assert p.analysis_result.business_keys["customers"][0].reasoning == ("Manually specified",)
    p.override_vault_spec(SPEC)
    assert p.vault_spec is SPEC
    p.run_analysis()
    path = str(tmp_path / "cache.json")
    p.save_results(path)
    q = ForgePipeline(spark, sample_tables | {"history": order_history})
    q.load_results(path)
    assert q.run_profiling().table("customers") == p.profile_result.table("customers") and len(q.profile_result.tables) == 3
    a = q.run_analysis()
    assert a.historization["history"].scd_type is SCDType.TYPE2 and set(a.business_keys) == {"customers", "orders", "history"}
    q.tables = {"orders": sample_tables["orders"]}
    assert [t.table_name for t in q.run_profiling({"orders"}).tables] == ["orders"]


def test_project_files_hold_the_settings():
    cfg = DbtConfig(project_name="mine", hash_function="SHA", hash_concat_separator="~", automate_dv_version="0.11", target_schema_business="bv", generate_project_yml=True)
    files = DbtGenerator(DataVaultSpec(), cfg).generate_all()
    assert all(x in files["dbt_project.yml"] for x in ('name: "mine"', 'hash: "SHA"', 'concat_string: "~"', "+schema: bv")) and '"0.11"' in files["packages.yml"]
    assert "dbt_project.yml" not in DbtGenerator(DataVaultSpec()).generate_all()
