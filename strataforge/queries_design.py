"""Driver queries of the design part on a small catalogue of its own, each beside SQL that derives the same from it.

The catalogue stands for what profiling and analysis found; hubs, links, satellites and the text of models
follow from it by rule, so SQL over the same literal rows can say them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.patterns import DATE_FORMATS, TIMESTAMP_FORMATS, parses
from strataforge.models import (AnalysisResult, BusinessKeyCandidate, ColumnProfile, DataVaultSpec, HistorizationInfo, ProfileResult, Relationship, SCDType,
                                SimilarityMatch, TableProfile, TemporalColumn)
from strataforge.operators import keys as ky
from strataforge.plans.dbt import DbtGenerator
from strataforge.plans.vault import VaultDesigner

#: (table, key), (table, columns), (parent, key, child, column, confidence), (table, table) of one key, (table, temporal column, role).
KEYS = [("customers", "customer_id"), ("crm_contacts", "customer_id"), ("orders", "order_id"), ("products", "Product_Key"), ("stores", "store-no")]
COLUMNS = [
    ("customers", "customer_id name email"), ("crm_contacts", "customer_id phone"), ("orders", "order_id cust_ref prod_no amount status valid_from valid_to"),
    ("products", "Product_Key title"), ("stores", "store-no"), ("notes", "line text"),
]
REFERENCES = [("customers", "customer_id", "orders", "cust_ref", 0.9), ("products", "Product_Key", "orders", "prod_no", 0.8), ("customers", "customer_id", "orders", "order_id", 0.5), ("crm_contacts", "customer_id", "customers", "email", 0.4)]
SAME_KEY = [("customers", "crm_contacts")]
TEMPORAL = [("orders", "valid_from", "valid_from"), ("orders", "valid_to", "valid_to")]


def catalogue() -> tuple[ProfileResult, AnalysisResult]:
    tables = tuple(TableProfile(t, 10, tuple(ColumnProfile(c, "StringType()", 10, 0, 0.0, 10, 1.0) for c in cols.split())) for t, cols in COLUMNS)
    keys = dict(KEYS)
    found = AnalysisResult(
        {t: (BusinessKeyCandidate(t, k, 0.9, 1.0, 0.0, 1.0),) for t, k in KEYS},
        tuple(SimilarityMatch(a, keys[a], b, keys[b], 1.0, 1.0, 0.9, 0.95, "exact_name") for a, b in SAME_KEY),
        tuple(Relationship(*r, "1:N") for r in REFERENCES),
        {"orders": HistorizationInfo("orders", SCDType.TYPE2, tuple(TemporalColumn(t, c, r, 0.9) for t, c, r in TEMPORAL), ("order_id",), 0.9)},
    )
    return ProfileResult(tables, "2024-01-01T00:00:00"), found


def design() -> DataVaultSpec:
    return VaultDesigner().suggest(*catalogue())


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = design()
    rows = [("hub", h.hub_name, ",".join(h.source_tables), ",".join(h.business_key_columns), h.hash_key_name) for h in v.hubs]
    rows += [("link", x.link_name, ",".join(x.source_tables), ",".join(f"{h}={','.join(x.foreign_key_columns[h])}" for h in x.hub_references), x.hash_key_name) for x in v.links]
    rows += [("effectivity" if s.is_effectivity else "satellite", s.satellite_name, s.source_table, ",".join(s.descriptive_columns), s.parent_name) for s in v.satellites]
    return spark.createDataFrame(rows, "kind string, name string, sources string, columns string, owner string")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_quote(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _normal(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


#: Hubs (of the first table of each key group), links (the first reference of a pair) and satellites of the catalogue.
CTES = f"""k AS (SELECT t, c, row_number() OVER () AS o FROM {_values([(t, c, i) for i, (t, c) in enumerate(KEYS)])} AS x(t, c, i)),
l AS (SELECT k.*, coalesce((SELECT min(a) FROM {_values(SAME_KEY)} AS s(a, b) WHERE s.b = k.t), k.t) AS lead FROM k),
g AS (SELECT l.*, f.o AS lo, regexp_replace(regexp_replace({_normal('f.c')}, '_id$', ''), '_key$', '') AS base FROM l JOIN k f ON l.lead = f.t),
h AS (SELECT 'hub_' || base AS hub, base, string_agg(DISTINCT t, ',' ORDER BY t) AS sources, string_agg(DISTINCT c, ',') AS keys, base || '_hk' AS hk FROM g GROUP BY base),
r AS (SELECT *, row_number() OVER () AS n FROM {_values([(*r[:4], i) for i, r in enumerate(REFERENCES)])} AS x(pt, pc, ct, cc, i)),
p AS (SELECT r.i, p.base AS pb, c.base AS cb, r.cc, c.c AS ck, r.ct FROM r JOIN g p ON p.t = r.pt JOIN g c ON c.t = r.ct WHERE p.base <> c.base),
x AS (SELECT * FROM (SELECT least(pb, cb) AS a, greatest(pb, cb) AS b, CASE WHEN pb < cb THEN cc ELSE ck END AS fa, CASE WHEN pb < cb THEN ck ELSE cc END AS fb, ct, row_number() OVER (PARTITION BY least(pb, cb), greatest(pb, cb) ORDER BY i) AS n FROM p) WHERE n = 1),
c AS (SELECT t, unnest(string_split(cols, ' ')) AS c, generate_subscripts(string_split(cols, ' '), 1) AS o FROM {_values(COLUMNS)} AS x(t, cols)),
u AS (SELECT t, c FROM k UNION SELECT t, c FROM {_values([(t, c) for t, c, _ in TEMPORAL])} AS y(t, c) UNION SELECT ct, fa FROM x UNION SELECT ct, fb FROM x),
s AS (SELECT 'sat_' || g.base || '_' || {_normal('c.t')} AS sat, 'hub_' || g.base AS hub, g.base || '_hk' AS hk, c.t, list(c.c ORDER BY c.o) AS cols FROM c JOIN g ON g.t = c.t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.t = c.t AND u.c = c.c) GROUP BY ALL)"""

RULES_SQL = f"""WITH {CTES}
SELECT 'hub' AS kind, hub AS name, sources, keys AS columns, hk AS owner FROM h
UNION ALL SELECT 'link', 'lnk_' || a || '_' || b, ct, 'hub_' || a || '=' || fa || ',hub_' || b || '=' || fb, a || '_' || b || '_hk' FROM x
UNION ALL SELECT 'satellite', sat, t, array_to_string(cols, ','), hub FROM s
UNION ALL SELECT 'effectivity', 'sat_eff_' || a || '_' || b, ct, '', 'lnk_' || a || '_' || b FROM x WHERE ct IN (SELECT t FROM {_values(TEMPORAL)} AS y(t, c, r))"""


def models_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = DbtGenerator(design()).generate_all()
    rows = [(path, text) for path, text in files.items() if "/raw_vault/" in path and path.endswith(".sql") or path.endswith("sources.yml")]
    return spark.createDataFrame(rows, "path string, text string")


def _model(macro: str, args: list[tuple[str, str]]) -> str:
    """SQL for a model's text; args: (name, SQL that gives the literal)."""
    sets = " || ".join(f"'{{% set {k} = ' || {v} || ' %}}' || chr(10)" for k, v in args)
    names = (",\n" + " " * (len(macro) + 16)).join(f"{k}={k}" for k, _ in args)
    return "'{{ config(materialized=''incremental'', schema=''raw_vault'') }}' || chr(10) || chr(10) || " + sets + f" || chr(10) || {_quote('{{ automate_dv.' + macro + '(' + names + ') }}')} || chr(10)"


_one = lambda x: f"'\"' || {x} || '\"'"
_many = lambda x: f"'[\"' || array_to_string({x}, '\", \"') || '\"]'"
_stg = lambda t: f"'stg_' || {_normal(t)}"
_LDTS = [("src_ldts", _one("'load_datetime'")), ("src_source", _one("'record_source'"))]
_HUB_SOURCE = f"CASE WHEN contains(sources, ',') THEN '[\"stg_' || replace(sources, ',', '\", \"stg_') || '\"]' ELSE {_one(_stg('sources'))} END"
MODELS_SQL = f"""WITH {CTES}
SELECT 'models/raw_vault/hubs/' || hub || '.sql' AS path, {_model('hub', [('src_pk', _one('hk')), ('src_nk', _many("string_split(keys, ',')")), *_LDTS, ('source_model', _HUB_SOURCE)])} AS text FROM h
UNION ALL SELECT 'models/raw_vault/links/lnk_' || a || '_' || b || '.sql', {_model('link', [('src_pk', _one("a || '_' || b || '_hk'")), ('src_fk', _many("[a || '_hk', b || '_hk']")), *_LDTS, ('source_model', _one(_stg('ct')))])} FROM x
UNION ALL SELECT 'models/raw_vault/satellites/' || sat || '.sql', {_model('sat', [('src_pk', _one('hk')), ('src_hashdiff', "'{\"is_hashdiff\": true, \"columns\": ' || " + _many('cols') + " || '}'"), ('src_payload', _many('cols')), ('src_eff', _one("'effective_from'")), *_LDTS, ('source_model', _one(_stg('t')))])} FROM s
UNION ALL SELECT 'models/raw_vault/satellites/sat_eff_' || a || '_' || b || '.sql', {_model('eff_sat', [('src_pk', _one("a || '_' || b || '_hk'")), ('src_dfk', _one("a || '_hk'")), ('src_sfk', _many("[b || '_hk']")), ('src_start_date', _one("'effective_from'")), ('src_end_date', _one("'effective_to'")), ('src_eff', _one("'effective_from'")), *_LDTS, ('source_model', _one(_stg('ct')))])} FROM x WHERE ct IN (SELECT t FROM {_values(TEMPORAL)} AS y(t, c, r))
UNION ALL SELECT 'models/staging/sources.yml', 'version: 2' || chr(10) || chr(10) || 'sources:' || chr(10) || '  - name: staging' || chr(10) || '    schema: raw_vault' || chr(10) || '    tables:' || chr(10) || (SELECT string_agg('      - name: ' || t || chr(10), '' ORDER BY t) FROM k)"""


# ---- history ------------------------------------------------------------------------------


def scd_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table for each kind of history, from orders, lineitem and region."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o, i = read("orders"), read("lineitem")
    tables = {
        "none": (read("region").select("r_regionkey", "r_name"), "r_regionkey"),
        "type1": (o.select("o_orderkey", F.col("o_orderdate").alias("updated_at")), "o_orderkey"),
        "snapshot": (i.select("l_orderkey", F.col("l_shipdate").alias("snapshot_date")), "l_orderkey"),
        "type2": (o.select("o_custkey", F.col("o_orderdate").alias("valid_from"), F.col("o_orderdate").alias("valid_to")), "o_custkey"),
        "type2_open": (o.select("o_custkey", F.col("o_orderdate").alias("valid_from")), "o_custkey"),
        "type1_one_version": (o.select("o_orderkey", F.col("o_orderdate").alias("valid_from"), F.col("o_orderdate").alias("valid_to")), "o_orderkey"),
    }
    rows = []
    for name, (df, key) in tables.items():
        h = ky.historization(TableProfile(name, 0, ()), df, (BusinessKeyCandidate(name, key, 1.0, 1.0, 0.0, 0.0),))
        rows.append((name, h.scd_type.value, ",".join(h.version_key_columns), len(h.temporal_columns), round(h.confidence, 6)))
    return spark.createDataFrame(rows, "table_name string, scd_type string, version_key string, n_temporal int, confidence double")


SCD_SQL = """WITH v AS (SELECT avg(n) AS a, max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)), d AS (SELECT count(DISTINCT l_shipdate) + max(CASE WHEN l_shipdate IS NULL THEN 1 ELSE 0 END) AS n FROM lineitem)
SELECT 'none' AS table_name, 'none' AS scd_type, '' AS version_key, 0 AS n_temporal, CAST(0.9 AS DOUBLE) AS confidence
UNION ALL SELECT 'type1', 'type1', '', 1, 0.5
UNION ALL SELECT 'snapshot', CASE WHEN n >= 5 THEN 'snapshot' ELSE 'type1' END, 'l_orderkey', 1, round(least(1.0, 0.6 + 0.02 * n), 6) FROM d
UNION ALL SELECT 'type2', CASE WHEN a >= 1.3 OR m > 1 THEN 'type2' ELSE 'type1' END, 'o_custkey', 2, round(least(1.0, 0.5 + (a - 1.0) * 0.3), 6) FROM v
UNION ALL SELECT 'type2_open', CASE WHEN a >= 1.3 OR m > 1 THEN 'type2' ELSE 'type1' END, 'o_custkey', 1, round(least(1.0, 0.5 + (a - 1.0) * 0.3) * 0.8, 6) FROM v
UNION ALL SELECT 'type1_one_version', 'type1', '', 2, 0.5"""


# ---- formats ------------------------------------------------------------------------------

_DUCK = {"yyyy": "%Y", "MMM": "%b", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "SSSSSS": "%f", "SSS": "%g", "Z": "+0000", "'T'": "T"}


def duck_format(fmt: str) -> str:
    """The same format for the other engine: the longest of its letters first."""
    out, at = "", 0
    while at < len(fmt):
        part = next((p for p in sorted(_DUCK, key=len, reverse=True) if fmt.startswith(p, at)), fmt[at])
        out += _DUCK.get(part, part)
        at += len(part)
    return out


def formats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times written in each of the formats: how many of them it parses, and the written extremes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.expr("CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, CAST(o_orderkey % 86400 AS DECIMAL(18, 6)))")
    kinds = [*TIMESTAMP_FORMATS, *DATE_FORMATS]
    texts = o.select(*[F.date_format(at, f).alias(f"v{i}") for i, f in enumerate(kinds)])
    row = texts.agg(*[a for i, f in enumerate(kinds) for a in (F.count_if(parses(F.col(f"v{i}"), f)).alias(f"n{i}"), F.min(f"v{i}").alias(f"a{i}"), F.max(f"v{i}").alias(f"b{i}"))])
    cells = [F.struct(F.lit("timestamp" if i < len(TIMESTAMP_FORMATS) else "date").alias("kind"), F.lit(f).alias("format"), F.col(f"n{i}").alias("matches"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value")) for i, f in enumerate(kinds)]
    return row.select(F.inline(F.array(*cells)))


FORMATS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{kind}' AS kind, {_quote(f)} AS format, count(*) FILTER (try_strptime(v, {_quote(duck_format(f))}) IS NOT NULL) AS matches, min(v) AS min_value, max(v) AS max_value FROM (SELECT strftime(o_orderdate + to_seconds(o_orderkey % 86400), {_quote(duck_format(f))}) AS v FROM orders)"
    for kind, formats in (("timestamp", TIMESTAMP_FORMATS), ("date", DATE_FORMATS)) for f in formats
)

QUERIES = {
    "vault_rules": (rules_query, RULES_SQL),
    "dbt_models": (models_query, MODELS_SQL),
    "historization_kinds": (scd_query, SCD_SQL),
    "all_formats": (formats_query, FORMATS_SQL),
}
