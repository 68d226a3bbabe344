"""Driver queries of the profiling operators, each beside its DuckDB SQL where SQL can say it.

Spark and DuckDB print doubles differently, so tables are read with doubles as decimals where
string forms are compared.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge import queries_design
from strataforge.config import AnalysisConfig, ProfilingConfig
from strataforge.functions.names import FK_SUFFIXES, KEY_HINT, name_similarity_col
from strataforge.functions.patterns import BOOLEAN_WORDS, PATTERNS, ROLES, parses, role_col, typed
from strataforge.models import BusinessKeyCandidate, DataVaultSpec, HubSpec, LinkSpec, SatelliteSpec, TableProfile
from strataforge.operators import frequency as fq
from strataforge.operators import keys as ky
from strataforge.operators import overlap as ov
from strataforge.operators import relations as rl
from strataforge.operators import tuning as tn
from strataforge.operators.profiling import ProfileEngine, profile_frame, verified_keys
from strataforge.plans import materialize as mz
from strataforge.plans.pipeline import ForgePipeline
from strataforge.plans.report import Report
from strataforge.sources.store import load_results, save_results
from strataforge.streaming.refresh import fold_batches, stream_profile

#: The tables' columns: l long, i int, s string, d double, t timestamp.
SCHEMAS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:l s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:l ts:t user_id:l event_type:s value:d props:s",
    "labels": "doc_id:l quality:i toxic:i",
}
TYPE_NAMES = {"l": "LongType()", "i": "IntegerType()", "s": "StringType()", "d": "DecimalType(18,4)", "t": "TimestampNTZType()"}
STAR = ["region", "nation", "customer", "supplier", "part", "orders"]


def fields(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in SCHEMAS[table].split()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*[F.col(f.name).cast("decimal(18,4)").alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def star(spark: SparkSession, sf_dir: str, names=STAR) -> dict[str, DataFrame]:
    return {t: read(spark, sf_dir, t) for t in names}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_column(c: str, kind: str) -> str:
    return f"CAST({c} AS DECIMAL(18,4))" if kind == "d" else c


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ---- profiles -----------------------------------------------------------------------------


def basic_sql(table: str) -> str:
    parts = []
    for i, (c, kind) in enumerate(fields(table)):
        x = sql_column(c, kind)
        s = f"CAST({x} AS VARCHAR)"
        length = (f"round(avg(length({c})), 2)", f"CAST(max(length({c})) AS BIGINT)") if kind == "s" else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS BIGINT)")
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, '{TYPE_NAMES[kind]}' AS spark_type, count(*) AS total_count, count(*) - count({c}) AS null_count, "
            f"CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) / count(*), 6) ELSE 0.0 END AS null_rate, count(DISTINCT {x}) AS distinct_count, "
            f"CASE WHEN count({c}) > 0 THEN round(least(count(DISTINCT {x}) / count({c}), 1.0), 6) ELSE 0.0 END AS uniqueness, "
            f"min({s}) AS min_value, max({s}) AS max_value, {length[0]} AS mean_length, {length[1]} AS max_length, {'true' if kind in 'lid' else 'false'} AS is_numeric FROM {table}"
        )
    return union_all(parts)


def profile_sql(table: str) -> str:
    """Everything the scores need, one row per column."""
    parts = []
    for i, (c, kind) in enumerate(fields(table)):
        x = sql_column(c, kind)
        best = "0.0"
        name = "'unknown'"
        if kind == "s":
            shares = [f"count(*) FILTER (regexp_matches({c}, {text(rx)})) / nullif(count({c}), 0)" for rx in PATTERNS.values()]
            best = f"greatest({', '.join(shares)})"
            name = f"CASE WHEN count({c}) = 0 THEN 'unknown' WHEN {best} < 0.30 THEN 'free_text' " + " ".join(f"WHEN {s} = {best} THEN '{p}'" for p, s in zip(PATTERNS, shares)) + " END"
            best = f"CASE WHEN count({c}) = 0 THEN 0.0 WHEN {best} < 0.30 THEN round(1 - {best}, 4) ELSE round({best}, 4) END"
        length = (f"round(avg(length({c})), 2)", f"max(length({c}))") if kind == "s" else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS BIGINT)")
        parts.append(
            f"SELECT '{table}' AS table_name, {i} AS ordinal, '{c}' AS column_name, {'true' if kind in 'lid' else 'false'} AS is_numeric, round((count(*) - count({c})) / count(*), 6) AS null_rate, "
            f"count(DISTINCT {x}) AS distinct_count, round(least(count(DISTINCT {x}) / nullif(count({c}), 0), 1.0), 6) AS uniqueness, {length[0]} AS mean_length, {length[1]} AS max_length, "
            f"{name} AS dominant_pattern, {best} AS pattern_coverage FROM {table}"
        )
    return union_all(parts)


def exact_profiles(spark: SparkSession, sf_dir: str, names) -> DataFrame:
    engine = ProfileEngine(spark, ProfilingConfig(approx_distinct=False, auto_tune=False))
    return profile_frame(spark, engine.profile_tables(star(spark, sf_dir, names)))


def pattern_sql(table: str) -> str:
    return union_all(
        f"SELECT '{c}' AS column_name, '{p}' AS pattern, count(*) FILTER (regexp_matches({c}, {text(rx)})) AS matches, count({c}) AS non_null, "
        f"CASE WHEN count({c}) > 0 THEN round(count(*) FILTER (regexp_matches({c}, {text(rx)})) / count({c}), 4) ELSE 0.0 END AS coverage FROM {table}"
        for c, kind in fields(table) if kind == "s" for p, rx in PATTERNS.items()
    )


def strings(table: str) -> list[str]:
    return [c for c, kind in fields(table) if kind == "s"]


def dominant_sql(table: str) -> str:
    return f"SELECT column_name, dominant_pattern, pattern_coverage FROM ({profile_sql(table)}) WHERE column_name IN ({', '.join(map(text, strings(table)))})"


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh customer without a segment, every third without a balance."""
    c = read(spark, sf_dir, "customer")
    holes = c.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("balance"))
    return fq.basic_statistics(holes).select("column_name", "total_count", "null_count", "null_rate", "distinct_count", "uniqueness")


def null_profile_sql() -> str:
    cols = {"c_custkey": "c_custkey", "segment": "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END", "balance": "CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,4)) END"}
    return union_all(
        f"SELECT '{n}' AS column_name, count(*) AS total_count, count(*) - count({x}) AS null_count, round((count(*) - count({x})) / count(*), 6) AS null_rate, "
        f"count(DISTINCT {x}) AS distinct_count, round(count(DISTINCT {x}) / count({x}), 6) AS uniqueness FROM customer"
        for n, x in cols.items()
    )


def top_query(table: str, columns: list[str], n: int = 5):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table).select(*columns)
        names = spark.createDataFrame(list(enumerate(columns)), "ordinal int, column_name string")
        top = fq.top_values(fq.frequencies(df), n).join(F.broadcast(names), "ordinal")  # a row per column
        return top.select("column_name", F.posexplode("top").alias("pos", "x")).select("column_name", (F.col("pos") + 1).alias("rnk"), F.col("x.value").alias("value"), F.col("x.cnt").alias("cnt"))

    kinds = dict(fields(table))
    sql = union_all(
        f"SELECT column_name, CAST(rnk AS INTEGER) AS rnk, value, cnt FROM (SELECT '{c}' AS column_name, value, cnt, row_number() OVER (ORDER BY cnt DESC, value) AS rnk FROM "
        f"(SELECT CAST({sql_column(c, kinds[c])} AS VARCHAR) AS value, count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rnk <= {n}"
        for c in columns
    )
    return run, sql


def quantile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for table, columns in (("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]), ("orders", ["o_totalprice"]), ("events", ["value"])):
        found = fq.quantiles(spark.read.parquet(f"{sf_dir}/{table}.parquet"), columns)
        rows += [(table, c, *q) for c, q in found.items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, p25 double, p50 double, p75 double")


QUANTILE_SQL = union_all(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, quantile_disc({c}, 0.25) AS p25, quantile_disc({c}, 0.5) AS p50, quantile_disc({c}, 0.75) AS p75 FROM {t}"
    for t, c in (("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("orders", "o_totalprice"), ("events", "value"))
)


# ---- types --------------------------------------------------------------------------------


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a landing table of strings."""
    o = read(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("string").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss").alias("stamp"), flag.alias("flag"), F.col("o_orderpriority").alias("priority"),
    )


RAW_ORDERS = (
    "(SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day, "
    "strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') AS stamp, CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag, o_orderpriority AS priority FROM orders)"
)
_WORDS = ", ".join(map(text, BOOLEAN_WORDS))


def type_sql() -> str:
    """The ladder over the forms that this table holds."""
    rungs = [
        ("boolean", "NULL", f"lower(trim(v)) IN ({_WORDS})"), ("bigint", "NULL", "regexp_matches(trim(v), '^-?[0-9]{1,19}$')"), ("double", "NULL", r"regexp_matches(trim(v), '^-?[0-9]+\.?[0-9]*$')"),
        ("timestamp", "'MM/dd/yyyy HH:mm:ss'", "try_strptime(trim(v), '%m/%d/%Y %H:%M:%S') IS NOT NULL"), ("date", "'yyyy-MM-dd'", "try_strptime(trim(v), '%Y-%m-%d') IS NOT NULL"),
    ]
    share = lambda hit: f"(count(*) FILTER ({hit}) / count(*))"
    case = lambda pick: "CASE " + " ".join(f"WHEN {share(h)} >= 0.80 THEN {pick(t, f, h)}" for t, f, h in rungs) + " END"
    return union_all(
        f"SELECT '{c}' AS column_name, {case(lambda t, f, h: text(t))} AS target_type, {case(lambda t, f, h: f)} AS format, {case(lambda t, f, h: f'round({share(h)}, 4)')} AS confidence "
        f"FROM (SELECT {c} AS v FROM {RAW_ORDERS}) WHERE v IS NOT NULL AND trim(v) <> ''"
        for c in ("id", "amount", "day", "stamp", "flag", "priority")
    )


FORMATS = {"yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S", "MM/dd/yyyy HH:mm:ss": "%m/%d/%Y %H:%M:%S", "dd/MM/yyyy HH:mm:ss": "%d/%m/%Y %H:%M:%S", "dd.MM.yyyy HH:mm:ss": "%d.%m.%Y %H:%M:%S"}


def format_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the mixed stamps each format parses, in one aggregation."""
    o, kinds = read(spark, sf_dir, "orders"), list(FORMATS)
    v = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in kinds]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    row = o.select(v.alias("v")).agg(*[F.count_if(parses(F.col("v"), f)).alias(f"n{i}") for i, f in enumerate(kinds)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"n{i}").alias("matches")) for i, f in enumerate(kinds)])))


FORMAT_SQL = union_all(
    f"SELECT {text(f)} AS format, count(*) FILTER (try_strptime(v, {text(d)}) IS NOT NULL) AS matches FROM (SELECT CASE o_orderkey % 4 "
    + " ".join(f"WHEN {i} THEN strftime(o_orderdate, {text(x)})" for i, x in enumerate(FORMATS.values()))
    + " END AS v FROM orders)"
    for f, d in FORMATS.items()
)


def pre_stage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = raw_orders(spark, sf_dir)
    return v.select(
        typed(F.col("id"), "bigint", None).alias("id"), F.round(typed(F.col("amount"), "double", None), 2).alias("amount"), typed(F.col("day"), "date", "yyyy-MM-dd").alias("day"),
        typed(F.col("stamp"), "timestamp", "MM/dd/yyyy HH:mm:ss").cast("timestamp_ntz").alias("stamp"), typed(F.col("flag"), "boolean", None).alias("flag"), typed(F.col("priority"), "bigint", None).alias("priority"),
    )


PRE_STAGE_SQL = (
    "SELECT TRY_CAST(id AS BIGINT) AS id, round(TRY_CAST(amount AS DOUBLE), 2) AS amount, CAST(try_strptime(day, '%Y-%m-%d') AS DATE) AS day, try_strptime(stamp, '%m/%d/%Y %H:%M:%S') AS stamp, "
    f"CASE lower(flag) WHEN 'yes' THEN true WHEN 'no' THEN false END AS flag, TRY_CAST(priority AS BIGINT) AS priority FROM {RAW_ORDERS}"
)

# ---- names and roles ----------------------------------------------------------------------

ROLE_NAMES = "valid_from EFFECTIVE_TO d_hldg_start period_end eff_date load_ts snapshot_dt batch_date created_at updated_on last_change_ts payload_date begin_dte expiry_date start ending o_orderdate as_of_date inserted upd_dte".split()
PAIR_NAMES = "customer_id cust_id CustomerID order_no orderNumber o_orderkey l_orderkey c_custkey o_custkey nation-key region x created_at".split()
FK_COLUMNS = [("orders", "cust_id", 1), ("orders", "prod_code", 2), ("orders", "customer_ref", 3), ("lines", "ord_no", 1), ("lines", "qty", 2), ("lines", "product_number", 3)]
FK_KEYS = [("customers", "customer_id", 0), ("products", "product_key", 1), ("orders", "order_id", 2)]


def roles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ROLE_NAMES], "column_name string")
    return names.select("column_name", role_col(F.col("column_name")).alias("role"))


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


ROLES_SQL = f"SELECT column_name, CASE {' '.join(f'WHEN regexp_matches(lower(column_name), {text(rx)}) THEN {text(r)}' for r, rx in ROLES)} END AS role FROM {values([(n,) for n in ROLE_NAMES])} AS t(column_name)"


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.createDataFrame([(x,) for x in PAIR_NAMES], "name_a string")
    m = n.withColumnRenamed("name_a", "name_b")
    return n.join(F.broadcast(m), F.col("name_a") < F.col("name_b")).select("name_a", "name_b", F.round(name_similarity_col(F.col("name_a"), F.col("name_b")), 4).alias("similarity"))  # literal names


def sql_normal(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def sql_lev(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


def sql_name_similarity(a: str, b: str) -> str:
    na, nb = sql_normal(a), sql_normal(b)
    toks = lambda x: f"list_distinct(list_filter(string_split({x}, '_'), lambda t: t <> ''))"
    both = f"len(list_intersect({toks(na)}, {toks(nb)}))"
    union = f"(len({toks(na)}) + len({toks(nb)}) - {both})"
    return f"greatest({sql_lev(na, nb)}, CASE WHEN {union} = 0 THEN 1.0 ELSE {both} / {union} END)"


NAME_SQL = f"SELECT a.n AS name_a, b.n AS name_b, round({sql_name_similarity('a.n', 'b.n')}, 4) AS similarity FROM {values([(n,) for n in PAIR_NAMES])} AS a(n), {values([(n,) for n in PAIR_NAMES])} AS b(n) WHERE a.n < b.n"


def fk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.fk_by_name(spark.createDataFrame(FK_COLUMNS, "table_name string, column_name string, ordinal int"), spark.createDataFrame(FK_KEYS, "table_name string, column_name string, rank int"))


def _stem_sql(c: str) -> str:
    n = sql_normal(c)
    return "CASE " + " ".join(f"WHEN ends_with({n}, '{s}') THEN left({n}, length({n}) - {len(s)})" for s in FK_SUFFIXES) + f" ELSE {n} END"


FK_NAME_SQL = f"""WITH c AS (SELECT *, {_stem_sql('column_name')} AS stem FROM {values(FK_COLUMNS)} AS t(table_name, column_name, ordinal)), k AS (SELECT *, {_stem_sql('column_name')} AS stem FROM {values(FK_KEYS)} AS t(table_name, column_name, rank))
SELECT parent_table, parent_column, child_table, child_column FROM (SELECT k.table_name AS parent_table, k.column_name AS parent_column, c.table_name AS child_table, c.column_name AS child_column, row_number() OVER (PARTITION BY c.table_name, c.column_name ORDER BY k.rank) AS r
FROM c JOIN k ON c.table_name <> k.table_name AND c.stem <> '' AND k.stem <> '' AND (c.stem = k.stem OR {sql_lev('c.stem', 'k.stem')} >= 0.75)
WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.table_name = c.table_name AND x.column_name = c.column_name)) WHERE r = 1"""

# ---- keys and history ---------------------------------------------------------------------


def score_query(names):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ky.key_scores(exact_profiles(spark, sf_dir, names))

    p = "(" + union_all(f"({profile_sql(t)})" for t in names) + ")"
    sql = f"""SELECT table_name, column_name, score FROM (SELECT table_name, column_name, round(0.40 * CASE WHEN uniqueness >= 0.95 THEN 1.0 ELSE coalesce(uniqueness, 0) / 0.95 END + 0.20 * CASE WHEN null_rate <= 0.01 THEN 1.0 ELSE 1.0 - null_rate END
+ 0.20 * CASE WHEN dominant_pattern IN ('uuid', 'numeric_code', 'alphanumeric_code') AND pattern_coverage >= 0.80 THEN pattern_coverage ELSE 0.0 END + 0.20 * CASE WHEN regexp_matches(lower(column_name), {text(KEY_HINT)}) THEN 1.0 ELSE 0.0 END, 4) AS score
FROM {p} WHERE null_rate <= 0.10) WHERE score >= 0.30"""
    return run, sql


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a versioned table: one row per customer and order date, valid until the next."""
    o = read(spark, sf_dir, "orders")
    after = F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("valid_from"), after.alias("valid_to"))


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ky.dedup_uniqueness(versions(spark, sf_dir), ["o_custkey", "o_orderstatus", "o_orderpriority"])


DEDUP_SQL = (
    "WITH d AS (" + union_all(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderpriority")) + ") "
    "SELECT column_name, distinct_count, (SELECT max(distinct_count) FROM d) AS entity_count, round(distinct_count / (SELECT max(distinct_count) FROM d), 6) AS dedup_uniqueness FROM d"
)


def version_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ky.version_stats(versions(spark, sf_dir), "o_custkey").select("n_keys", F.round("avg_versions", 6).alias("avg_versions"), "max_versions")


VERSION_SQL = "SELECT count(*) AS n_keys, round(avg(n), 6) AS avg_versions, max(n) AS max_versions FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"


def history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = versions(spark, sf_dir)
    key = BusinessKeyCandidate("versions", "o_custkey", 1.0, 1.0, 0.0, 0.0)
    h = ky.historization(TableProfile("versions", 0, ()), df, (key,))
    return spark.createDataFrame([(h.table_name, h.scd_type.value, ",".join(h.version_key_columns), len(h.temporal_columns), round(h.confidence, 6))], "table_name string, scd_type string, version_key string, n_temporal int, confidence double")


HISTORY_SQL = "SELECT 'versions' AS table_name, CASE WHEN avg(n) >= 1.3 OR max(n) > 1 THEN 'type2' ELSE 'type1' END AS scd_type, 'o_custkey' AS version_key, 2 AS n_temporal, round(least(1.0, 0.5 + (avg(n) - 1.0) * 0.3), 6) AS confidence FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"

# ---- overlap ------------------------------------------------------------------------------

OVERLAP_COLUMNS = {
    "customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_regionkey", "n_name"], "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
}


def overlap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.overlap_pairs(star(spark, sf_dir, list(OVERLAP_COLUMNS)), OVERLAP_COLUMNS)


def overlap_sql(columns=OVERLAP_COLUMNS) -> str:
    rows = [(i, t, c) for i, (t, c) in enumerate((t, c) for t, names in columns.items() for c in names)]
    v = " UNION ALL ".join(f"SELECT DISTINCT {i} AS i, '{t}' AS t, '{c}' AS c, CAST({sql_column(c, dict(fields(t))[c])} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for i, t, c in rows)
    return f"""WITH v AS ({v}), n AS (SELECT i, count(*) AS n FROM v GROUP BY i), p AS (SELECT a.i AS i, b.i AS j, a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, count(*) AS n_both FROM v a JOIN v b ON a.v = b.v AND a.i < b.i AND a.t <> b.t GROUP BY ALL)
SELECT table_a, column_a, table_b, column_b, x.n AS n_a, y.n AS n_b, n_both, round(n_both / (x.n + y.n - n_both), 4) AS jaccard, round(n_both / x.n, 4) AS a_in_b, round(n_both / y.n, 4) AS b_in_a FROM p JOIN n x ON p.i = x.i JOIN n y ON p.j = y.i"""


def containment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of which at least 40 % of the values are in another table's key."""
    o = overlap_query(spark, sf_dir)
    keys = ["customer.c_custkey", "orders.o_orderkey", "nation.n_nationkey", "region.r_regionkey", "supplier.s_suppkey", "part.p_partkey"]
    both = o.select(F.inline(F.array(
        F.struct(F.concat_ws(".", "table_a", "column_a").alias("child"), F.concat_ws(".", "table_b", "column_b").alias("parent"), F.col("a_in_b").alias("containment")),
        F.struct(F.concat_ws(".", "table_b", "column_b").alias("child"), F.concat_ws(".", "table_a", "column_a").alias("parent"), F.col("b_in_a").alias("containment")),
    )))
    return both.where(F.col("parent").isin(*keys) & ~F.col("child").isin(*keys) & (F.col("containment") >= 0.40))


_KEYS = "('customer.c_custkey', 'orders.o_orderkey', 'nation.n_nationkey', 'region.r_regionkey', 'supplier.s_suppkey', 'part.p_partkey')"
CONTAINMENT_SQL = f"""WITH o AS ({overlap_sql()}), b AS (SELECT table_a || '.' || column_a AS child, table_b || '.' || column_b AS parent, a_in_b AS containment FROM o UNION ALL SELECT table_b || '.' || column_b, table_a || '.' || column_a, b_in_a FROM o)
SELECT child, parent, containment FROM b WHERE parent IN {_KEYS} AND child NOT IN {_KEYS} AND containment >= 0.40"""

SIMILAR = ["customer", "nation", "orders", "region", "supplier"]


def pair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.pair_scores(exact_profiles(spark, sf_dir, SIMILAR))


def _pair_sql() -> str:
    p = "(" + union_all(f"({profile_sql(t)})" for t in SIMILAR) + ")"
    code = "('uuid', 'numeric_code', 'alphanumeric_code')"
    near = lambda c: f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN NULL WHEN greatest(a.{c}, b.{c}) > 0 THEN 1.0 - abs(a.{c} - b.{c}) / greatest(a.{c}, b.{c}) ELSE 1.0 END"
    stat = f"list_avg(list_filter([CAST(1.0 - abs(a.uniqueness - b.uniqueness) AS DOUBLE), 1.0 - abs(a.null_rate - b.null_rate), {near('mean_length')}, {near('max_length')}], lambda z: z IS NOT NULL))"
    return f"""WITH p AS (SELECT * FROM {p} WHERE dominant_pattern NOT IN ('free_text', 'boolean') AND distinct_count >= 5 AND null_rate <= 0.80)
SELECT a.table_name AS table_a, a.column_name AS column_a, b.table_name AS table_b, b.column_name AS column_b, round({sql_name_similarity('a.column_name', 'b.column_name')}, 4) AS name_similarity, round({stat}, 4) AS statistical_similarity
FROM p a JOIN p b ON a.table_name < b.table_name AND a.is_numeric = b.is_numeric AND (a.dominant_pattern = b.dominant_pattern OR a.dominant_pattern IN {code} AND b.dominant_pattern IN {code})"""


MATCH_SCHEMA = "table_a string, column_a string, table_b string, column_b string, name_similarity double, statistical_similarity double, value_overlap double, composite_score double, match_type string"


def match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star(spark, sf_dir, SIMILAR)
    result = ProfileEngine(spark, ProfilingConfig(approx_distinct=False, auto_tune=False)).profile_tables(tables)
    found = rl.similarity_matches(result, tables, AnalysisConfig())
    return spark.createDataFrame([tuple(getattr(m, f.split()[0]) for f in MATCH_SCHEMA.split(", ")) for m in found], MATCH_SCHEMA)


def match_sql() -> str:
    every = {t: [c for c, _ in fields(t)] for t in SIMILAR}
    return f"""WITH s AS ({_pair_sql()}), o AS ({overlap_sql(every)}), j AS (SELECT s.*, coalesce(n_both / (n_a + n_b - n_both), 0.0) AS v FROM s LEFT JOIN o USING (table_a, column_a, table_b, column_b)),
t AS (SELECT table_a, column_a, table_b, column_b, name_similarity, statistical_similarity, round(v, 4) AS value_overlap, 0.25 * name_similarity + 0.25 * statistical_similarity AS cheap, round(0.25 * name_similarity + 0.25 * statistical_similarity + 0.5 * v, 3) AS composite_score,
CASE WHEN name_similarity >= 0.95 THEN 'exact_name' WHEN v >= 0.70 THEN 'value_overlap' WHEN statistical_similarity >= 0.85 THEN 'statistical' ELSE 'semantic' END AS match_type FROM j)
SELECT table_a, column_a, table_b, column_b, name_similarity, statistical_similarity, value_overlap, composite_score, match_type FROM t WHERE cheap >= 0.18 AND composite_score >= 0.45"""


RELATION_SCHEMA = "parent_table string, parent_column string, child_table string, child_column string, confidence double, cardinality string"


def relation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star(spark, sf_dir)
    result = ProfileEngine(spark, ProfilingConfig(approx_distinct=False, auto_tune=False)).profile_tables(tables)
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    found = rl.relationships(result, keys, tables)
    return spark.createDataFrame([tuple(getattr(r, f.split()[0]) for f in RELATION_SCHEMA.split(", ")) for r in found], RELATION_SCHEMA)


def relation_sql() -> str:
    """Rules two and three for these tables: names first, then containment."""
    keys = [("region", "r_regionkey", 0), ("nation", "n_nationkey", 1), ("customer", "c_custkey", 2), ("supplier", "s_suppkey", 3), ("part", "p_partkey", 4), ("orders", "o_orderkey", 5)]
    every = {t: [c for c, _ in fields(t)] for t in STAR}
    p = "(" + union_all(f"({profile_sql(t)})" for t in STAR) + ")"
    return f"""WITH p AS (SELECT *, {_stem_sql('column_name')} AS stem FROM {p}), k AS (SELECT *, {_stem_sql('key_column')} AS stem FROM {values(keys)} AS t(key_table, key_column, rank)),
c AS (SELECT p.* FROM p WHERE null_rate <= 0.80 AND NOT EXISTS (SELECT 1 FROM k WHERE key_table = p.table_name AND key_column = p.column_name)),
n AS (SELECT * FROM (SELECT key_table AS parent_table, key_column AS parent_column, c.table_name AS child_table, c.column_name AS child_column, row_number() OVER (PARTITION BY c.table_name, c.column_name ORDER BY rank) AS r FROM c JOIN k ON c.table_name <> key_table AND c.stem <> '' AND k.stem <> '' AND (c.stem = k.stem OR {sql_lev('c.stem', 'k.stem')} >= 0.75)) WHERE r = 1),
o AS ({overlap_sql(every)}), b AS (SELECT table_a AS child_table, column_a AS child_column, table_b AS parent_table, column_b AS parent_column, n_both / n_a AS share FROM o UNION ALL SELECT table_b, column_b, table_a, column_a, n_both / n_b FROM o),
v AS (SELECT key_table AS parent_table, key_column AS parent_column, c.table_name AS child_table, c.column_name AS child_column, share, c.uniqueness AS cu, q.uniqueness AS pu FROM c JOIN k ON c.table_name <> key_table JOIN p q ON q.table_name = key_table AND q.column_name = key_column AND q.is_numeric = c.is_numeric
JOIN b ON b.child_table = c.table_name AND b.child_column = c.column_name AND b.parent_table = key_table AND b.parent_column = key_column WHERE share >= 0.40 AND NOT EXISTS (SELECT 1 FROM n WHERE n.parent_table = key_table AND n.child_table = c.table_name AND n.child_column = c.column_name))
SELECT parent_table, parent_column, child_table, child_column, CAST(0.7 AS DOUBLE) AS confidence, '1:N' AS cardinality FROM n UNION ALL
SELECT parent_table, parent_column, child_table, child_column, round(share, 4), CASE WHEN pu < 0.95 THEN 'N:M' WHEN cu >= 0.95 THEN '1:1' ELSE '1:N' END FROM v"""


def similar_keys_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule one alone: references that follow from similar columns of which one is a key."""
    tables = star(spark, sf_dir, SIMILAR)
    result = ProfileEngine(spark, ProfilingConfig(approx_distinct=False, auto_tune=False)).profile_tables(tables)
    matches = rl.similarity_matches(result, tables, AnalysisConfig())
    keys = {"customer": "c_custkey", "nation": "n_nationkey", "orders": "o_orderkey", "region": "r_regionkey", "supplier": "s_suppkey"}
    of_match = {frozenset(((m.table_a, m.column_a), (m.table_b, m.column_b))) for m in matches}
    found = [r for r in rl.relationships(result, keys, tables, matches) if frozenset(((r.parent_table, r.parent_column), (r.child_table, r.child_column))) in of_match]
    rows = spark.createDataFrame([(r.parent_table, r.parent_column, r.child_table, r.child_column, r.confidence, r.cardinality) for r in found], RELATION_SCHEMA)
    return rows.withColumn("confidence", F.round("confidence", 3))


def similar_keys_sql() -> str:
    keys = values([("customer", "c_custkey"), ("nation", "n_nationkey"), ("orders", "o_orderkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")])
    return f"""WITH m AS ({match_sql()}), k AS (SELECT * FROM {keys} AS t(t, c)), f AS (SELECT m.*, EXISTS (SELECT 1 FROM k WHERE t = table_a AND c = column_a) AS ka, EXISTS (SELECT 1 FROM k WHERE t = table_b AND c = column_b) AS kb FROM m)
SELECT CASE WHEN ka THEN table_a ELSE table_b END AS parent_table, CASE WHEN ka THEN column_a ELSE column_b END AS parent_column, CASE WHEN ka THEN table_b ELSE table_a END AS child_table, CASE WHEN ka THEN column_b ELSE column_a END AS child_column, composite_score AS confidence, '1:N' AS cardinality FROM f WHERE ka <> kb"""


# ---- vault --------------------------------------------------------------------------------

VAULT = DataVaultSpec(
    (HubSpec("hub_customer", ("c_custkey", "o_custkey"), ("customer", "orders"), "customer_hk", {"customer": "c_custkey", "orders": "o_custkey"}), HubSpec("hub_order", ("o_orderkey",), ("orders",), "order_hk", {"orders": "o_orderkey"})),
    (LinkSpec("lnk_customer_order", ("hub_customer", "hub_order"), {"hub_customer": ("o_custkey",), "hub_order": ("o_orderkey",)}, ("orders",), "customer_order_hk"),),
    (SatelliteSpec("sat_customer_customer", "hub_customer", "hub", ("c_name", "c_mktsegment"), "customer"), SatelliteSpec("sat_order_orders", "hub_order", "hub", ("o_orderstatus", "o_orderpriority"), "orders")),
)


def _h(*cols: str) -> str:
    return "md5(concat_ws('||', " + ", ".join(f"coalesce(upper(trim(CAST({c} AS VARCHAR))), '^^')" for c in cols) + "))"


def _hd(*cols: str) -> str:
    return "md5(concat_ws('||', " + ", ".join(f"coalesce(trim(CAST({c} AS VARCHAR)), '^^')" for c in cols) + "))"


def staging_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", mz.hash_key(["o_custkey"]).alias("customer_hk"), mz.hash_key(["o_orderkey"]).alias("order_hk"), mz.hash_key(["o_custkey", "o_orderkey"]).alias("customer_order_hk"), mz.hash_diff(["o_orderstatus", "o_orderpriority"]).alias("hashdiff"))


STAGING_SQL = f"SELECT o_orderkey, {_h('o_custkey')} AS customer_hk, {_h('o_orderkey')} AS order_hk, {_h('o_custkey', 'o_orderkey')} AS customer_order_hk, {_hd('o_orderstatus', 'o_orderpriority')} AS hashdiff FROM orders"


def hub_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mz.hub_rows(VAULT.hubs[0], star(spark, sf_dir, ["customer", "orders"]))


HUB_SQL = f"SELECT {_h('k')} AS customer_hk, min(k) AS business_key, min(s) AS record_source FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, 'customer' AS s FROM customer UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders' FROM orders) WHERE k IS NOT NULL GROUP BY 1"


def link_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mz.link_rows(VAULT.links[0], VAULT, star(spark, sf_dir, ["orders"]))


LINK_SQL = f"SELECT DISTINCT {_h('o_custkey', 'o_orderkey')} AS customer_order_hk, {_h('o_custkey')} AS customer_hk, {_h('o_orderkey')} AS order_hk, 'orders' AS record_source FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL"


def satellite_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mz.satellite_rows(VAULT.satellites[0], VAULT, read(spark, sf_dir, "customer")).drop("effective_from")


SATELLITE_SQL = f"SELECT DISTINCT {_h('c_custkey')} AS customer_hk, {_hd('c_name', 'c_mktsegment')} AS hashdiff, c_name, c_mktsegment FROM customer"


def history_satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of a customer's orders over time: unchanged payloads are one row."""
    sat = SatelliteSpec("sat_customer_orders", "hub_customer", "hub", ("o_orderstatus",), "orders")
    o = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderstatus").alias("o_orderstatus"))
    return mz.satellite_rows(sat, VAULT, o, "o_orderdate")


HISTORY_SATELLITE_SQL = f"""WITH o AS (SELECT o_custkey, o_orderdate, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY ALL), r AS (SELECT {_h('o_custkey')} AS customer_hk, {_hd('o_orderstatus')} AS hashdiff, o_orderstatus, o_orderdate AS effective_from FROM o)
SELECT customer_hk, hashdiff, o_orderstatus, effective_from FROM (SELECT *, lag(hashdiff) OVER (PARTITION BY customer_hk ORDER BY effective_from, hashdiff) AS p FROM r) WHERE p IS NULL OR p <> hashdiff"""

TUNE_ROWS = [("tiny", 500, 5), ("small", 20_000, 20), ("edge", 100_000, 21), ("mid", 999_999, 100), ("big", 1_000_000, 300), ("large", 10_000_000, 301), ("huge", 50_000_000, 1000), ("vast", 2_000_000_000, 1001)]


def tune_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.tuned_settings(spark.createDataFrame(TUNE_ROWS, "table_name string, row_count long, column_count int"))


TUNE_SQL = f"""SELECT table_name, CAST(row_count AS BIGINT) AS row_count, CAST(column_count AS INTEGER) AS column_count, CASE WHEN column_count <= 20 THEN 50 WHEN column_count <= 100 THEN 30 WHEN column_count <= 300 THEN 15 WHEN column_count <= 1000 THEN 8 ELSE 5 END AS column_batch_size, row_count >= 100000 AS approx_distinct,
CAST(CASE WHEN row_count < 50000 THEN 0.001 WHEN row_count < 1000000 THEN 0.005 WHEN row_count < 50000000 THEN 0.01 ELSE 0.05 END AS DOUBLE) AS quantile_error, CASE WHEN row_count < 1000 THEN 50 WHEN row_count < 100000 THEN 30 WHEN row_count < 10000000 THEN 20 ELSE 10 END AS max_top_values FROM {values(TUNE_ROWS)} AS t(table_name, row_count, column_count)"""


def _designed(spark: SparkSession, sf_dir: str):
    p = ForgePipeline(spark, star(spark, sf_dir))
    p.run_all()
    return p


def vault_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _designed(spark, sf_dir).vault_spec
    rows = [("hub", h.hub_name, ",".join(h.source_tables), ",".join(h.business_key_columns), h.hash_key_name) for h in v.hubs]
    rows += [("link", x.link_name, ",".join(x.source_tables), ",".join(x.hub_references), x.hash_key_name) for x in v.links]
    rows += [("satellite", s.satellite_name, s.source_table, ",".join(s.descriptive_columns), s.parent_name) for s in v.satellites]
    rows += [("mapping", t, t, ",".join(n), "") for t, n in v.source_mappings.items()]
    return spark.createDataFrame(rows, "kind string, name string, sources string, columns string, hash_key string")


def dbt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _designed(spark, sf_dir)
    return spark.createDataFrame(list(p.generated_files.items()), "path string, text string")


REPORTED = ["nation", "region", "part"]


def report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report's lines on tables and columns, and how often its HTML form has each of them."""
    result = ProfileEngine(spark, ProfilingConfig(approx_distinct=False, auto_tune=False)).profile_tables(star(spark, sf_dir, REPORTED))
    report = Report(result)
    lines = [x.strip() for x in report.to_text().split("\n") if re.match(r"  \S|    .* \| ", x)]
    html = report.to_html()
    cells = lambda x: escape(x) if " | " not in x else "<tr>" + "".join(f"<td>{escape(c)}</td>" for c in x.split(" | ")) + "</tr>"
    return spark.createDataFrame([(x, html.count(cells(x))) for x in lines], "line string, in_html int")


def report_sql() -> str:
    share = lambda x: f"format('{{:.2f}}%', 100 * {x})"
    kinds = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{TYPE_NAMES[k]}'" for t in REPORTED for c, k in fields(t)) + " END"
    p = "(" + union_all(f"({profile_sql(t)})" for t in REPORTED) + ")"
    heads = union_all(f"SELECT '{t}: ' || format('{{:,}}', count(*)) || ' rows, {len(fields(t))} columns' AS line, 1 AS in_html FROM {t}" for t in REPORTED)
    return f"""{heads} UNION ALL SELECT column_name || ' | ' || {kinds} || ' | ' || {share('null_rate')} || ' | ' || format('{{:,}}', distinct_count) || ' | ' || {share('uniqueness')} || ' | ' || dominant_pattern || ' ' || format('{{:.0f}}%', 100 * pattern_coverage), 1 FROM {p}"""


def json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after a round trip through a JSON file."""
    result = ProfileEngine(spark).profile_tables(star(spark, sf_dir, ["nation", "region"]))
    with tempfile.TemporaryDirectory() as d:
        save_results(f"{d}/r.json", result)
        back, _ = load_results(f"{d}/r.json")
    if back != result:
        raise ValueError("the profile changed on its way")
    return profile_frame(spark, back).select("table_name", "column_name", "total_count", "distinct_count", "null_count")


JSON_SQL = union_all(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count FROM {t}" for t in ("nation", "region") for c, _ in fields(t))


def wide_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the approximate path gives, the distinct counts but as positive: their error is approx_distinct_error's."""
    wide = fq.wide_statistics(read(spark, sf_dir, "lineitem"), 50, True, 10)
    names = spark.createDataFrame(list(enumerate(c for c, _ in fields("lineitem"))), "ordinal int, column_name string")
    return wide.join(F.broadcast(names), "ordinal").select(  # a row per column
        "column_name", "total_count", "null_count", "min_value", "max_value", F.round("mean_length", 2).alias("mean_length"), "max_length", "filled_count", (F.col("distinct_count") > 0).alias("some"),
        F.aggregate(F.map_values("pattern_counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("pattern_hits"), F.coalesce(F.col("type_counts")["boolean"], F.lit(0)).cast("long").alias("boolean_hits"),
        F.array_join(F.transform("top", lambda x: F.concat_ws(":", x.value, x.cnt.cast("string"))), "|").alias("top"),
    )


def wide_sql() -> str:
    parts = []
    for c, kind in fields("lineitem"):
        s = f"CAST({sql_column(c, kind)} AS VARCHAR)"
        text_ = kind == "s"
        hits = " + ".join(f"count(*) FILTER (regexp_matches({c}, {text(rx)}))" for rx in PATTERNS.values()) if text_ else "0"
        top = f"(SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM (SELECT {s} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 10))"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, min({s}) AS min_value, max({s}) AS max_value, {f'round(avg(length({c})), 2)' if text_ else 'CAST(NULL AS DOUBLE)'} AS mean_length, "
            f"{f'CAST(max(length({c})) AS BIGINT)' if text_ else 'CAST(NULL AS BIGINT)'} AS max_length, CAST({f'count(*) FILTER (trim({c}) <> {text(str())})' if text_ else '0'} AS BIGINT) AS filled_count, true AS some, CAST({hits} AS BIGINT) AS pattern_hits, "
            f"CAST({f'count(*) FILTER (lower(trim({c})) IN ({_WORDS}))' if text_ else '0'} AS BIGINT) AS boolean_hits, {top} AS top FROM lineitem"
        )
    return union_all(parts)


HLL_COLUMNS = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"], "orders": ["o_orderkey", "o_custkey", "o_orderpriority"]}


def hll_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate distinct counts are within three standard errors (15 %) of the exact ones."""
    out = None
    for t, columns in HLL_COLUMNS.items():
        df = read(spark, sf_dir, t).select(*columns)
        names = spark.createDataFrame(list(enumerate(columns)), "ordinal int, column_name string")
        exact = fq.value_statistics(fq.frequencies(df)).select("ordinal", F.col("distinct_count").alias("exact"))
        part = fq.wide_statistics(df).select("ordinal", "distinct_count").join(exact, "ordinal").join(F.broadcast(names), "ordinal")  # a row per column
        part = part.select("column_name", F.col("exact").alias("distinct_count"), (F.abs(F.col("distinct_count") - F.col("exact")) <= 0.15 * F.col("exact")).alias("within_error"))
        out = part if out is None else out.union(part)
    return out


HLL_SQL = union_all(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, true AS within_error FROM {t}" for t, columns in HLL_COLUMNS.items() for c in columns)


def bottom_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hashes in both tables: how many values each sample has, and how many they share (the smaller table's are a subset)."""
    b = fq.bottom_hash_values(ov.catalogue(star(spark, sf_dir, ["orders", "customer"]), {"orders": ["o_custkey"], "customer": ["c_custkey"]}), 100)
    each = b.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_distinct"))
    return each.agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_values"), F.sum("n_distinct").alias("n_distinct"))


BOTTOM_SQL = "WITH n AS (SELECT least(100, count(DISTINCT o_custkey)) AS n FROM orders UNION ALL SELECT least(100, count(DISTINCT c_custkey)) FROM customer) SELECT count(*) AS n_columns, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum(n) AS BIGINT) AS n_distinct FROM n"


def sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table over the threshold is sampled down to about it (within five standard deviations), one below is not."""
    big, small = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "nation")
    part, sampled, fraction = tn.auto_sample(big, threshold=5_000)
    whole, not_sampled, none = tn.auto_sample(small, threshold=5_000)
    rows = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("table_name"), F.lit(sampled).alias("sampled"), F.lit(round(fraction, 9)).alias("fraction"), (F.abs(F.col("n") - 5_000) <= 5 * F.sqrt(F.lit(5_000.0))).alias("about"))
    return rows.union(whole.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nation"), F.lit(not_sampled), F.lit(none).cast("double"), F.col("n") == small.count()))


SAMPLE_SQL = "SELECT 'lineitem' AS table_name, true AS sampled, round(5000 / count(*), 9) AS fraction, true AS about FROM lineitem UNION ALL SELECT 'nation', false, NULL, true"


def stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream of files, folded batch by batch; the state goes to the shared folder."""
    src = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strataforge-stream-")
    state = f"{base}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(src).option("pathGlobFilter", "orders.parquet").parquet(sf_dir).select(*STREAMED)
    fold_batches(stream, f"{state}/state", f"{state}/checkpoint").awaitTermination()
    names = spark.createDataFrame(list(enumerate(stream.columns)), "ordinal int, column_name string")
    return stream_profile(spark, f"{state}/state").join(F.broadcast(names), "ordinal").select("column_name", "total_count", "null_count", "distinct_count", "min_value", "max_value")


STREAMED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
STREAM_SQL = union_all(f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, min(CAST({c} AS VARCHAR)) AS min_value, max(CAST({c} AS VARCHAR)) AS max_value FROM orders" for c in STREAMED)

LENGTH_SQL = union_all(f"SELECT '{c}' AS column_name, round(avg(length({c})), 2) AS mean_length, CAST(max(length({c})) AS BIGINT) AS max_length FROM documents" for c in ("text", "lang", "source"))


def length_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.basic_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source")).select("column_name", "mean_length", "max_length")


def example_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")
    names = spark.createDataFrame(list(enumerate(df.columns)), "ordinal int, column_name string")
    return fq.example_values(fq.frequencies(df)).join(F.broadcast(names), "ordinal").select("column_name", F.concat_ws("|", "examples").alias("examples"))


EXAMPLE_SQL = union_all(f"SELECT '{c}' AS column_name, string_agg(v, '|' ORDER BY v) AS examples FROM (SELECT DISTINCT {c} AS v FROM part WHERE trim({c}) <> '' ORDER BY 1 LIMIT 5)" for c in ("p_name", "p_brand", "p_type"))


def _build() -> dict:
    q: dict[str, tuple] = {}
    for t in SCHEMAS:
        q[f"profile_basic_{t}"] = (lambda s, d, t=t: fq.basic_statistics(read(s, d, t)), basic_sql(t))
    q["null_profile"] = (null_profile, null_profile_sql())
    q["verified_keys_orders"] = (
        lambda s, d: verified_keys(read(s, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]),
        union_all(f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, round((count(*) - count({c})) / count(*), 6) AS null_rate, round(least(count(DISTINCT {c}) / count({c}), 1.0), 6) AS uniqueness FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice")),
    )
    q["approx_statistics_lineitem"] = (wide_query, wide_sql())
    q["approx_distinct_error"] = (hll_query, HLL_SQL)
    q["length_stats_documents"] = (length_query, LENGTH_SQL)
    for t in ("customer", "orders", "nation", "region", "part"):
        q[f"pattern_coverage_{t}"] = (lambda s, d, t=t: fq.pattern_coverage(read(s, d, t), strings(t)), pattern_sql(t))
        q[f"dominant_pattern_{t}"] = (lambda s, d, t=t: fq.dominant_patterns(read(s, d, t), strings(t)), dominant_sql(t))
    q["type_inference_orders"] = (lambda s, d: fq.inferred_types(x := raw_orders(s, d), x.columns), type_sql())
    q["timestamp_format_search"] = (format_search, FORMAT_SQL)
    q["pre_stage_cast"] = (pre_stage_query, PRE_STAGE_SQL)
    q["quantiles_exact"] = (quantile_query, QUANTILE_SQL)
    q["top_values_orders"] = top_query("orders", ["o_custkey", "o_orderstatus", "o_orderpriority"])
    q["top_values_lineitem"] = top_query("lineitem", ["l_partkey", "l_returnflag", "l_quantity", "l_shipdate"], 10)
    q["example_values_part"] = (example_query, EXAMPLE_SQL)
    q["temporal_roles"] = (roles_query, ROLES_SQL)
    q["name_similarity_pairs"] = (name_pairs, NAME_SQL)
    q["fk_name_heuristic"] = (fk_names, FK_NAME_SQL)
    q["key_scores_star"] = score_query(STAR)
    q["key_scores_events"] = score_query(["events", "labels"])
    q["dedup_uniqueness"] = (dedup_query, DEDUP_SQL)
    q["version_stats"] = (version_query, VERSION_SQL)
    q["snapshot_dates"] = (lambda s, d: ky.snapshot_dates(read(s, d, "lineitem"), "l_shipdate"), "SELECT count(*) AS n_dates FROM (SELECT l_shipdate FROM lineitem GROUP BY 1)")
    q["historization_versions"] = (history_query, HISTORY_SQL)
    q["value_overlap_pairs"] = (overlap_query, overlap_sql())
    q["containment_fk"] = (containment_query, CONTAINMENT_SQL)
    q["bottom_hash_sample"] = (bottom_query, BOTTOM_SQL)
    q["pair_scores"] = (pair_query, _pair_sql())
    q["similarity_matches"] = (lambda s, d: match_query(s, d).withColumn("composite_score", F.round("composite_score", 3)), match_sql())
    q["relationships"] = (relation_query, relation_sql())
    q["relationships_by_similarity"] = (similar_keys_query, similar_keys_sql())
    q["staging_hash"] = (staging_query, STAGING_SQL)
    q["hub_load"] = (hub_query, HUB_SQL)
    q["link_load"] = (link_query, LINK_SQL)
    q["satellite_load"] = (satellite_query, SATELLITE_SQL)
    q["satellite_history"] = (history_satellite, HISTORY_SATELLITE_SQL)
    q["auto_tune"] = (tune_query, TUNE_SQL)
    q["auto_sample"] = (sample_query, SAMPLE_SQL)
    q["vault_design"] = (vault_query, None)
    q["dbt_files"] = (dbt_query, None)
    q["reports"] = (report_query, report_sql())
    q["json_round_trip"] = (json_query, JSON_SQL)
    q["stream_profile"] = (stream_query, STREAM_SQL)
    return q | queries_design.QUERIES


_ALL = _build()
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1]}
