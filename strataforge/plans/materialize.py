"""The suggested vault as DataFrames: pre-stage, staging hashes, hubs, links and satellites.

An addition to what the generated dbt models do elsewhere: the same entities, executed in Spark.
Hash keys are md5 of the upper-cased, trimmed key columns joined by `||`, a null being `^^`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.functions.patterns import typed
from strataforge.models import DataVaultSpec, HubSpec, LinkSpec, SatelliteSpec, TableProfile
from strataforge.operators.frequency import as_text, quoted

NULL_MARK, SEPARATOR = "^^", "||"


def hash_key(columns: list[str]) -> Column:
    return F.md5(F.concat_ws(SEPARATOR, *[F.coalesce(F.upper(F.trim(as_text(c))), F.lit(NULL_MARK)) for c in columns]))


def hash_diff(columns: list[str]) -> Column:
    return F.md5(F.concat_ws(SEPARATOR, *[F.coalesce(F.trim(as_text(c)), F.lit(NULL_MARK)) for c in columns]))


def pre_stage(df: DataFrame, profile: TableProfile) -> DataFrame:
    """String columns cast to their inferred types; what does not parse becomes null."""
    by = {p.column_name: p.inferred_type for p in profile.column_profiles}
    return df.select(*[typed(quoted(c), by[c].spark_target_type, by[c].format_string).alias(c) if by.get(c) else quoted(c) for c in df.columns])


def hub_rows(hub: HubSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """hash key, business_key, record_source: each key once, from the first source by name. Null keys are left out.

    One aggregation by key with map-side combining.
    """
    parts = [
        tables[t].select(as_text(k).alias("business_key"), F.lit(t).alias("record_source")).where("business_key IS NOT NULL")
        for t in hub.source_tables for k in [hub.key_by_source.get(t, hub.business_key_columns[0])]
    ]
    rows = reduce(DataFrame.unionByName, parts).withColumn(hub.hash_key_name, hash_key(["business_key"]))
    return rows.groupBy(hub.hash_key_name).agg(F.min("business_key").alias("business_key"), F.min("record_source").alias("record_source"))


def link_rows(link: LinkSpec, spec: DataVaultSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """link hash key, a hash key for each hub, record_source; rows without one of the keys are left out."""
    hubs = {h.hub_name: h for h in spec.hubs}
    columns = {h: link.foreign_key_columns[h][0] for h in link.hub_references}
    parts = []
    for t in link.source_tables:
        full = reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in columns.values()])
        keys = [hash_key([c]).alias(hubs[h].hash_key_name) for h, c in columns.items()]
        parts.append(tables[t].where(full).select(hash_key(list(columns.values())).alias(link.hash_key_name), *keys, F.lit(t).alias("record_source")))
    return reduce(DataFrame.unionByName, parts).groupBy(link.hash_key_name, *[hubs[h].hash_key_name for h in columns]).agg(F.min("record_source").alias("record_source"))


def satellite_rows(sat: SatelliteSpec, spec: DataVaultSpec, table: DataFrame, effective_from: str | None = None) -> DataFrame:
    """parent hash key, hashdiff, payload, effective_from: a row wherever the payload changes.

    Without an effective-from column every different payload of a key is one row.
    """
    hub = next(h for h in spec.hubs if h.hub_name == sat.parent_name)
    key = hub.key_by_source.get(sat.source_table, hub.business_key_columns[0])
    rows = table.where(quoted(key).isNotNull()).select(
        hash_key([key]).alias(hub.hash_key_name), hash_diff(list(sat.descriptive_columns)).alias(sat.hashdiff_name), *[quoted(c) for c in sat.descriptive_columns],
        (quoted(effective_from) if effective_from else F.lit(None).cast("timestamp")).alias("effective_from"),
    )
    if effective_from is None:
        return rows.dropDuplicates([hub.hash_key_name, sat.hashdiff_name])
    order = W.partitionBy(hub.hash_key_name).orderBy("effective_from", sat.hashdiff_name)
    before = F.lag(sat.hashdiff_name).over(order)
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(sat.hashdiff_name))).drop("_before")
