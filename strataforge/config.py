"""Settings. Fields that the caller names are never changed by auto-tuning."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field


def _remember_named(cls):
    """Dataclass whose constructor notes which fields the caller named."""
    made = dataclass(cls)
    build = made.__init__
    names = [f.name for f in dataclasses.fields(made)]

    def __init__(self, *args, **kw):
        build(self, *args, **kw)
        self.named = frozenset([*names[: len(args)], *kw])

    made.__init__ = __init__
    made.create = classmethod(lambda c, **kw: c(**kw))
    return made


def changed(config, **kw):
    """Copy with some fields set by the library: what the caller named stays so."""
    out = dataclasses.replace(config, **kw)
    out.named = config.named
    return out


@_remember_named
class ProfilingConfig:
    sample_fraction: float | None = None
    sample_threshold_rows: int = 10_000_000
    max_top_values: int = 20
    approx_quantile_error: float = 0.01
    approx_distinct: bool = True
    column_batch_size: int = 50
    auto_tune: bool = True
    max_parallel_tables: int = 4
    pattern_sample_rows: int | None = None
    type_sample_rows: int | None = None


@_remember_named
class AnalysisConfig:
    uniqueness_weight: float = 0.40
    null_rate_weight: float = 0.20
    pattern_weight: float = 0.20
    name_heuristic_weight: float = 0.20
    uniqueness_threshold: float = 0.95
    null_rate_threshold: float = 0.01
    name_similarity_weight: float = 0.25
    stat_similarity_weight: float = 0.25
    value_overlap_weight: float = 0.50
    min_composite_score: float = 0.45
    value_sample_size: int = 10_000
    containment_threshold: float = 0.40
    #: compare all distinct values; otherwise the value_sample_size smallest hashes of each column
    exact_overlap: bool = True


@dataclass
class VaultConfig:
    hub_prefix: str = "hub_"
    link_prefix: str = "lnk_"
    sat_prefix: str = "sat_"
    hash_function: str = "md5"
    hash_key_suffix: str = "_hk"
    hashdiff_name: str = "hashdiff"


@dataclass
class DbtConfig:
    project_name: str = "dv_project"
    target_schema_raw: str = "raw_vault"
    target_schema_business: str = "business_vault"
    source_name: str = "staging"
    hash_function: str = "MD5"
    hash_concat_separator: str = "||"
    hashdiff_naming: str = "hashdiff"
    load_date_column: str = "load_datetime"
    record_source_column: str = "record_source"
    effective_from_column: str = "effective_from"
    automate_dv_version: str = "0.10"
    generate_pre_stage: bool = True
    generate_staging: bool = True
    generate_sources_yml: bool = True
    generate_schema_yml: bool = True
    #: dbt_project.yml and packages.yml too: project name, schemas, hash settings and the macros' version go there
    generate_project_yml: bool = False
    output_dir: str = "./dbt_output"
    model_config: dict[str, str] = field(default_factory=lambda: {"materialized": "incremental", "schema": "raw_vault"})


@dataclass
class PipelineConfig:
    profiling: ProfilingConfig = field(default_factory=ProfilingConfig)
    analysis: AnalysisConfig = field(default_factory=AnalysisConfig)
    vault: VaultConfig = field(default_factory=VaultConfig)
