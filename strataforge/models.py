"""Results of profiling, analysis and vault design, and their Spark schemas."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from pyspark.sql import types as T


class PatternType(str, enum.Enum):
    UUID = "uuid"
    EMAIL = "email"
    PHONE = "phone"
    DATE_ISO = "date_iso"
    NUMERIC_CODE = "numeric_code"
    ALPHANUMERIC_CODE = "alphanumeric_code"
    FREE_TEXT = "free_text"
    BOOLEAN = "boolean"
    UNKNOWN = "unknown"


class SCDType(str, enum.Enum):
    NONE = "none"
    TYPE1 = "type1"
    TYPE2 = "type2"
    SNAPSHOT = "snapshot"


@dataclass(frozen=True)
class InferredType:
    spark_target_type: str
    format_string: str | None
    confidence: float
    sample_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class ColumnProfile:
    column_name: str
    spark_type: str
    total_count: int
    null_count: int
    null_rate: float
    distinct_count: int
    uniqueness: float
    min_value: str | None = None
    max_value: str | None = None
    mean_length: float | None = None
    max_length: int | None = None
    is_numeric: bool = False
    dominant_pattern: PatternType = PatternType.UNKNOWN
    pattern_coverage: float = 0.0
    top_values: tuple[tuple[str, int], ...] = ()
    approx_quantiles: tuple[float, ...] | None = None
    inferred_type: InferredType | None = None
    ordinal: int = 0


@dataclass(frozen=True)
class TableProfile:
    table_name: str
    row_count: int
    column_profiles: tuple[ColumnProfile, ...]
    catalog: str | None = None
    schema: str | None = None
    sampled: bool = False
    sample_fraction: float | None = None
    sampled_row_count: int | None = None

    def column(self, name: str) -> ColumnProfile | None:
        return next((c for c in self.column_profiles if c.column_name == name), None)


@dataclass(frozen=True)
class ProfileResult:
    tables: tuple[TableProfile, ...]
    profiled_at: str

    def table(self, name: str) -> TableProfile | None:
        return next((t for t in self.tables if t.table_name == name), None)


@dataclass(frozen=True)
class TemporalColumn:
    table_name: str
    column_name: str
    role: str
    confidence: float


@dataclass(frozen=True)
class HistorizationInfo:
    table_name: str
    scd_type: SCDType
    temporal_columns: tuple[TemporalColumn, ...]
    version_key_columns: tuple[str, ...]
    confidence: float


@dataclass(frozen=True)
class BusinessKeyCandidate:
    table_name: str
    column_name: str
    score: float
    uniqueness: float
    null_rate: float
    pattern_stability: float
    reasoning: tuple[str, ...] = ()


@dataclass(frozen=True)
class SimilarityMatch:
    table_a: str
    column_a: str
    table_b: str
    column_b: str
    name_similarity: float
    statistical_similarity: float
    value_overlap: float
    composite_score: float
    match_type: str


@dataclass(frozen=True)
class Relationship:
    parent_table: str
    parent_column: str
    child_table: str
    child_column: str
    confidence: float
    cardinality: str


@dataclass(frozen=True)
class AnalysisResult:
    business_keys: dict[str, tuple[BusinessKeyCandidate, ...]] = field(default_factory=dict)
    similarity_matches: tuple[SimilarityMatch, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    historization: dict[str, HistorizationInfo] = field(default_factory=dict)

    def top_keys(self) -> dict[str, str]:
        return {t: c[0].column_name for t, c in self.business_keys.items() if c}


@dataclass(frozen=True)
class HubSpec:
    hub_name: str
    business_key_columns: tuple[str, ...]
    source_tables: tuple[str, ...]
    hash_key_name: str
    #: source table -> its own key column, for execution; business_key_columns lists all members' names
    key_by_source: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class LinkSpec:
    link_name: str
    hub_references: tuple[str, ...]
    foreign_key_columns: dict[str, tuple[str, ...]]
    source_tables: tuple[str, ...]
    hash_key_name: str


@dataclass(frozen=True)
class SatelliteSpec:
    satellite_name: str
    parent_name: str
    parent_type: str
    descriptive_columns: tuple[str, ...]
    source_table: str
    hashdiff_name: str = "hashdiff"
    is_effectivity: bool = False
    scd_type: SCDType = SCDType.NONE


@dataclass(frozen=True)
class DataVaultSpec:
    hubs: tuple[HubSpec, ...] = ()
    links: tuple[LinkSpec, ...] = ()
    satellites: tuple[SatelliteSpec, ...] = ()
    source_mappings: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class TableMetrics:
    row_count: int
    column_count: int


class ForgeError(Exception):
    """Base of the library's errors."""


class ProfilingError(ForgeError):
    pass


class AnalysisError(ForgeError):
    pass


class SuggestionError(ForgeError):
    pass


class CodeGenError(ForgeError):
    pass


class ConfigError(ForgeError):
    pass


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
INFERRED_SCHEMA = T.StructType([T.StructField("spark_target_type", _S), T.StructField("format_string", _S), T.StructField("confidence", _D), T.StructField("sample_values", T.ArrayType(_S))])
#: One row per profiled column.
PROFILE_SCHEMA = T.StructType([
    T.StructField("table_name", _S), T.StructField("ordinal", T.IntegerType()), T.StructField("column_name", _S), T.StructField("spark_type", _S),
    T.StructField("total_count", _L), T.StructField("null_count", _L), T.StructField("null_rate", _D), T.StructField("distinct_count", _L), T.StructField("uniqueness", _D),
    T.StructField("min_value", _S), T.StructField("max_value", _S), T.StructField("mean_length", _D), T.StructField("max_length", _L), T.StructField("is_numeric", _B),
    T.StructField("dominant_pattern", _S), T.StructField("pattern_coverage", _D),
    T.StructField("top_values", T.ArrayType(T.StructType([T.StructField("value", _S), T.StructField("cnt", _L)]))),
    T.StructField("approx_quantiles", T.ArrayType(_D)), T.StructField("inferred_type", INFERRED_SCHEMA),
])
