"""dbt models with automate_dv macros, as text. Rendered without a template engine."""

from __future__ import annotations

import json
from pathlib import Path

from strataforge.config import DbtConfig
from strataforge.functions.names import normalize_name
from strataforge.functions.patterns import TRUE_WORDS
from strataforge.models import ColumnProfile, DataVaultSpec, HubSpec, LinkSpec, ProfileResult, SatelliteSpec


def literal(value) -> str:
    """A Jinja literal: strings and lists in double quotes."""
    return json.dumps(value)


def macro_model(config: str, macro: str, args: dict) -> str:
    """A model that sets its arguments and calls one macro."""
    sets = "".join(f"{{% set {k} = {literal(v)} %}}\n" for k, v in args.items())
    names = f",\n{' ' * (len(macro) + 16)}".join(f"{k}={k}" for k in args)
    return f"{{{{ {config} }}}}\n\n{sets}\n{{{{ automate_dv.{macro}({names}) }}}}\n"


def cast_sql(p: ColumnProfile) -> str | None:
    """SQL that casts a raw string column to its inferred type."""
    it = p.inferred_type
    if it is None:
        return None
    c = f"`{p.column_name}`"
    if it.spark_target_type in ("timestamp", "date"):
        return f"TO_{it.spark_target_type.upper()}({c}, '{it.format_string}')" if it.format_string else None
    if it.spark_target_type == "boolean":
        return f"CASE LOWER(TRIM({c})) {' '.join(f"WHEN '{w}' THEN TRUE" for w in TRUE_WORDS)} ELSE FALSE END"
    return f"CAST({c} AS {it.spark_target_type.upper()})" if it.spark_target_type in ("bigint", "double") else None


class DbtGenerator:
    def __init__(self, spec: DataVaultSpec, dbt_config: DbtConfig | None = None, profile_result: ProfileResult | None = None):
        self.spec, self.cfg, self.profiles = spec, dbt_config or DbtConfig(), profile_result
        self.hubs = {h.hub_name: h for h in spec.hubs}
        self.links = {x.link_name: x for x in spec.links}
        self.files: dict[str, str] = {}

    @property
    def sources(self) -> list[str]:
        return sorted({t for x in (*self.spec.hubs, *self.spec.links) for t in x.source_tables})

    def generate_all(self) -> dict[str, str]:
        """path -> text: pre-stage, staging, hubs, links, satellites, then the YAML files."""
        out: dict[str, str] = {}
        raw = {t: self.profiles.table(t) for t in self.sources} if self.profiles and self.cfg.generate_pre_stage else {}
        cast = {t: p for t, p in raw.items() if p and any(c.inferred_type for c in p.column_profiles)}
        for t, p in cast.items():
            out[f"models/staging/pre_stg_{normalize_name(t)}.sql"] = self.pre_stage(t, p.column_profiles)
        if self.cfg.generate_staging:
            for t in self.sources:
                out[f"models/staging/stg_{normalize_name(t)}.sql"] = self.staging(t, t in cast)
        vault = "models/raw_vault"
        out |= {f"{vault}/hubs/{h.hub_name}.sql": self.hub(h) for h in self.spec.hubs}
        out |= {f"{vault}/links/{x.link_name}.sql": self.link(x) for x in self.spec.links}
        for s in self.spec.satellites:
            if not s.is_effectivity or s.parent_name in self.links:
                out[f"{vault}/satellites/{s.satellite_name}.sql"] = self.effectivity(s) if s.is_effectivity else self.satellite(s)
        if self.cfg.generate_sources_yml:
            out["models/staging/sources.yml"] = self.sources_yml()
        if self.cfg.generate_schema_yml:
            out[f"{vault}/schema.yml"] = self.schema_yml()
        if self.cfg.generate_project_yml:
            out |= {"dbt_project.yml": self.project_yml(), "packages.yml": f"packages:\n  - package: Datavault-UK/automate_dv\n    version: {literal(self.cfg.automate_dv_version)}\n"}
        self.files = out
        return dict(out)

    def write_to_disk(self, output_dir: str | None = None) -> list[str]:
        paths = []
        for name, text in (self.files or self.generate_all()).items():
            path = Path(output_dir or self.cfg.output_dir, name)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
            paths.append(str(path))
        return paths

    def pre_stage(self, table: str, columns: tuple[ColumnProfile, ...]) -> str:
        items = [f"    {sql} AS {c.column_name}" if (sql := cast_sql(c)) else f"    {c.column_name}" for c in columns]
        return f"{{{{ config(materialized='view') }}}}\n\nSELECT\n" + ",\n".join(items) + f"\nFROM {{{{ source('{self.cfg.source_name}', '{table}') }}}}\n"

    def hashed_columns(self, table: str) -> dict[str, tuple[list[str], bool]]:
        """Name -> (columns, is a hashdiff) for a table's staging model; the first of a name counts."""
        out: dict[str, tuple[list[str], bool]] = {}
        for h in self.spec.hubs:
            if table in h.source_tables:
                out[h.hash_key_name] = (list(h.business_key_columns), False)
        for x in self.spec.links:
            if table in x.source_tables:
                for name in x.hub_references:
                    if name in self.hubs:
                        out.setdefault(self.hubs[name].hash_key_name, (list(x.foreign_key_columns.get(name) or self.hubs[name].business_key_columns), False))
                every = dict.fromkeys(c for name in x.hub_references for c in x.foreign_key_columns.get(name, ()))
                out.setdefault(x.hash_key_name, (list(every), False))
        for s in self.spec.satellites:
            if s.source_table == table and s.descriptive_columns and not s.is_effectivity:
                out.setdefault(s.hashdiff_name, (list(s.descriptive_columns), True))
        return out

    def staging(self, table: str, pre_staged: bool = False) -> str:
        c = self.cfg
        source = f"pre_stg_{normalize_name(table)}" if pre_staged else table
        lines = ["source_model:", f'  {c.source_name}: "{source}"', "derived_columns:"]
        for name, value in ((c.record_source_column, source), (c.load_date_column, "CURRENT_TIMESTAMP()"), (c.effective_from_column, "CURRENT_TIMESTAMP()")):
            lines += [f"  {name}:", f'    value: "{value}"']
        lines.append("hashed_columns:")
        for name, (columns, diff) in self.hashed_columns(table).items():
            lines.append(f"  {name}:")
            if diff:
                lines.append("    is_hashdiff: true")
            if diff or len(columns) > 1:
                lines += ["    columns:", *(f'      - "{x}"' for x in columns)]
            else:
                lines += [f'    - "{x}"' for x in columns]
        parts = ("source_model", "derived_columns", "hashed_columns")
        sets = "".join(f'{{% set {p} = metadata_dict["{p}"] %}}\n' for p in parts) + '{% set ranked_columns = metadata_dict.get("ranked_columns", {}) %}\n'
        args = ", ".join(f"{p}={p}" for p in (*parts, "ranked_columns"))
        body = "\n".join(lines)
        return f"{{%- set yaml_metadata -%}}\n\n{body}\n\n{{%- endset -%}}\n\n{{% set metadata_dict = fromyaml(yaml_metadata) %}}\n\n{sets}\n{{{{ automate_dv.stage(include_source_columns=true, {args}) }}}}\n"

    def _config(self) -> str:
        return f"config(materialized='{self.cfg.model_config.get('materialized', 'incremental')}', schema='{self.cfg.target_schema_raw}')"

    def _staged(self, tables: tuple[str, ...]):
        names = [f"stg_{normalize_name(t)}" for t in tables]
        return names[0] if len(names) == 1 else names

    def _tail(self, tables: tuple[str, ...]) -> dict:
        return {"src_ldts": self.cfg.load_date_column, "src_source": self.cfg.record_source_column, "source_model": self._staged(tables)}

    def _hub_keys(self, x: LinkSpec) -> list[str]:
        return [self.hubs[h].hash_key_name for h in x.hub_references if h in self.hubs]

    def parent_key(self, s: SatelliteSpec) -> str:
        parent = (self.hubs if s.parent_type == "hub" else self.links).get(s.parent_name)
        return parent.hash_key_name if parent else "unknown_hk"

    def hub(self, h: HubSpec) -> str:
        return macro_model(self._config(), "hub", {"src_pk": h.hash_key_name, "src_nk": list(h.business_key_columns)} | self._tail(h.source_tables))

    def link(self, x: LinkSpec) -> str:
        return macro_model(self._config(), "link", {"src_pk": x.hash_key_name, "src_fk": self._hub_keys(x)} | self._tail(x.source_tables))

    def satellite(self, s: SatelliteSpec) -> str:
        columns = list(s.descriptive_columns)
        own = {"src_pk": self.parent_key(s), "src_hashdiff": {"is_hashdiff": True, "columns": columns}, "src_payload": columns, "src_eff": self.cfg.effective_from_column}
        return macro_model(self._config(), "sat", own | self._tail((s.source_table,)))

    def effectivity(self, s: SatelliteSpec) -> str:
        first, *rest = self._hub_keys(self.links[s.parent_name]) or [""]
        start = self.cfg.effective_from_column
        own = {"src_pk": self.parent_key(s), "src_dfk": first, "src_sfk": rest, "src_start_date": start, "src_end_date": "effective_to", "src_eff": start}
        return macro_model(self._config(), "eff_sat", own | self._tail((s.source_table,)))

    def project_yml(self) -> str:
        """The project that the models belong to: schemas by folder, and what the macros hash with."""
        c = self.cfg
        variables = {"hash": c.hash_function, "concat_string": c.hash_concat_separator, "hashdiff_naming": c.hashdiff_naming}
        lines = [f"name: {literal(c.project_name)}", 'version: "1.0.0"', "config-version: 2", f"profile: {literal(c.project_name)}", 'model-paths: ["models"]', "vars:", *(f"  {k}: {literal(v)}" for k, v in variables.items())]
        lines += ["models:", f"  {c.project_name}:", "    raw_vault:", f"      +schema: {c.target_schema_raw}", "    business_vault:", f"      +schema: {c.target_schema_business}"]
        return "\n".join(lines) + "\n"

    def sources_yml(self) -> str:
        tables = "".join(f"      - name: {t}\n" for t in self.sources)
        return f"version: 2\n\nsources:\n  - name: {self.cfg.source_name}\n    schema: {self.cfg.target_schema_raw}\n    tables:\n{tables}"

    def schema_yml(self) -> str:
        last = [(self.cfg.load_date_column, "Load timestamp", False), (self.cfg.record_source_column, "Record source", False)]
        models = []
        for h in self.spec.hubs:
            models.append((h.hub_name, f"Hub for {h.hub_name}", [(h.hash_key_name, "Hash key", True), *((c, "Business key", False) for c in h.business_key_columns), *last]))
        for x in self.spec.links:
            keys = [(self.hubs[n].hash_key_name, f"FK to {n}", False) for n in x.hub_references if n in self.hubs]
            models.append((x.link_name, f"Link: {x.link_name}", [(x.hash_key_name, "Link hash key", True), *keys, *last]))
        for s in self.spec.satellites:
            own = [] if s.is_effectivity else [(s.hashdiff_name, "Hashdiff", False), *((c, "Descriptive attribute", False) for c in s.descriptive_columns)]
            models.append((s.satellite_name, f"Satellite: {s.satellite_name}", [(self.parent_key(s), "Parent hash key", False), *own, (self.cfg.effective_from_column, "Effective from", False), *last]))
        out = ["version: 2", "", "models:"]
        for name, text, columns in models:
            out += [f"  - name: {name}", f'    description: "{text}"', "    columns:"]
            for c, what, primary in columns:
                out += [f"      - name: {c}", f'        description: "{what}"']
                if primary:
                    out += ["        tests:", "          - unique", "          - not_null"]
        return "\n".join(out) + "\n"
