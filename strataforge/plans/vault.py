"""Hubs, links and satellites from an analysis. Driver logic over column metadata."""

from __future__ import annotations

from strataforge.config import VaultConfig
from strataforge.functions.names import normalize_name
from strataforge.models import AnalysisResult, DataVaultSpec, HubSpec, LinkSpec, ProfileResult, SatelliteSpec, SCDType

VERSIONED = (SCDType.TYPE2, SCDType.SNAPSHOT)


class VaultDesigner:
    def __init__(self, config: VaultConfig | None = None):
        self.cfg = config or VaultConfig()

    def suggest(self, profiles: ProfileResult, analysis: AnalysisResult) -> DataVaultSpec:
        keys = {t: k for t, k in analysis.top_keys().items()}
        hubs, home = self._hubs(keys, analysis)
        links = self._links(keys, hubs, home, analysis)
        satellites = self._satellites(keys, profiles, home, links, analysis)
        sources: dict[str, list[str]] = {}
        for name, tables in [(h.hub_name, h.source_tables) for h in hubs] + [(x.link_name, x.source_tables) for x in links] + [(s.satellite_name, (s.source_table,)) for s in satellites]:
            for t in tables:
                sources.setdefault(t, []).append(name)
        return DataVaultSpec(tuple(hubs), tuple(links), tuple(satellites), sources)

    def _hubs(self, keys: dict[str, str], analysis: AnalysisResult) -> tuple[list[HubSpec], dict[str, HubSpec]]:
        """A hub per table's key; tables whose keys match each other share one. Also table -> its hub."""
        leader = {t: t for t in keys}
        order = {t: i for i, t in enumerate(keys)}

        def lead(t: str) -> str:
            while leader[t] != t:
                t = leader[t]
            return t

        for m in analysis.similarity_matches:
            if keys.get(m.table_a) == m.column_a and keys.get(m.table_b) == m.column_b:
                a, b = sorted((lead(m.table_a), lead(m.table_b)), key=order.get)
                leader[b] = a
        members: dict[str, list[str]] = {}
        for t in keys:
            members.setdefault(lead(t), []).append(t)
        hubs, home, taken = [], {}, {}
        for first, tables in members.items():
            base = normalize_name(keys[first]).removesuffix("_id").removesuffix("_key")
            taken[base] = taken.get(base, 0) + 1
            if taken[base] > 1:  # another hub has this name
                base = f"{base}_{normalize_name(first)}"
            hub = HubSpec(f"{self.cfg.hub_prefix}{base}", tuple(dict.fromkeys(keys[t] for t in tables)), tuple(sorted(tables)), f"{base}{self.cfg.hash_key_suffix}", {t: keys[t] for t in tables})
            hubs.append(hub)
            home |= dict.fromkeys(tables, hub)
        return hubs, home

    def _links(self, keys: dict[str, str], hubs: list[HubSpec], home: dict[str, HubSpec], analysis: AnalysisResult) -> list[LinkSpec]:
        """A link per pair of hubs, from the most certain relationship between them."""
        out: dict[tuple[str, ...], LinkSpec] = {}
        for r in analysis.relationships:
            parent = home.get(r.parent_table)
            if parent is None or r.parent_column not in parent.business_key_columns:
                parent = next((h for h in hubs if r.parent_column in h.business_key_columns), None)
            child = home.get(r.child_table)
            if parent is None or child is None or parent.hub_name == child.hub_name:
                continue
            pair = tuple(sorted((parent.hub_name, child.hub_name)))
            if pair not in out:
                base = "_".join(h.removeprefix(self.cfg.hub_prefix) for h in pair)
                columns = {parent.hub_name: (r.child_column,), child.hub_name: (keys[r.child_table],)}
                out[pair] = LinkSpec(f"{self.cfg.link_prefix}{base}", pair, {h: columns[h] for h in pair}, (r.child_table,), f"{base}{self.cfg.hash_key_suffix}")
        return list(out.values())

    def _satellites(self, keys, profiles: ProfileResult, home: dict[str, HubSpec], links: list[LinkSpec], analysis: AnalysisResult) -> list[SatelliteSpec]:
        """Per table what is left of its columns; per link of a versioned table an effectivity satellite."""
        used = {t: {k} for t, k in keys.items()}
        for h in analysis.historization.values():
            used.setdefault(h.table_name, set()).update(t.column_name for t in h.temporal_columns)
        for x in links:
            for t in x.source_tables:
                used.setdefault(t, set()).update(c for cols in x.foreign_key_columns.values() for c in cols)
        kind = lambda t: analysis.historization[t].scd_type if t in analysis.historization else SCDType.NONE
        out = []
        for t in profiles.tables:
            hub = home.get(t.table_name)
            rest = tuple(c.column_name for c in t.column_profiles if c.column_name not in used.get(t.table_name, ()))
            if hub and rest:
                name = f"{self.cfg.sat_prefix}{hub.hub_name.removeprefix(self.cfg.hub_prefix)}_{normalize_name(t.table_name)}"
                out.append(SatelliteSpec(name, hub.hub_name, "hub", rest, t.table_name, self.cfg.hashdiff_name, False, kind(t.table_name)))
        for x in links:
            source = next((t for t in x.source_tables if kind(t) in VERSIONED), None)
            if source:
                out.append(SatelliteSpec(f"{self.cfg.sat_prefix}eff_{x.link_name.removeprefix(self.cfg.link_prefix)}", x.link_name, "link", (), source, self.cfg.hashdiff_name, True, kind(source)))
        return out
