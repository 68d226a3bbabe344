"""Reports of profiles, analyses and vault designs, as text and as HTML."""

from __future__ import annotations

from html import escape

from strataforge.models import AnalysisResult, DataVaultSpec, ProfileResult

WIDTH = 65
TITLE = "DATA PROFILE AND VAULT REPORT"
GREEN, YELLOW, RED = "#16a34a", "#ca8a04", "#dc2626"
TOP_KEYS, SHOWN_COLUMNS = 3, 5


def colour(score: float) -> str:
    return GREEN if score >= 0.8 else YELLOW if score >= 0.5 else RED


def short(columns: tuple[str, ...]) -> str:
    more = len(columns) - SHOWN_COLUMNS
    return ", ".join(columns[:SHOWN_COLUMNS]) + (f", +{more} more" if more > 0 else "")


def category(path: str) -> str:
    for part, name in (("/hubs/", "Hubs"), ("/links/", "Links"), ("/satellites/", "Satellites"), (".yml", "YAML"), ("pre_stg_", "Pre-stage"), ("/staging/", "Staging")):
        if part in path:
            return name
    return "Other"


class Report:
    """Sections as rows, rendered twice. A section is (title, [(subtitle, header, rows)])."""

    def __init__(self, profile_result: ProfileResult | None = None, analysis_result: AnalysisResult | None = None, vault_spec: DataVaultSpec | None = None, generated_files: dict[str, str] | None = None):
        self.profiles, self.analysis, self.vault, self.files = profile_result, analysis_result, vault_spec, generated_files

    def sections(self) -> list[tuple[str, list[tuple[str, list[str], list[list]]]]]:
        out = []
        if self.profiles:
            out.append(("PROFILING SUMMARY", [self._table(t) for t in self.profiles.tables]))
        if self.analysis:
            a = self.analysis
            keys = [(t, ["column", "score", "uniqueness", "nulls", "why"], [[c.column_name, c.score, f"{c.uniqueness:.2%}", f"{c.null_rate:.2%}", "; ".join(c.reasoning)] for c in cs[:TOP_KEYS]]) for t, cs in a.business_keys.items() if cs]
            out.append(("BUSINESS KEY CANDIDATES", keys))
            same = [[f"{m.table_a}.{m.column_a}", f"{m.table_b}.{m.column_b}", m.composite_score, m.match_type] for m in a.similarity_matches]
            refs = [[f"{r.child_table}.{r.child_column}", f"{r.parent_table}.{r.parent_column}", r.confidence, r.cardinality] for r in a.relationships]
            out.append(("CROSS-TABLE MATCHES", [("Similar columns", ["column", "like", "score", "type"], same), ("Relationships", ["child", "parent", "confidence", "cardinality"], refs)]))
            hist = [[h.table_name, h.scd_type.value, h.confidence, ", ".join(f"{t.column_name} ({t.role})" for t in h.temporal_columns), ", ".join(h.version_key_columns)] for h in a.historization.values()]
            out.append(("HISTORIZATION", [("", ["table", "type", "confidence", "temporal columns", "version key"], hist)]))
        if self.vault:
            v = self.vault
            out.append(("DATA VAULT SUGGESTION", [
                ("Hubs", ["hub", "business key", "sources", "hash key"], [[h.hub_name, ", ".join(h.business_key_columns), ", ".join(h.source_tables), h.hash_key_name] for h in v.hubs]),
                ("Links", ["link", "hubs", "sources"], [[x.link_name, " <-> ".join(x.hub_references), ", ".join(x.source_tables)] for x in v.links]),
                ("Satellites", ["satellite", "parent", "source", "columns", "history"], [[s.satellite_name, s.parent_name, s.source_table, "effectivity" if s.is_effectivity else short(s.descriptive_columns), s.scd_type.value] for s in v.satellites]),
            ]))
        if self.files:
            groups: dict[str, list[list]] = {}
            for path in self.files:
                groups.setdefault(category(path), []).append([path])
            out.append(("GENERATED FILES", [(f"{name} ({len(rows)})", ["path"], rows) for name, rows in groups.items()]))
        return out

    def _table(self, t):
        rows = []
        for c in t.column_profiles:
            it = c.inferred_type
            kind = c.spark_type + (f" -> {it.spark_target_type}" + (f" ({it.format_string})" if it.format_string else "") if it else "")
            rows.append([c.column_name, kind, f"{c.null_rate:.2%}", f"{c.distinct_count:,}", f"{c.uniqueness:.2%}", f"{c.dominant_pattern.value} {c.pattern_coverage:.0%}"])
        sampled = f", sampled {t.sample_fraction:.2%}" if t.sampled and t.sample_fraction else ""
        return f"{t.table_name}: {t.row_count:,} rows, {len(t.column_profiles)} columns{sampled}", ["column", "type", "nulls", "distinct", "unique", "pattern"], rows

    def to_text(self) -> str:
        lines = ["=" * WIDTH, TITLE.center(WIDTH)]
        if self.profiles:
            lines.append(f"Profiled at: {self.profiles.profiled_at}".center(WIDTH))
        lines.append("=" * WIDTH)
        for title, parts in self.sections():
            lines += ["", f"--- {title} {'-' * max(0, WIDTH - len(title) - 5)}"]
            for name, _, rows in parts:
                if name:
                    lines += ["", f"  {name}"]
                lines += ["    " + " | ".join(f"{x:.2f}" if isinstance(x, float) else str(x) for x in row) for row in rows] or ["    (none)"]
        return "\n".join([*lines, ""])

    def to_html(self) -> str:
        cell = lambda x: f'<td style="color:{colour(x)};font-weight:600">{x:.2f}</td>' if isinstance(x, float) else f"<td>{escape(str(x))}</td>"
        out = ['<div style="font-family:sans-serif;max-width:1100px">', f"<h1>{escape(TITLE.title())}</h1>"]
        if self.profiles:
            out.append(f"<p>Profiled at: {escape(self.profiles.profiled_at)}</p>")
        for title, parts in self.sections():
            out.append(f"<h2>{escape(title.title())}</h2>")
            for name, header, rows in parts:
                table = '<table style="border-collapse:collapse"><tr>' + "".join(f"<th>{escape(h)}</th>" for h in header) + "</tr>"
                table += "".join("<tr>" + "".join(map(cell, row)) + "</tr>" for row in rows) + "</table>"
                out.append(f"<details><summary>{escape(name or title.title())}</summary>{table}</details>" if title.startswith("PROFILING") else (f"<h3>{escape(name)}</h3>" if name else "") + table)
        return "\n".join([*out, "</div>"])
