"""Reports for people: Markdown, a self-contained HTML page and plain text for a terminal."""

from __future__ import annotations

from html import escape
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphloom.engine import Analysis, severity_counts
from graphloom.functions import severity, text
from graphloom.operators import findings as algebra
from graphloom.operators import graphs, history


def _first(rows: DataFrame, limit: int) -> list[Row]:
    place = text.location(F.col("path"), F.col("line")).alias("place")
    return algebra.ordered(rows).limit(limit).select("*", place).collect()


def _cell(value: Any) -> str:
    return str("" if value is None else value).replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], rows: list[list[Any]]) -> list[str]:
    return [f"| {' | '.join(head)} |", "|" + " --- |" * len(head), *(f"| {' | '.join(map(_cell, r))} |" for r in rows), ""]


def _facts(a: Analysis) -> list[tuple[str, Any]]:
    facts = [("Score", f"{a.score.score} ({a.score.grade})"), ("Files", a.file_count), ("Lines of code", a.source_lines)]
    facts += [(name.capitalize(), n) for name, n in reversed(severity_counts(a).items())]
    if a.new_findings is not None:
        facts += [("New findings", a.new_findings.count()), ("Accepted", a.baseline_size)]
    if a.scope_label:
        facts.append(("Changed since", a.scope_label))
    facts.append(("Suppressed", a.suppressed.count()))
    return facts + [("Seconds", f"{a.duration:.2f}")]


def _hot(a: Analysis, limit: int = 5) -> list[Row]:
    return [] if a.history is None else history.hotspots(a.history, limit).collect()


def markdown_text(a: Analysis, findings: DataFrame | None = None, top: int = 25) -> str:
    rows = a.findings if findings is None else findings
    out = [f"# Code health of {a.root.name}", "", *_table(["", ""], [list(f) for f in _facts(a)]), "## Findings", ""]
    categories: dict[str, list[Row]] = {}
    for r in algebra.top_per_group(rows, "category", top, algebra.order()).orderBy("category", "place").collect():
        categories.setdefault(r.category, []).append(r)
    for name, found in categories.items():
        lines = [[severity.LABELS[r.severity], r.path if r.line is None else f"{r.path}:{r.line}", r.title, r.message] for r in found]
        out += [f"### {name}", "", *_table(["Severity", "Place", "Rule", "Message"], lines)]
        if found[0].omitted:
            out += [f"{found[0].omitted} more are not shown.", ""]
    if not categories:
        out += ["None.", ""]
    if a.new_findings is not None:
        out += ["## New findings", "", *(f"- `{r.place}` {r.message}" for r in _first(a.new_findings, top)), ""]
    if hidden := _first(a.suppressed, top):
        out += ["## Suppressed", "", *(f"- `{r.place}` {r.rule_id}" for r in hidden), ""]
    out += ["## Dependencies", "", f"{a.edges.count()} internal imports, {len(a.cycles)} cycle(s).", "", *(f"- {' <-> '.join(c)}" for c in a.cycles), ""]
    unstable = graphs.top(a.degrees.where("instability > 0"), "instability", 5).collect()
    out += _table(["Module", "Instability", "In", "Out"], [[r.name, round(r.instability, 3), r.fan_in, r.fan_out] for r in unstable])
    if hot := _hot(a):
        out += ["## Hotspots", "", *_table(["File", "Commits", "Lines changed", "Heat"], [[r.path, r.commits, r.churn, r.heat] for r in hot])]
    if a.warnings:
        out += ["## Warnings", "", *(f"- {w}" for w in a.warnings), ""]
    out += ["## Thresholds", "", *_table(["Name", "Value"], [[k, v] for k, v in a.settings.thresholds.as_dict().items()])]
    return "\n".join(out)


_STYLE = "body{font:15px system-ui;margin:2em auto;max-width:70em}td,th{padding:.3em .6em;text-align:left;vertical-align:top;border-bottom:1px solid #ddd}table{border-collapse:collapse;width:100%}.critical{color:#a00}.high{color:#c50}.medium{color:#880}button{margin-right:.4em}"
_SCRIPT = "document.querySelectorAll('button').forEach(b=>b.onclick=()=>document.querySelectorAll('tr[data-severity]').forEach(r=>r.hidden=b.value!=='all'&&r.dataset.severity!==b.value))"


def _html_table(head: list[str], rows: list[list[Any]]) -> str:
    body = "".join("<tr>" + "".join(f"<td>{escape(str(c))}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><tr>{''.join(f'<th>{escape(h)}</th>' for h in head)}</tr>{body}</table>"


def html_text(a: Analysis, findings: DataFrame | None = None, top: int = 100) -> str:
    rows = a.findings if findings is None else findings
    lines = []
    for r in _first(rows, top):
        label = severity.LABELS[r.severity]
        cells = "".join(f"<td>{escape(str(c or ''))}</td>" for c in (label, r.place, r.title, r.message, r.suggestion))
        lines.append(f'<tr class="{label}" data-severity="{label}">{cells}</tr>')
    total = rows.count()
    more = f"<p>{total - top} more are not shown.</p>" if total > top else ""
    buttons = "".join(f'<button value="{x}">{x}</button>' for x in ("all", *reversed(severity.LABELS)))
    parts = [
        f"<h1>Code health of {escape(a.root.name)}</h1>",
        _html_table(["", ""], [list(f) for f in _facts(a)]),
        f"<h2>Findings</h2><p>{buttons}</p><table><tr><th>Severity</th><th>Place</th><th>Rule</th><th>Message</th><th>What to do</th></tr>{''.join(lines)}</table>{more}",
    ]
    if hidden := _first(a.suppressed, top):
        parts.append("<h2>Suppressed</h2>" + _html_table(["Place", "Rule"], [[r.place, r.rule_id] for r in hidden]))
    parts.append(f"<h2>Dependencies</h2><p>{a.edges.count()} internal imports, {len(a.cycles)} cycle(s)</p>" + _html_table(["Cycle"], [[" <-> ".join(c)] for c in a.cycles]))
    if hot := _hot(a):
        parts.append("<h2>Hotspots</h2>" + _html_table(["File", "Commits", "Lines changed", "Heat"], [[r.path, r.commits, r.churn, r.heat] for r in hot]))
    parts.append("<h2>Thresholds</h2>" + _html_table(["Name", "Value"], [[k, v] for k, v in a.settings.thresholds.as_dict().items()]))
    head = f'<meta charset="utf-8"><title>Code health of {escape(a.root.name)}</title><style>{_STYLE}</style>'
    return f"<!doctype html><html><head>{head}</head><body>{''.join(parts)}<script>{_SCRIPT}</script></body></html>"


def bar(score: int, width: int = 10) -> str:
    filled = max(0, min(width, score * width // 100))
    return "#" * filled + "-" * (width - filled)


def terminal_text(a: Analysis, findings: DataFrame | None = None, top: int = 25) -> str:
    rows = a.findings if findings is None else findings
    out = [f"{a.root.name}: [{bar(a.score.score)}] {a.score.score}/100, grade {a.score.grade}", ""]
    out += [f"  {name:<16}{value}" for name, value in _facts(a)]
    by_category = rows.groupBy("category").count().orderBy(F.desc("count"), "category").collect()
    out += ["", "Categories", *(f"  {r.category:<16}{r['count']}" for r in by_category)]
    place, message = text.shorten_path(text.location(F.col("path"), F.col("line")), 44), text.shorten(F.col("message"), 90)
    shown = algebra.ordered(rows).limit(top).select("severity", place.alias("place"), message.alias("message")).collect()
    out += ["", "Findings", *(f"  {severity.LABELS[r.severity]:<9} {r.place:<44} {r.message}" for r in shown)]
    if (left := rows.count() - len(shown)) > 0:
        out.append(f"  and {left} more")
    out += ["", f"Imports: {a.edges.count()} internal, {len(a.cycles)} cycle(s); calls: {a.call_edges.count()}"]
    out += [f"  {' <-> '.join(c)}" for c in a.cycles[:5]]
    if hot := _hot(a):
        out += ["", "Hotspots", *(f"  {r.heat:>5.1f}  {r.path} ({r.commits} commits, {r.churn} lines)" for r in hot)]
    out += [f"warning: {w}" for w in a.warnings]
    return "\n".join(out)
