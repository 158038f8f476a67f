"""Documents about a few rows: trends, search hits, explanations and reviews."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators.packs import Explanation, Review


def best_and_worst(samples: list[dict[str, Any]]) -> tuple[dict, dict] | None:
    """The first of the highest scores and the first of the lowest ones."""
    if not samples:
        return None
    return max(samples, key=lambda s: s["score"]), min(samples, key=lambda s: s["score"])


def trend_text(report: dict[str, Any], form: str = "text") -> str:
    if form == "json":
        return json.dumps(report, indent=2, ensure_ascii=False)
    samples = report["samples"]
    if not samples:
        return "No commits."
    first, last, (best, worst) = samples[0], samples[-1], best_and_worst(samples)
    line = f"Score {first['score']} ({first['short_sha']}) to {last['score']} ({last['short_sha']}), {report['delta']:+d}; best {best['score']} ({best['short_sha']}), worst {worst['score']} ({worst['short_sha']})"
    keys = ("short_sha", "date", "score", "grade", "findings", "critical", "high", "loc", "files", "subject")
    rows = [[str(s["date"])[:10] if k == "date" else str(s[k]) for k in keys] for s in samples]
    if form == "markdown":
        escaped = [[c.replace("|", "\\|") for c in r] for r in rows]
        return "\n".join([f"**{line}**", "", f"| {' | '.join(keys)} |", "|" + " --- |" * len(keys), *(f"| {' | '.join(r)} |" for r in escaped)])
    widths = [max(len(x) for x in column) for column in zip(keys, *rows)]
    return "\n".join([line, "", *("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in [list(keys), *rows])])


def search_text(query: str, hits: DataFrame, form: str = "text") -> str:
    place = text.location(F.col("path"), F.col("lineno")).alias("location")
    rows = hits.select("score", "kind", "symbol", "path", "lineno", "end_lineno", "text", place, text.preview(F.col("text")).alias("preview")).collect()
    if form == "json":
        keys = ("kind", "symbol", "path", "lineno", "end_lineno", "text", "score")
        return json.dumps({"query": query, "results": [{k: r[k] for k in keys} for r in rows]}, indent=2, ensure_ascii=False)
    if not rows:
        return f"Nothing matches {query!r}."
    return "\n".join(f"{r.score:>9.4f}  {r.kind:<9} {r.location:<40} {r.symbol}\n{'':11}{r.preview}" for r in rows)


def explanation_text(e: Explanation, form: str = "text") -> str:
    if form == "json":
        return json.dumps({"finding": asdict(e.facts), **{k: getattr(e, k) for k in ("summary", "why", "risks", "actions", "model", "notes")}}, indent=2, ensure_ascii=False)
    mark = "## " if form == "markdown" else ""
    place = e.facts.path if e.facts.line is None else f"{e.facts.path}:{e.facts.line}"
    out = [f"{mark}{e.facts.title} ({e.facts.severity})", "", place, "", e.summary]
    for title, lines in (("Why", e.why), ("Risks", e.risks), ("What to do", e.actions), ("Notes", e.notes)):
        if lines:
            out += ["", f"{'### ' if mark else ''}{title}", *(f"- {x}" for x in lines)]
    return "\n".join(out)


def review_text(r: Review, form: str = "text") -> str:
    if form == "json":
        return json.dumps({"summary": r.summary, "items": [asdict(i) for i in r.items], "model": r.model, "notes": r.notes, "findings": [asdict(f) for f in r.facts]}, indent=2, ensure_ascii=False)
    out = [f"{'## ' if form == 'markdown' else ''}{r.summary}", ""]
    for k, item in enumerate(r.items, 1):
        place = item.path if item.line is None else f"{item.path}:{item.line}"
        out += [f"{k}. {item.severity}: {place}", f"   {item.rationale}", *([f"   {item.action}"] if item.action else [])]
    return "\n".join([*out, *(f"note: {n}" for n in r.notes)])
