"""Sinks: documents made of an analysis.

All counting, ordering and limiting is done by Spark; what arrives here is formatted on the driver. JSON and SARIF texts
and baselines hold every finding by their nature; ``save_json`` and ``save_sarif`` write the same documents from the executors,
in parts, and ``save_findings`` a table.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from graphloom.reports.documents import dot_text, json_text, sarif_text, save_json, save_sarif
from graphloom.reports.pages import html_text, markdown_text, terminal_text
from graphloom.reports.small import explanation_text, review_text, search_text, trend_text

__all__ = [
    "dot_text", "emit", "explanation_text", "html_text", "json_text", "markdown_text", "review_text", "sarif_text",
    "save_findings", "save_json", "save_sarif", "search_text", "terminal_text", "trend_text",
]


def save_findings(findings: DataFrame, path: str, form: str = "parquet") -> None:
    findings.write.mode("overwrite").format(form).save(path)


def emit(text: str, output: Path | None, stream) -> None:
    """To a file, or to a stream whose encoding may lack characters."""
    if output is not None:
        output.parent.mkdir(parents=True, exist_ok=True)
        output.write_text(text if text.endswith("\n") else text + "\n", encoding="utf-8")
        return
    encoding = getattr(stream, "encoding", None) or "utf-8"
    stream.write(text.encode(encoding, "replace").decode(encoding) + "\n")
