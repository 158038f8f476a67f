"""Documents of any size: written by the executors, and nothing but a few rows on the driver."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as Classic

from graphloom import api, embedded, reports
from graphloom.config import Settings
from graphloom.operators import findings
from graphloom.plans import catalogue
from graphloom.reports import documents


def text_of(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


@pytest.mark.parametrize("name", ["json_findings", "sarif_document"])
def test_documents_stay_on_the_executors(spark, sf_dir, monkeypatch, name):
    counts, collect = [], Classic.collect

    def counted(self):
        rows = collect(self)
        counts.append(len(rows))
        return rows

    monkeypatch.setattr(Classic, "collect", counted)
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert sum(counts) < 20 and df.count() > 100


def test_saved_documents_are_the_same(spark, tmp_path):
    for name, body in embedded.SOURCES.items():
        (tmp_path / "project" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "project" / name).write_text(body)
    a = api.analyze(spark, tmp_path / "project", Settings(ignore=("documentation/missing-docstring",)), use_history=False)
    odd = F.when(F.col("src_ordinal") % 2 == 0, F.lit('a "q", é\n \\,{')).otherwise(F.lit(""))
    rows = a.findings.withColumns({"suggestion": odd, "message": F.concat("message", odd), "line": F.when(F.col("severity") > 2, 0).otherwise(F.col("line"))})
    a.new_findings = rows.limit(2)
    for k, shown in enumerate((rows, rows.limit(0))):
        reports.save_sarif(a, str(tmp_path / f"sarif{k}"), shown)
        assert json.loads(text_of(tmp_path / f"sarif{k}")) == documents.sarif(a, shown)
    assert len(documents.sarif(a, rows)["runs"][0]["results"]) == rows.count() > 2
    reports.save_json(a, str(tmp_path / "json"), rows)
    saved = json.loads(text_of(tmp_path / "json"))
    assert saved == json.loads(reports.json_text(a, rows)) and saved["suppressed"]
    first = findings.ordered(rows).first()
    entry = documents.sarif(a, rows)["runs"][0]["results"][0]
    assert entry["message"] == ({"text": first.message, "markdown": f"{first.message}\n\n**What to do:** {first.suggestion}"} if first.suggestion else {"text": first.message})
    a.close()
