"""Machine-readable documents: JSON, SARIF 2.1.0 and Graphviz."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import __version__
from graphloom.config import NAME
from graphloom.engine import Analysis, severity_counts
from graphloom.functions import severity
from graphloom.operators import findings as algebra
from graphloom.operators import graphs

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


_KEYS = ("rule_id", "title", "message", "severity", "severity_level", "category", "path", "line", "symbol", "suggestion", "details")


def entries(rows: DataFrame, new: DataFrame | None = None, with_new: bool = True) -> DataFrame:
    """What the JSON report says of each finding, with the columns that order findings (``severity_level`` is the number)."""
    if new is not None:
        marks = new.select("fingerprint").distinct().withColumn("is_new", F.lit(True))
        rows = rows.join(marks, "fingerprint", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    elif with_new:
        rows = rows.withColumn("is_new", F.lit(None).cast("boolean"))
    shown = rows.withColumn("severity_level", F.col("severity")).withColumn("severity", severity.label(F.col("severity")))
    return shown.select(*_KEYS, *(["is_new"] if with_new else []), "rule_ordinal", "src_ordinal")


def entry_order() -> list[Column]:
    return [F.desc("severity_level"), *algebra.order()[1:]]


def finding_entries(rows: DataFrame, new: DataFrame | None = None, with_new: bool = True) -> list[dict[str, Any]]:
    keys = [*_KEYS, *(["is_new"] if with_new else [])]
    return [{k: r[k] for k in keys} | {"details": json.loads(r.details)} for r in entries(rows, new, with_new).orderBy(*entry_order()).collect()]


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())), {"ignoreNullFields": "false"})


def _entry_texts(rows: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """place, value: ``finding_entries`` as JSON, a row each."""
    placed = algebra.ranked(entries(rows, new), entry_order(), "place")
    head = _json(**{k: F.col(k) for k in _KEYS if k != "details"})
    tail = F.concat(F.lit(',"details":'), "details", F.lit(',"is_new":'), F.coalesce(F.col("is_new").cast("string"), F.lit("null")), F.lit("}"))
    return placed.withColumn("head", head).select("place", F.concat(F.expr("left(head, length(head) - 1)"), tail).alias("value"))


def save_sections(spark: SparkSession, sections: list[str | DataFrame], folder: str) -> None:
    """Write one text in order: texts as they are, and tables (place from 1, value) as rows with commas between them. The
    folder's part files, one after the other by name, are the text; no process ever holds all of it."""
    frames = []
    for k, section in enumerate(sections):
        if isinstance(section, str):
            frame = spark.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(section).alias("value"))
        else:
            frame = section.select("place", F.when(F.col("place") > 1, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
        frames.append(frame.select(F.lit(k).alias("section"), "place", "value"))
    rows = reduce(DataFrame.unionByName, frames)
    rows.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("value").write.text(folder)


def _history(a: Analysis) -> dict[str, Any] | None:
    if a.history is None:
        return None
    rows = a.history.orderBy(F.desc("commits"), F.desc("churn"), "path").collect()
    keys = ("path", "commits", "insertions", "deletions", "churn", "authors")
    files = [{k: r[k] for k in keys} | {"last_modified": r.last_modified.isoformat() if r.last_modified else None} for r in rows]
    return dict(a.history_info or {}) | {"files": files}


def document(a: Analysis, findings: DataFrame | None = None) -> dict[str, Any]:
    """Everything that is known, as one object."""
    rows = a.findings if findings is None else findings
    return _document(a, finding_entries(rows, a.new_findings), finding_entries(a.suppressed))


def _document(a: Analysis, found: list[Any], suppressed: list[Any]) -> dict[str, Any]:
    s = a.score
    calls = a.call_edges.groupBy(F.col("callee").alias("name")).agg(F.countDistinct("caller").alias("n"))
    sizes = graphs.sizes(a.degrees, a.edges).first()
    known = a.findings.count() - a.new_findings.count() if a.new_findings is not None else 0
    return {
        "tool": {"name": NAME, "version": __version__},
        "repository": {"root": str(a.root), "files": a.file_count, "source_lines": a.source_lines},
        "score": {"value": s.score, "grade": s.grade, "penalty": s.penalty, "density": s.density, "severity_counts": severity_counts(a)},
        "graph": {
            "modules": sizes.modules,
            "internal_imports": sizes.imports,
            "cycles": a.cycles,
            "external_packages": {r.package: r.n for r in a.externals.orderBy(F.desc("n"), "package").collect()},
            "instability": [
                {"module": r.name, "instability": round(r.instability, 3), "afferent": r.fan_in, "efferent": r.fan_out}
                for r in graphs.top(a.degrees.where("instability > 0"), "instability", 5).collect()
            ],
        },
        "call_graph": {
            "functions": a.call_names.count(),
            "edges": a.call_edges.count(),
            "top_fan_in": [{"symbol": r.name, "callers": r.n} for r in graphs.top(calls, "n", 10).collect()],
        },
        "history": _history(a),
        "function_churn": [
            {"path": r.path, "symbol": r.qualname, "commits": r.commits, "authors": r.authors, "lines": r.lines, "last_modified": r.last_modified}
            for r in (a.churn.orderBy("path", "qualname").collect() if a.churn is not None else [])
        ],
        "baseline": None if a.new_findings is None else {"known": known, "new": a.new_findings.count(), "accepted": a.baseline_size},
        "scope": a.scope_label,
        "findings": found,
        "suppressed": suppressed,
        "warnings": list(a.warnings),
        "duration_seconds": round(a.duration, 4),
        "thresholds": a.settings.thresholds.as_dict(),
    }


def json_text(a: Analysis, findings: DataFrame | None = None, indent: int = 2) -> str:
    return json.dumps(document(a, findings), indent=indent, ensure_ascii=False, default=str)


def save_json(a: Analysis, folder: str, findings: DataFrame | None = None) -> None:
    """``document`` with any number of findings, as ``save_sections`` writes it."""
    marks = [f"<{k}-{uuid.uuid4().hex}>" for k in range(2)]  # stand for the findings in the text around them
    around = json.dumps(_document(a, marks[:1], marks[1:]), ensure_ascii=False, default=str)
    before, rest = around.split(json.dumps(marks[0]))
    between, after = rest.split(json.dumps(marks[1]))
    rows = a.findings if findings is None else findings
    save_sections(a.modules.sparkSession, [before, _entry_texts(rows, a.new_findings), between, _entry_texts(a.suppressed), after], folder)


def sarif_results(rows: DataFrame) -> DataFrame:
    """Adds ``value``, a finding as a SARIF result in JSON."""
    advised = _json(text=F.col("message"), markdown=F.concat("message", F.lit("\n\n**What to do:** "), "suggestion"))
    line = F.when(F.col("line") != 0, F.col("line")).otherwise(1)
    place = F.struct(
        F.struct(F.col("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")
    )
    head = _json(ruleId=F.col("rule_id"), level=severity.sarif_level(F.col("severity")))
    tail = _json(
        locations=F.array(F.struct(place.alias("physicalLocation"))),
        partialFingerprints=F.struct(F.col("fingerprint").alias(f"{NAME}/v1")),
        properties=F.struct(severity.label(F.col("severity")).alias("severity"), "symbol", "category"),
    )
    said = F.when(F.col("suggestion") != "", advised).otherwise(_json(text=F.col("message")))
    return rows.withColumns({"_head": head, "_tail": tail, "_said": said}).withColumn(
        "value", F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"message":'), "_said", F.lit(","), F.expr("substring(_tail, 2)"))
    ).drop("_head", "_tail", "_said")


def _sarif(rules: list[Any], results: list[Any]) -> dict[str, Any]:
    driver = {"name": NAME, "version": __version__, "rules": rules}
    return {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}


def _described(rule: str, title: str, category: str) -> dict[str, Any]:
    return {"id": rule, "name": title, "shortDescription": {"text": title}, "properties": {"category": category}}


def sarif(a: Analysis, findings: DataFrame | None = None) -> dict[str, Any]:
    results, described = [], {}
    for r in algebra.ordered(sarif_results(a.findings if findings is None else findings)).collect():
        described.setdefault(r.rule_id, _described(r.rule_id, r.title, r.category))
        results.append(json.loads(r.value))
    return _sarif(list(described.values()), results)


def sarif_text(a: Analysis, findings: DataFrame | None = None) -> str:
    return json.dumps(sarif(a, findings), indent=2, ensure_ascii=False)


def save_sarif(a: Analysis, folder: str, findings: DataFrame | None = None) -> None:
    """``sarif`` with any number of findings, as ``save_sections`` writes it: a line a result."""
    rows = algebra.ranked(sarif_results(a.findings if findings is None else findings), algebra.order(), "place")
    first = rows.groupBy("rule_id").agg(F.min("place").alias("place"), F.min_by(F.struct("title", "category"), "place").alias("r"))  # a row a rule
    mark = f"<{uuid.uuid4().hex}>"
    rules = [_described(r.rule_id, r.r.title, r.r.category) for r in first.orderBy("place").collect()]
    before, after = json.dumps(_sarif(rules, [mark]), ensure_ascii=False).split(json.dumps(mark))
    save_sections(a.modules.sparkSession, [before, rows.select("place", "value"), after], folder)


def dot_text(a: Analysis) -> str:
    lines = graphs.dot(a.degrees, a.edges).orderBy("part", "line").collect()
    return "\n".join([f"digraph {NAME} {{", *(r.line for r in lines), "}"])
