"""Command line: ``python -m graphloom COMMAND``. Exit codes: 0, 1 for a failed gate or check, 2 for an error of the user."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, replace
from pathlib import Path

from graphloom import __version__, api, doctor, reports
from graphloom.config import NAME, Settings, load_settings
from graphloom.errors import AnalysisError
from graphloom.functions import severity
from graphloom.operators.rules import RULES
from graphloom.sources import baselines


def _session(options: argparse.Namespace):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName(NAME).config("spark.ui.showConsoleProgress", "false")
    session = (builder.master(options.master) if options.master else builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _settings(options: argparse.Namespace) -> Settings:
    settings = load_settings(options.path.resolve(), options.config)
    return replace(settings, exclude=(*settings.exclude, *options.exclude))


def _analysis(spark, options: argparse.Namespace, history: bool | None = None):
    root = options.path.resolve()
    if not root.is_dir():
        raise AnalysisError(f"{root} is no directory")
    since = getattr(options, "since", None)
    scope = api.changed_since(root, since) if since else api.Options()
    if hasattr(options, "baseline"):
        scope = replace(scope, baseline=baselines.resolve(root, options.baseline, not options.no_baseline))
    listen = (lambda p: print(f"{p.stage} ...", file=sys.stderr)) if options.verbose else None
    return api.analyze(spark, root, _settings(options), scope, history, listen)


def _analyze(spark, options) -> int:
    a = _analysis(spark, options, False if options.no_history else None)
    rows = a.at_or_above(severity.level_of(options.severity)) if options.severity else a.findings
    form = options.format
    makers = {"json": lambda: reports.json_text(a, rows), "sarif": lambda: reports.sarif_text(a, rows), "dot": lambda: reports.dot_text(a)}
    limited = {"markdown": reports.markdown_text, "html": reports.html_text, "text": reports.terminal_text}
    reports.emit(makers[form]() if form in makers else limited[form](a, rows, options.top), options.output, sys.stdout)
    failures = api.gate_failures(a, options.fail_under, options.fail_on_new)
    for failure in failures:
        print(f"failed: {failure}", file=sys.stderr)
    return int(bool(failures))


def _baseline(spark, options) -> int:
    a = _analysis(spark, options)
    path = options.output or options.path.resolve() / baselines.FILE_NAME
    print(f"{baselines.save(a.findings, path)} finding(s) accepted in {path}")
    return 0


def _trend(spark, options) -> int:
    report = api.trend(spark, options.path, _settings(options), options.samples, options.window)
    reports.emit(reports.trend_text(report, options.format), options.output, sys.stdout)
    return 0


def _search(spark, options) -> int:
    settings = _settings(options)
    if options.mode == "semantic":
        hits = api.semantic_search(spark, options.path, options.query, options.top, options.min_score, settings)
    else:
        hits = api.search_code(spark, options.path, options.query, options.top, options.min_score or 0.0, settings)
    print(reports.search_text(options.query, hits, options.format))
    return 0


def _index(spark, options) -> int:
    stats = api.build_index(spark, options.path, _settings(options), rebuild=options.rebuild)
    print(json.dumps(asdict(stats)))
    return 0


def _explain(spark, options) -> int:
    a = _analysis(spark, options)
    reports.emit(reports.explanation_text(api.explain(a, options.reference), options.format), options.output, sys.stdout)
    return 0


def _review(spark, options) -> int:
    a = _analysis(spark, options)
    limit = min(options.top, a.settings.llm.max_findings)
    reports.emit(reports.review_text(api.review(a, limit), options.format), options.output, sys.stdout)
    return 0


def _rules(_, options) -> int:
    for rule in RULES:
        print(f"{rule.id:<44} {rule.title}\n    {rule.description}")
    return 0


def _doctor(_, options) -> int:
    checks = doctor.run_checks(options.path.resolve(), options.config)
    for c in checks:
        print(f"{c.status:<8} {c.name:<14} {c.detail}" + (f"\n{'':24}{c.hint}" if c.hint else ""))
    return int(any(c.status == doctor.MISSING for c in checks))


def _number(least: int):
    def read(text: str) -> int:
        if (value := int(text)) < least:
            raise argparse.ArgumentTypeError(f"{least} or more is expected")
        return value

    return read


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(NAME, description="Where refactoring pays: code metrics, history and search on Spark.")
    top.add_argument("--version", action="version", version=f"{NAME} {__version__}")
    commands = top.add_subparsers(required=True, metavar="COMMAND")

    def command(name: str, run, text: str, needs_spark: bool = True, forms: tuple[str, ...] = ()):
        c = commands.add_parser(name, help=text)
        c.set_defaults(run=run, needs_spark=needs_spark)
        c.add_argument("--config", type=Path, help="settings file")
        c.add_argument("-x", "--exclude", action="append", default=[], help="glob of paths to leave out; may be repeated")
        c.add_argument("--master", help="Spark master, the environment's by default")
        c.add_argument("-v", "--verbose", action="store_true", help="say which stage begins")
        if forms:
            c.add_argument("-f", "--format", choices=forms, default=forms[0])
            c.add_argument("-o", "--output", type=Path, help="file to write")
        return c

    def place(c) -> None:
        c.add_argument("path", nargs="?", type=Path, default=Path(), help="root of the sources")

    def accepted(c) -> None:
        c.add_argument("--baseline", type=Path, help="file of accepted findings")
        c.add_argument("--no-baseline", action="store_true")
        c.add_argument("--since", help="analyse files changed since a revision only")

    c = command("analyze", _analyze, "analyse sources and report", forms=("text", "json", "markdown", "html", "sarif", "dot"))
    place(c)
    accepted(c)
    c.add_argument("--severity", choices=severity.LABELS, help="show findings from this severity on")
    c.add_argument("--top", type=_number(1), default=25, help="findings to show")
    c.add_argument("--no-history", action="store_true")
    c.add_argument("--fail-under", type=int, help="exit 1 below this score")
    c.add_argument("--fail-on-new", action="store_true", help="exit 1 on findings that no baseline accepts")
    place(c := command("baseline", _baseline, "accept all present findings"))
    c.add_argument("-o", "--output", type=Path)
    place(c := command("trend", _trend, "health over past commits", forms=("text", "json", "markdown")))
    c.add_argument("--samples", type=_number(2), default=10)
    c.add_argument("--window", type=_number(1), default=200, help="newest commits to sample from")
    c = command("search", _search, "search the code", forms=("text", "json"))
    c.add_argument("query")
    place(c)
    c.add_argument("--mode", choices=("lexical", "semantic"), default="lexical")
    c.add_argument("--top", type=_number(1), default=10)
    c.add_argument("--min-score", type=float)
    place(c := command("index", _index, "build or renew the vector index"))
    c.add_argument("--rebuild", action="store_true")
    c = command("explain", _explain, "explain one finding", forms=("text", "json", "markdown"))
    c.add_argument("reference", help="rule@path:line")
    place(c)
    accepted(c)
    place(c := command("review", _review, "findings that need attention", forms=("text", "json", "markdown")))
    accepted(c)
    c.add_argument("--top", type=_number(1), default=20)
    command("rules", _rules, "list the rules", needs_spark=False)
    place(command("doctor", _doctor, "check the environment", needs_spark=False))
    return top


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    try:
        return options.run(_session(options) if options.needs_spark else None, options)
    except AnalysisError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


__all__ = ["main", "parser"]
