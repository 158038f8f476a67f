"""A whole analysis: sources to modules, graphs, history, findings and score, as lazy tables around two cached ones."""

from __future__ import annotations

import time
from collections.abc import Callable, Collection
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graphloom.config import Settings, load_settings
from graphloom.errors import RepositoryNotFound
from graphloom.functions import severity
from graphloom.operators import findings as algebra
from graphloom.operators import graphs, history, parse, resolve, rules, scoring
from graphloom.sources import files, git
from graphloom.sources.baselines import Baseline


@dataclass(frozen=True)
class Progress:
    """A stage that begins."""

    stage: str
    current: int = 0
    total: int = 0


Listener = Callable[[Progress], None]


@dataclass(frozen=True)
class Options:
    baseline: Baseline | None = None
    #: Analyse these paths only, for instance those changed since a revision that ``scope_label`` names.
    scope: frozenset[str] | None = None
    scope_label: str | None = None


@dataclass
class Analysis:
    """Results. Tables are DataFrames; what is small by nature is collected once, when it is first asked for."""

    root: Path
    settings: Settings
    modules: DataFrame
    edges: DataFrame
    externals: DataFrame
    call_names: DataFrame
    call_edges: DataFrame
    findings: DataFrame
    suppressed: DataFrame
    new_findings: DataFrame | None = None
    baseline_size: int | None = None
    scope_label: str | None = None
    history: DataFrame | None = None
    history_info: dict[str, Any] | None = None
    churn: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    duration: float = 0.0
    _cached: list[DataFrame] = field(default_factory=list)

    def at_or_above(self, level: int) -> DataFrame:
        return algebra.at_or_above(self.findings, level)

    @cached_property
    def score(self) -> Row:
        return scoring.health_score(self.findings, self.modules.select("loc")).first()

    @cached_property
    def file_count(self) -> int:
        return self.modules.count()

    @property
    def source_lines(self) -> int:
        return self.score.loc

    @cached_property
    def cycles(self) -> list[list[str]]:
        rows = graphs.cycles(graphs.cyclic_components(self.edges)).collect()
        return [list(r.members) for r in sorted(rows, key=lambda r: (-r["size"], r.members))]

    @cached_property
    def degrees(self) -> DataFrame:
        names = self.modules.select("snapshot", F.col("module_name").alias("name")).distinct()
        return graphs.degrees(names, self.edges).withColumn("instability", graphs.instability(F.col("fan_in"), F.col("fan_out")))

    def close(self) -> None:
        for frame in self._cached:
            frame.unpersist()


def analyze_sources(
    spark: SparkSession,
    sources: DataFrame,
    settings: Settings | None = None,
    options: Options | None = None,
    root: Path | None = None,
    use_history: bool = False,
    listen: Listener | None = None,
) -> Analysis:
    """Analyse a table of sources (rel_path, content; optionally snapshot), wherever it comes from."""
    began = time.perf_counter()
    settings, options, root = settings or Settings(), options or Options(), root or Path(".")
    tell = listen or (lambda _: None)
    tell(Progress("parsing"))
    modules = parse.parse_sources(sources, root.resolve().name or "root").persist(StorageLevel.MEMORY_AND_DISK)
    tell(Progress("graph"))
    edges, externals = resolve.import_graph(modules)
    names, calls = resolve.call_graph(modules)
    past = info = churn = None
    if use_history:
        tell(Progress("history"))
        past, info, churn = _history(spark, root, modules, settings)
    tell(Progress("rules"))
    context = rules.Context(modules, settings.thresholds, edges, past, churn)
    found, warnings = rules.run(context)
    found = algebra.with_callers(found, names, calls)
    found = found.withColumn("details", algebra.add_detail(F.col("details"), "callers", F.col("callers"))).drop("callers")
    found = algebra.with_fingerprint(found).persist(StorageLevel.MEMORY_AND_DISK)
    warnings += [f"an ignore entry names the unknown rule {r}" for r in algebra.unknown_rules(settings.ignore, [r.id for r in rules.RULES])]
    kept, suppressed = algebra.split_suppressed(found, settings.ignore)
    new = algebra.split_baseline(kept, options.baseline.frame(spark))[0] if options.baseline else None
    result = Analysis(root, settings, modules, edges, externals, names, calls, kept, suppressed, new)
    result.baseline_size = options.baseline.size if options.baseline else None
    result.scope_label, result.history, result.history_info, result.churn, result.warnings = options.scope_label, past, info, churn, warnings
    result._cached += [modules, found]
    result.score  # noqa: B018  runs the analysis, so that the duration is its own
    result.duration = time.perf_counter() - began
    return result


def analyze(
    spark: SparkSession,
    root: str | Path,
    settings: Settings | None = None,
    options: Options | None = None,
    use_history: bool | None = None,
    listen: Listener | None = None,
) -> Analysis:
    """Analyse the Python files below ``root``, by its own settings unless others are given."""
    root = Path(root).resolve()
    if not root.is_dir():
        raise RepositoryNotFound(f"{root} is no directory")
    settings, options = settings or load_settings(root), options or Options()
    if listen:
        listen(Progress("discovering"))
    sources = files.source_files(spark, root, settings.exclude, options.scope)
    return analyze_sources(spark, sources, settings, options, root, settings.use_git_history if use_history is None else use_history, listen)


def _history(spark: SparkSession, root: Path, modules: DataFrame, settings: Settings) -> tuple[DataFrame | None, dict | None, DataFrame | None]:
    head = git.head(root)
    if head is None:
        return None, None, None
    changes, commits = git.file_changes(spark, root, settings.history_commits)
    known = changes.join(modules.select(F.col("rel_path").alias("path")).distinct(), "path", "left_semi")
    past = history.file_history(known).persist()
    info = {"total_commits": commits, "max_commits": settings.history_commits, "head_sha": head.sha, "branch": head.branch}
    if settings.blame_files <= 0:
        return past, info, None
    # the most changed files first, then those of them that changed often: the order matters
    hot = history.top_churn(past, settings.blame_files).where(F.col("commits") >= settings.thresholds.hotspot_min_commits)
    functions = parse.functions(modules).join(F.broadcast(hot.select(F.col("path").alias("rel_path"))), "rel_path", "left_semi")
    return past, info, git.function_churn(root, functions).persist()


def trend(spark: SparkSession, root: str | Path, settings: Settings | None = None, samples: int = 10, window: int = 200, listen: Listener | None = None) -> dict[str, Any]:
    """Health of evenly spaced commits, oldest first: one job over all their files."""
    from graphloom.operators import trend as over_time

    root = Path(root).resolve()
    if git.head(root) is None:
        raise RepositoryNotFound(f"{root} has no Git history")
    settings = settings or load_settings(root)
    if listen:
        listen(Progress("sampling"))
    every = git.commits(root, window)
    chosen = [every[k] for k in over_time.positions(len(every), samples)]
    sources = git.snapshot_files(spark, root, [c.sha for c in chosen], settings.exclude)
    modules = parse.parse_sources(sources, root.name).persist(StorageLevel.MEMORY_AND_DISK)
    edges, _ = resolve.import_graph(modules)
    found, _ = rules.run(rules.Context(modules, settings.thresholds, edges))
    kept, _ = algebra.split_suppressed(found, settings.ignore)
    scored = {r.snapshot: r for r in over_time.snapshot_scores(modules, kept).collect()}  # a row a sample
    modules.unpersist()
    rows = []
    for c in reversed(chosen):
        r = scored.get(c.sha)  # a commit without Python files has no finding and no line
        measures = {k: r[k] for k in ("score", "grade", "findings", "critical", "high", "loc", "files")} if r else {"score": 100, "grade": "A", "findings": 0, "critical": 0, "high": 0, "loc": 0, "files": 0}
        rows.append({"sha": c.sha, "short_sha": c.sha[:7], "date": c.committed_at, "subject": c.subject, **measures})
    scores = spark.createDataFrame([(k, r["score"]) for k, r in enumerate(rows)], "at int, score int")
    return {"window": window, "delta": over_time.summary(scores, "at").first().delta, "samples": rows}


def gate_failures(result: Analysis, fail_under: int | None = None, fail_on_new: bool = False) -> list[str]:
    """Why a build should fail: too low a score, or new findings (without a baseline, any)."""
    out = []
    if fail_under is not None and result.score.score < fail_under:
        out.append(f"score {result.score.score} is below {fail_under}")
    if fail_on_new:
        rows = result.new_findings if result.new_findings is not None else result.findings
        if n := rows.count():
            out.append(f"{n} new finding(s)")
    return out


def changed_since(root: Path, revision: str) -> Options:
    return Options(scope=git.changed_paths(root, revision), scope_label=revision)


def pack_of(result: Analysis, rows: DataFrame, task: str, scope: Collection[tuple[str, Any]] = ()):
    """Facts of some findings with those of the repository."""
    from graphloom.operators import packs

    facts = packs.facts(rows, result.call_names, result.call_edges, result.churn)
    about = {"root": result.root.name, "files": result.file_count, "source_lines": result.source_lines, "score": result.score.score, "grade": result.score.grade, "import_cycles": len(result.cycles)}
    return packs.Pack(task, facts, about, dict(scope))


def severity_counts(result: Analysis) -> dict[str, int]:
    return {name: result.score[name] for name in severity.LABELS}
