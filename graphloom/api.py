"""The public functions. Each takes a SparkSession; tables come back as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphloom.backends import HostedEmbedder, HostedModel, LocalEmbedder
from graphloom.config import Settings, Thresholds, load_settings
from graphloom.engine import Analysis, Options, Progress, analyze, analyze_sources, changed_since, gate_failures, trend
from graphloom.errors import AnalysisError, ConfigurationError, IndexUnavailable, MissingBackend, RepositoryNotFound
from graphloom.operators import chunks, index, packs, parse, search
from graphloom.operators import findings as algebra
from graphloom.operators.index import IndexStats
from graphloom.operators.rules import RULES, Context, Rule
from graphloom.operators.search import HashEmbedder
from graphloom.sources import files
from graphloom.sources.baselines import Baseline

__all__ = [
    "RULES", "Analysis", "AnalysisError", "Baseline", "ConfigurationError", "Context", "HashEmbedder", "HostedEmbedder", "HostedModel", "IndexStats",
    "IndexUnavailable", "LocalEmbedder", "MissingBackend", "Options", "Progress", "RepositoryNotFound", "Rule", "Settings", "Thresholds",
    "analyze", "analyze_sources", "build_index", "changed_since", "code_chunks", "create_embedder", "create_model", "explain", "gate_failures",
    "load_settings", "review", "search_code", "semantic_search", "trend",
]


def _root(root: str | Path) -> Path:
    root = Path(root).resolve()
    if not root.is_dir():
        raise RepositoryNotFound(f"{root} is no directory")
    return root


def code_chunks(spark: SparkSession, root: str | Path, settings: Settings | None = None) -> DataFrame:
    """Searchable pieces of all files below ``root``. Rules and scores are not computed for it."""
    root = _root(root)
    settings = settings or load_settings(root)
    return chunks.chunks(parse.parse_sources(files.source_files(spark, root, settings.exclude), root.name))


def search_code(spark: SparkSession, root: str | Path, query: str, limit: int = 10, min_score: float = 0.0, settings: Settings | None = None) -> DataFrame:
    """The pieces that match a query best, lexically."""
    found = search.bm25(code_chunks(spark, root, settings), search.query_tokens(spark, query), symbol="symbol")
    return search.top_hits(found, limit, min_score)


def create_embedder(settings: Settings):
    """The backend of the settings. One that needs a package says so when it is first asked."""
    kinds = {"hash": lambda model: HashEmbedder(name=model), "fastembed": LocalEmbedder, "api": HostedEmbedder}
    return kinds[settings.semantic.provider](settings.semantic.model)


def create_model(settings: Settings):
    """The text model of the settings; None if they name none."""
    return None if settings.llm.model == "none" else HostedModel(settings.llm.model, settings.llm.timeout)


def _folder(root: Path, settings: Settings) -> str:
    path = settings.semantic.index_dir
    return path if "://" in path or Path(path).is_absolute() else str(root / path)


def build_index(spark: SparkSession, root: str | Path, settings: Settings | None = None, embedder=None, rebuild: bool = False) -> IndexStats:
    """Build or renew the vector index of the code below ``root``."""
    root = _root(root)
    settings = settings or load_settings(root)
    pieces = code_chunks(spark, root, settings)
    return index.build(pieces, _folder(root, settings), embedder or create_embedder(settings), rebuild)


def semantic_search(spark: SparkSession, root: str | Path, query: str, limit: int | None = None, min_score: float | None = None, settings: Settings | None = None, embedder=None) -> DataFrame:
    """The indexed pieces that are most similar to a query."""
    root = _root(root)
    settings = settings or load_settings(root)
    s = settings.semantic
    return index.find(spark, _folder(root, settings), query, embedder or create_embedder(settings), s.top_k if limit is None else limit, s.min_score if min_score is None else min_score)


def explain(result: Analysis, reference: str, model: packs.TextModel | None = None, name: str | None = None) -> packs.Explanation:
    """What one finding (``rule@path:line``) means."""
    from graphloom.engine import pack_of

    rows = packs.lookup(result.findings, reference)
    pack = pack_of(result, rows, "explain")
    if not pack.facts:
        raise AnalysisError(f"no finding fits {reference!r}")
    return packs.explain(pack, model, name)


def review(result: Analysis, limit: int = 20, model: packs.TextModel | None = None, name: str | None = None) -> packs.Review:
    """The findings that need attention: the new ones where a baseline is given."""
    from graphloom.engine import pack_of

    rows = result.new_findings if result.new_findings is not None else result.findings
    scope = [("since", result.scope_label)] if result.scope_label else []
    return packs.review(pack_of(result, algebra.ordered(rows).limit(limit), "review", scope), model, name)
