"""Checks of the environment, each with what to do about it."""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
import sys
from dataclasses import dataclass
from pathlib import Path

from graphloom import api
from graphloom.config import Settings, load_settings
from graphloom.errors import ConfigurationError
from graphloom.sources import git

OK, WARN, MISSING = "ok", "warn", "missing"


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    detail: str
    hint: str = ""


def _module(name: str, needed: bool) -> Check:
    if importlib.util.find_spec(name):
        return Check(name, OK, "importable")
    return Check(name, MISSING if needed else WARN, "not installed", f"install {name}" if needed else f"optional: install {name}")


def _java() -> Check:
    path = shutil.which("java")
    if path is None:
        return Check("java", MISSING, "not found", "install a Java runtime of version 17 or later")
    said = subprocess.run([path, "-version"], capture_output=True, text=True, check=False).stderr.splitlines()
    return Check("java", OK, said[0] if said else path)


def _git(root: Path) -> Check:
    if shutil.which("git") is None:
        return Check("git", WARN, "not found", "install git for history, trends and changed files")
    head = git.head(root)
    return Check("git", OK, f"{head.branch or 'detached'} at {head.sha[:7]}") if head else Check("git", WARN, "no history here", "history, trends and hotspots need a repository with commits")


def _index(root: Path, settings: Settings) -> Check:
    at = Path(settings.semantic.index_dir)
    at = at if at.is_absolute() else root / at
    found = (at / "current.json").is_file()
    return Check("vector index", OK if found else WARN, str(at) if found else "not built", "" if found else "run the index command for semantic search")


def run_checks(root: Path, config: Path | None = None) -> list[Check]:
    version = ".".join(map(str, sys.version_info[:3]))
    checks = [Check("python", OK if sys.version_info >= (3, 11) else MISSING, version, "" if sys.version_info >= (3, 11) else "Python 3.11 or later is needed"), _java()]
    try:
        settings = load_settings(root, config)
        checks.append(Check("configuration", OK, str(config or "found or default")))
    except ConfigurationError as error:
        settings = Settings()
        checks.append(Check("configuration", MISSING, str(error), "correct the file"))
    checks += [_git(root), *(_module(m, True) for m in ("pyspark", "pyarrow", "pandas", "numpy")), *(_module(m, False) for m in ("duckdb", "fastembed"))]
    checks.append(_index(root, settings))
    try:
        api.create_embedder(settings)
        checks.append(Check("embeddings", OK, settings.semantic.provider))
    except api.MissingBackend as error:
        checks.append(Check("embeddings", WARN, str(error), "set semantic.provider to hash"))
    model = settings.llm.model
    checks.append(Check("text model", OK if model == "none" else WARN, model, "" if model == "none" else "pass a model object; none is bundled"))
    return checks
