"""Settings of an analysis, from TOML or code. Thresholds become literals of the query plans."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from graphloom.errors import ConfigurationError

#: Name of the tool's own file and table.
NAME = "graphloom"


@dataclass(frozen=True)
class Thresholds:
    # A user's existing settings have these names and defaults.
    cyclomatic_warn: int = 10
    cyclomatic_high: int = 15
    cyclomatic_critical: int = 20
    cognitive_warn: int = 15
    cognitive_high: int = 25
    cognitive_critical: int = 40
    function_length_warn: int = 60
    function_length_high: int = 100
    function_length_critical: int = 200
    parameters_warn: int = 5
    parameters_high: int = 8
    nesting_warn: int = 4
    nesting_high: int = 6
    file_loc_warn: int = 400
    file_loc_high: int = 800
    file_loc_critical: int = 1500
    god_object_methods: int = 15
    god_object_loc: int = 250
    god_object_wmc: int = 70
    lcom_warn: int = 3
    lcom_high: int = 5
    hotspot_min_cyclomatic: int = 10
    hotspot_min_commits: int = 5

    def as_dict(self) -> dict[str, int]:
        return asdict(self)


@dataclass(frozen=True)
class SearchSettings:
    """The vector index. ``hash`` is the provider that needs no model."""

    provider: str = "hash"
    model: str = "token-hash-256"
    index_dir: str = f".{NAME}"
    top_k: int = 8
    min_score: float = 0.25


@dataclass(frozen=True)
class ModelSettings:
    """A text model that may explain findings; keys are never part of the settings."""

    model: str = "none"
    timeout: int = 60
    max_findings: int = 20


@dataclass(frozen=True)
class Settings:
    thresholds: Thresholds = field(default_factory=Thresholds)
    exclude: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    use_git_history: bool = True
    history_commits: int = 500
    blame_files: int = 10
    llm: ModelSettings = field(default_factory=ModelSettings)
    semantic: SearchSettings = field(default_factory=SearchSettings)


PROVIDERS = ("api", "fastembed", "hash")


def _whole(least: int) -> Callable[[str, Any], int]:
    what = {0: "zero or a positive integer", 1: "a positive integer"}[least]

    def check(key: str, value: Any) -> int:
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise ConfigurationError(f"{key} must be {what}")
        return value

    return check


def _of(kind: type, what: str, fits: Callable[[Any], bool] = lambda _: True) -> Callable[[str, Any], Any]:
    def check(key: str, value: Any) -> Any:
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool) or not fits(value):
            raise ConfigurationError(f"{key} must be {what}")
        return value

    return check


def _strings(key: str, value: Any) -> tuple[str, ...]:
    if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
        raise ConfigurationError(f"{key} must be a list of strings")
    return tuple(value)


def _ignored(key: str, value: Any) -> tuple[str, ...]:
    entries = _strings(key, value)
    for entry in entries:
        parse_suppression(entry)
    return entries


def _section(cls: type, checks: dict[str, Callable]) -> Callable[[str, Any], Any]:
    """A table whose keys are checked one by one; unknown ones are typing errors, or secrets that do not belong here."""

    def check(key: str, value: Any) -> Any:
        if not isinstance(value, dict):
            raise ConfigurationError(f"{key} must be a table")
        if unknown := sorted(set(value) - set(checks)):
            raise ConfigurationError(f"unknown keys in {key}: {', '.join(unknown)} (known: {', '.join(sorted(checks))})")
        return cls(**{k: checks[k](f"{key}.{k}", v) for k, v in value.items()})

    return check


def _share(key: str, value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ConfigurationError(f"{key} must be a number from 0 to 1")
    return float(value)


_text = _of(str, "a text that is not empty", str.strip)
_SETTINGS = {
    "thresholds": _section(Thresholds, {f.name: _of(int, "an integer") for f in fields(Thresholds)}),
    "exclude": _strings,
    "ignore": _ignored,
    "use_git_history": _of(bool, "true or false"),
    "history_commits": _whole(1),
    "blame_files": _whole(0),
    "llm": _section(ModelSettings, {"model": _text, "timeout": _whole(1), "max_findings": _whole(1)}),
    "semantic": _section(
        SearchSettings,
        {
            "provider": _of(str, f"one of {', '.join(PROVIDERS)}", lambda v: v in PROVIDERS),
            "model": _text,
            "index_dir": _text,
            "top_k": _whole(1),
            "min_score": _share,
        },
    ),
}


def parse_settings(table: dict[str, Any]) -> Settings:
    return _section(Settings, _SETTINGS)("configuration", table)


def parse_suppression(entry: str) -> tuple[str, str | None]:
    """``rule`` or ``rule@glob`` to (rule, glob)."""
    rule, at, glob = (part.strip() for part in entry.partition("@"))
    if not rule:
        raise ConfigurationError(f"the ignore entry {entry!r} names no rule")
    if at and not glob:
        raise ConfigurationError(f"the ignore entry {entry!r} has an empty path pattern")
    return rule, glob or None


def _document(path: Path) -> dict[str, Any]:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except OSError as error:
        raise ConfigurationError(f"{path} cannot be read: {error}") from error
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise ConfigurationError(f"{path} is not valid TOML: {error}") from error


def load_settings(root: Path, file: Path | None = None) -> Settings:
    """Settings from ``file``, else from the tool's own file or the project file in ``root``, the first that has any."""
    for path in [file] if file else [root / f"{NAME}.toml", root / "pyproject.toml"]:
        if file is None and not path.is_file():
            continue
        document = _document(path)
        tool = document.get("tool")
        table = tool.get(NAME) if isinstance(tool, dict) else None
        if not isinstance(table, dict):
            table = document.get(NAME)
        if not isinstance(table, dict):
            table = document if file or path.name == f"{NAME}.toml" else {}
        if table or file:
            return parse_settings(table)
    return Settings()
