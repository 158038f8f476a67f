"""Predicates and projections on relative POSIX paths."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that hold no sources of the project's own. Names that begin with a dot are excluded besides.
EXCLUDED_DIRS = (
    ".eggs", ".git", ".hg", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv",
    "__pycache__", "build", "dist", "env", "htmlcov", "node_modules", "site-packages", "venv",
)


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression for the JVM; a star also crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            inside = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"\&&")
            inside = "^" + inside[1:] if inside[:1] == "!" else "\\" + inside if inside[:1] == "^" else inside
            out.append(f"[{inside}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"(?s)^{''.join(out)}\\z"


def segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def matches_glob(path: Column, glob: str) -> Column:
    """Whether a pattern hits the whole path, a leading directory, the file name or, without a slash, any segment."""
    cleaned = glob.strip("/")
    if not cleaned:
        return F.lit(False)
    pattern = glob_regex(cleaned)
    hit = path.rlike(pattern) | path.startswith(f"{cleaned}/") | file_name(path).rlike(pattern)
    if "/" not in cleaned:
        hit = hit | F.exists(segments(path), lambda s: s.rlike(pattern))
    return hit


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    return reduce(or_, (matches_glob(path, g) for g in globs), F.lit(False))


def matches_text(path: str, globs: Sequence[str]) -> bool:
    """``matches_any`` of one path on the driver."""
    for glob in globs:
        cleaned = glob.strip("/")
        names = path.split("/")
        candidates = [path, names[-1], *(names if "/" not in cleaned else [])]
        if cleaned and (path.startswith(f"{cleaned}/") or any(fnmatch.fnmatchcase(x, cleaned) for x in candidates)):
            return True
    return False


def in_excluded_dir(path: Column) -> Column:
    """Whether a directory on the way is hidden or one of ``EXCLUDED_DIRS``; the file's own name does not matter."""
    parents = F.slice(segments(path), 1, F.size(segments(path)) - 1)
    return F.exists(parents, lambda s: s.startswith(".") | s.isin(*EXCLUDED_DIRS))


def is_excluded_text(path: str) -> bool:
    return any(s.startswith(".") or s in EXCLUDED_DIRS for s in path.split("/")[:-1])


def module_name(path: Column, fallback: Column) -> Column:
    """Dotted module name: without a leading ``src/`` and the suffix; a package is named by its directory."""
    inner = F.regexp_replace(path, "^src/", "")
    inner = F.regexp_replace(inner, r"(^|/)__init__\.py$", "")
    inner = F.regexp_replace(inner, r"\.py$", "")
    return F.coalesce(F.nullif(F.replace(inner, F.lit("/"), F.lit(".")), F.lit("")), fallback)


def is_test_module(path: Column) -> Column:
    name = file_name(path)
    return segments(path)[0].isin("tests", "test") | (name == "conftest.py") | name.startswith("test_") | name.endswith("_test.py")


def is_package(path: Column) -> Column:
    return path.endswith("__init__.py")
