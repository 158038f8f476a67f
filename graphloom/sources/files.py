"""Python source files below a root, as a table (rel_path, content)."""

from __future__ import annotations

import os
from collections.abc import Collection, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.functions import paths
from graphloom.sources import git


def python_files(root: Path, exclude: Sequence[str] = ()) -> list[str]:
    """Relative paths of the files to analyse, in the order of their segments: what Git lists, else what is found on disk."""
    listed = git.tracked_files(root)
    found = (f for f in listed if _is_inside(root, f)) if listed is not None else _walk(root)
    kept = {f for f in found if f.endswith(".py") and not paths.is_excluded_text(f) and not paths.matches_text(f, exclude)}
    return sorted(kept, key=lambda f: f.split("/"))


def _is_inside(root: Path, name: str) -> bool:
    path = root / name
    return path.is_file() and path.resolve().is_relative_to(root.resolve())


def _walk(root: Path) -> Iterator[str]:
    for folder, folders, names in os.walk(root, onerror=None, followlinks=False):
        folders[:] = [f for f in folders if not paths.is_excluded_text(f"{f}/x") and not os.path.islink(os.path.join(folder, f))]
        for name in names:
            path = os.path.join(folder, name)
            if not os.path.islink(path) and os.path.isfile(path):
                yield os.path.relpath(path, root).replace(os.sep, "/")


def _content(path: str) -> tuple[bytes | None, str | None]:
    try:
        with open(path, "rb") as f:
            return f.read(), None
    except OSError as error:
        return None, f"{type(error).__name__}: {error.strerror or error}"


def source_files(spark: SparkSession, root: Path, exclude: Sequence[str] = (), only: Collection[str] | None = None) -> DataFrame:
    """The files' contents, read where they are parsed: only names leave the driver. ``only`` keeps some paths. A file that
    cannot be read has no content but ``read_error``.

    The executors must see ``root``. Spark's own file sources skip names that begin with an underscore, as every package's
    own file does, so they cannot be used here; sources that are in a table already need none of this.
    """
    names = [f for f in python_files(root, exclude) if only is None or f in only]
    where = str(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [_content(os.path.join(where, name)) for name in part.column(0).to_pylist()]
                contents, errors = (pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.binary(), pa.string())))
                yield pa.RecordBatch.from_arrays([part.column(0), contents, errors], ["rel_path", "content", "read_error"])

    listed = spark.createDataFrame([(f,) for f in names], "rel_path string")
    spread = max(1, min(len(names) // 16, 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(spread).mapInArrow(read, "rel_path string, content binary, read_error string")
