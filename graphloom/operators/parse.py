"""The parse stage, source files to nested module rows, and the flat relations inside them.

The stage is the only Python one: a syntax tree has no Spark expression. It neither shuffles nor gathers: a batch of
files goes in, a batch of rows comes out. All that follows is Catalyst's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.functions import paths
from graphloom.operators.visitor import module_row
from graphloom.session import spread

_FUNCTION = (
    "name string, qualname string, lineno int, end_lineno int, length int, parameters int, cyclomatic int, cognitive int,"
    " nesting int, class_name string, decorators array<string>, calls array<string>, attributes array<string>,"
    " is_stub boolean, has_docstring boolean"
)
_CLASS = (
    f"name string, lineno int, end_lineno int, length int, methods array<struct<{_FUNCTION}>>, attribute_count int,"
    " base_count int, lcom int, has_docstring boolean"
)
_IMPORT = "module string, name string, alias string, lineno int, is_from boolean, level int"
_SIGNAL = "kind string, lineno int, detail string"
MODULES = (
    "snapshot string, rel_path string, module_name string, is_package boolean, total_lines int, loc int,"
    f" functions array<struct<{_FUNCTION}>>, classes array<struct<{_CLASS}>>, imports array<struct<{_IMPORT}>>,"
    f" signals array<struct<{_SIGNAL}>>, exports array<string>, references array<string>, has_docstring boolean,"
    " syntax_error string, lines array<string>"
)
#: Files that one output batch holds.
BATCH = 64


def module_names(files: DataFrame, root_name: str = "root") -> DataFrame:
    """snapshot and name of each file's module, without a look at its content."""
    snapshot = F.col("snapshot") if "snapshot" in files.columns else F.lit("")
    return files.select(snapshot.cast("string").alias("snapshot"), paths.module_name(F.col("rel_path"), F.lit(root_name)).alias("name"))


def parse_sources(files: DataFrame, root_name: str = "root", repeated: bool = False) -> DataFrame:
    """``files`` (rel_path, content; optionally snapshot and read_error) to one module row each, null contents being empty
    files. A read error is the row's syntax error.

    ``root_name`` names a package at the root itself. ``repeated``: many files have the same content, such as those of a
    history's snapshots; each content is parsed once, and its rows are joined to its files by SHA-256.
    """
    snapshot = F.col("snapshot") if "snapshot" in files.columns else F.lit("")
    failed = F.col("read_error") if "read_error" in files.columns else F.lit(None)
    rows = files.select(
        snapshot.cast("string").alias("snapshot"),
        F.col("rel_path"),
        paths.module_name(F.col("rel_path"), F.lit(root_name)).alias("module_name"),
        paths.is_package(F.col("rel_path")).alias("is_package"),
        F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"),
        failed.cast("string").alias("read_error"),
    )
    return _once(rows) if repeated else _parsed(rows, MODULES)


def _parsed(rows: DataFrame, ddl: str) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH).to_pylist()
                found = [{**r, **module_row(r.pop("content"), r["module_name"], r.pop("read_error"))} for r in part]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.mapInArrow(run, ddl)


#: What a file's content says besides its place, which only qualified names need.
_CONTENT = MODULES[MODULES.index("total_lines") :]


def _once(rows: DataFrame) -> DataFrame:
    """The same rows as ``_parsed``, each content being parsed once, for a module without a name."""
    failed = F.col("read_error").isNotNull()
    rows = rows.withColumn("content", F.when(failed, F.lit(b"")).otherwise(F.col("content")))
    whole = F.when(failed, F.concat(F.lit(b"e"), F.col("read_error").cast("binary"))).otherwise(F.concat(F.lit(b"c"), "content"))
    key = F.unhex(F.sha2(whole, 256)).alias("content_key")
    texts = spread(rows.select("content", "read_error").distinct()).select(key, F.lit("").alias("module_name"), "content", "read_error")
    parsed = _parsed(texts, f"content_key binary, module_name string, {_CONTENT}").drop("module_name")
    prefix = F.nullif("module_name", F.lit(""))

    def named(functions: Column) -> Column:
        return F.transform(functions, lambda f: f.withField("qualname", F.concat_ws(".", prefix, f["qualname"])))

    found = rows.select("snapshot", "rel_path", "module_name", "is_package", key).join(parsed, "content_key")
    found = found.withColumns({"functions": named(F.col("functions")), "classes": F.transform("classes", lambda c: c.withField("methods", named(c["methods"])))})
    return found.select(*StructType.fromDDL(MODULES).names)


_KEYS = ("snapshot", "rel_path", "module_name")


def functions(modules: DataFrame) -> DataFrame:
    """One row per function and method: functions of a file first, then methods class by class (``ordinal``)."""
    every = F.concat("functions", F.flatten(F.transform("classes", lambda c: c["methods"])))
    rows = modules.select(*_KEYS, "is_package", F.posexplode(every).alias("ordinal", "f"))
    name = F.col("f.name")
    return rows.select(
        *_KEYS,
        "is_package",
        "ordinal",
        "f.*",
        F.col("f.class_name").isNotNull().alias("is_method"),
        (F.size("f.decorators") > 0).alias("is_decorated"),
        (name.startswith("_") & ~name.startswith("__")).alias("is_private"),
    )


def classes(modules: DataFrame) -> DataFrame:
    """One row per class with its sizes: methods, those that are not special, and their summed complexity."""
    rows = modules.select(*_KEYS, F.posexplode("classes").alias("ordinal", "c"))
    methods = F.col("c.methods")
    return rows.select(
        *_KEYS,
        "ordinal",
        "c.*",
        F.concat_ws(".", "module_name", "c.name").alias("symbol"),
        F.size(methods).alias("method_count"),
        F.size(F.filter(methods, lambda m: ~m["name"].startswith("__"))).alias("public_method_count"),
        F.aggregate(methods, F.lit(0), lambda a, m: a + m["cyclomatic"]).alias("wmc"),
    ).drop("methods")


def bound_name(i: Column) -> Column:
    """The name that an import binds: none for a star."""
    plain = F.when(i["module"] != "", F.coalesce(i["alias"], F.substring_index(i["module"], ".", 1)))
    return F.when(i["name"].isNull(), plain).when(i["name"] != "*", F.coalesce(i["alias"], i["name"]))


def is_reexport(i: Column) -> Column:
    """An alias that says the import is meant for others."""
    return i["alias"].isNotNull() & (i["name"].isNull() | (i["alias"] == i["name"]))


def import_text(i: Column) -> Column:
    from_ = F.concat(F.lit("from "), F.repeat(F.lit("."), i["level"]), i["module"], F.lit(" import "), i["name"])
    return F.when(i["is_from"], from_).otherwise(F.concat(F.lit("import "), i["module"]))


def imports(modules: DataFrame) -> DataFrame:
    """One row per imported name, with the name it binds and whether the file makes use of it."""
    rows = modules.select(*_KEYS, "is_package", "references", "exports", F.posexplode("imports").alias("ordinal", "i"))
    i, bound = F.col("i"), bound_name(F.col("i"))
    used = F.array_contains("references", F.col("bound")) | F.array_contains("exports", F.col("bound"))
    exempt = (i["module"] == "__future__") | is_reexport(i) | F.col("bound").isNull()
    return rows.withColumn("bound", bound).select(
        *_KEYS, "is_package", "ordinal", "i.*", "bound", import_text(i).alias("display"), (~exempt & ~F.coalesce(used, F.lit(False))).alias("unused")
    )


def signals(modules: DataFrame) -> DataFrame:
    return modules.select(*_KEYS, F.posexplode("signals").alias("ordinal", "s")).select(*_KEYS, "ordinal", "s.*")
