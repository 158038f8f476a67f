"""Queries on Python sources that are generated from ``part``, a file a row, so that the parse stage and what reads its
rows run over whole tables. The SQL beside each states the measures by formula, or builds the same text and cuts it."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import engine
from graphloom.config import Settings
from graphloom.operators import chunks, findings, parse, resolve, rules
from graphloom.plans import analogues as A
from graphloom.plans.registry import query
from graphloom.session import cut, shared_dir, spread
from graphloom.tables import table


def _files(spark, d, source: str, path: str = "'m' || p_partkey || '.py'") -> DataFrame:
    """The sources that an SQL expression gives for each part. The table is small for the work in it, so its rows are dealt out."""
    return spread(table(spark, d, "part").select("p_partkey", "p_size")).selectExpr(f"{path} AS rel_path", f"{source} AS content")


def _parsed(spark, d, source: str, path: str = "'m' || p_partkey || '.py'", repeated: bool = True) -> DataFrame:
    """Modules of the sources. Most are made from few remainders of the keys, so that many files have the same text."""
    return parse.parse_sources(_files(spark, d, source, path), "demo", repeated)


def _key() -> Column:
    return F.regexp_extract("rel_path", r"(\d+)\.py$", 1).cast("long").alias("p_partkey")


# a function of key % 12 parameters: perhaps a docstring, p_size % 20 conditions in a row, key % 6 loops in each other
_FUNCTION = r"""'def f(' || array_join(slice(array('a','b','c','d','e','g','h','i','j','k','l'), 1, CAST(p_partkey % 12 AS INT)), ', ') || '):\n'
 || CASE WHEN p_partkey % 5 = 0 THEN '    "d"\n' ELSE '' END || repeat('    if x:\n        return 1\n', CAST(p_size % 20 AS INT))
 || array_join(transform(slice(array(1, 2, 3, 4, 5), 1, CAST(p_partkey % 6 AS INT)), i -> repeat('    ', i) || 'while x:\n'), '')
 || CASE WHEN p_partkey % 6 > 0 THEN repeat('    ', CAST(p_partkey % 6 AS INT) + 1) || 'pass\n' ELSE '' END || '    return g(h())\n'"""
_FUNCTION_SQL = r"""'def f(' || array_to_string(list_slice(['a','b','c','d','e','g','h','i','j','k','l'], 1, p_partkey % 12), ', ') || '):' || chr(10)
 || CASE WHEN p_partkey % 5 = 0 THEN '    "d"' || chr(10) ELSE '' END || repeat('    if x:' || chr(10) || '        return 1' || chr(10), p_size % 20)
 || array_to_string(list_transform(range(1, p_partkey % 6 + 1), lambda i: repeat('    ', i) || 'while x:' || chr(10)), '')
 || CASE WHEN p_partkey % 6 > 0 THEN repeat('    ', p_partkey % 6 + 1) || 'pass' || chr(10) ELSE '' END || '    return g(h())' || chr(10)"""
_LENGTH_SQL = "CAST(2 + (p_partkey % 5 = 0)::INT + 2 * (p_size % 20) + p_partkey % 6 + (p_partkey % 6 > 0)::INT AS INTEGER)"


@query(
    f"""SELECT p_partkey, 'm' || p_partkey || '.f' AS qualname, 1 AS lineno, {_LENGTH_SQL} AS length, CAST(p_partkey % 12 AS INTEGER) AS parameters,
    CAST(1 + p_size % 20 + p_partkey % 6 AS INTEGER) AS cyclomatic, CAST(p_size % 20 + (p_partkey % 6) * (p_partkey % 6 + 1) / 2 AS INTEGER) AS cognitive,
    CAST(greatest((p_size % 20 > 0)::INT, p_partkey % 6) AS INTEGER) AS nesting, p_partkey % 5 = 0 AS has_docstring, 'g,h' AS calls FROM part"""
)
def parsed_functions(spark, d):
    rows = parse.functions(_parsed(spark, d, _FUNCTION))
    return rows.select(_key(), "qualname", "lineno", "length", "parameters", "cyclomatic", "cognitive", "nesting", "has_docstring", F.array_join("calls", ",").alias("calls"))


@query(
    f"""WITH s AS (SELECT p_partkey, {_FUNCTION_SQL} AS source, {_LENGTH_SQL} AS n FROM part), l AS (SELECT *, string_split(rtrim(source, chr(10)), chr(10)) AS lines FROM s),
    c AS (SELECT p_partkey, 'module' AS kind, 'm' || p_partkey AS symbol, least(n, 20) AS end_lineno, array_to_string(list_slice(lines, 1, 20), chr(10)) AS body FROM l
    UNION ALL SELECT p_partkey, 'function', 'm' || p_partkey || '.f', n, array_to_string(lines, chr(10)) FROM l)
    SELECT p_partkey, kind, symbol, end_lineno, sha1('m' || p_partkey || '.py' || chr(0) || kind || chr(0) || symbol) AS chunk_id, sha1(body) AS content_hash FROM c"""
)
def code_chunks(spark, d):
    rows = chunks.chunks(_parsed(spark, d, _FUNCTION)).withColumnRenamed("path", "rel_path")
    return rows.select(_key(), "kind", "symbol", "end_lineno", "chunk_id", "content_hash")


# comments, an empty line, statements; every fiftieth file does not parse
_LINES = r"""CASE WHEN p_partkey % 3 = 0 THEN '"d"\n' ELSE '' END || repeat('# c\n', CAST(p_size % 4 AS INT)) || repeat('\n', CAST(p_partkey % 2 AS INT))
 || repeat('x = (1,  # c\n     2)\n', CAST(p_size % 5 AS INT)) || CASE WHEN p_partkey % 50 = 0 THEN 'def (:\n' ELSE '' END"""
_PACKAGE = "CASE p_partkey % 4 WHEN 0 THEN 'src/a/b' || p_partkey || '/__init__.py' WHEN 1 THEN 'a/' || p_partkey || '.py' ELSE p_partkey || '.py' END"


@query(
    """SELECT CASE p_partkey % 4 WHEN 0 THEN 'a.b' || p_partkey WHEN 1 THEN 'a.' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS module_name, p_partkey % 4 = 0 AS is_package,
    CAST((p_partkey % 3 = 0)::INT + p_size % 4 + p_partkey % 2 + 2 * (p_size % 5) + (p_partkey % 50 = 0)::INT AS INTEGER) AS total_lines,
    CAST(CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE (p_partkey % 3 = 0)::INT + 2 * (p_size % 5) END AS INTEGER) AS loc,
    p_partkey % 3 = 0 AND p_partkey % 50 <> 0 AS has_docstring, p_partkey % 50 = 0 AS broken FROM part"""
)
def parsed_modules(spark, d):
    rows = _parsed(spark, d, _LINES, _PACKAGE)
    return rows.select("module_name", "is_package", "total_lines", "loc", "has_docstring", F.col("syntax_error").isNotNull().alias("broken"))


@query("SELECT 'm' || p_partkey || '.py' AS path, 1 AS line, 3 AS severity FROM part WHERE p_partkey % 50 = 0")
def rule_syntax_error(spark, d):
    return rules.only("correctness/syntax-error", rules.Context(_parsed(spark, d, _LINES))).select("path", "line", "severity")


_RISKS = (
    ("security/dynamic-execution", 3, "eval(x)"),
    ("security/shell-execution", 3, "run(x, shell=True)"),
    ("security/unsafe-deserialization", 3, "pickle.loads(x)"),
    ("security/weak-hash", 2, "hashlib.new(\"MD5\")"),
    ("security/insecure-temp-file", 2, "tempfile.mktemp()"),
    ("security/hardcoded-secret", 3, "api_token = \"k3y-k3y-k3y\""),
    (None, 0, "hashlib.md5(x, usedforsecurity=False)"),
    (None, 0, "api_token = \"changeme-now\""),
)


@query(
    "SELECT 'm' || p_partkey || '.py' AS path, rule_id, severity, CAST(1 + p_size % 3 AS INTEGER) AS line FROM part JOIN (VALUES "
    + ", ".join(f"({k}, '{r}', {s})" for k, (r, s, _) in enumerate(_RISKS) if r)
    + f") v(k, rule_id, severity) ON p_partkey % {len(_RISKS)} = k"
)
def security_rules(spark, d):
    lines = ", ".join(f"'{line}'" for _, _, line in _RISKS)
    modules = _parsed(spark, d, f"repeat('\\n', CAST(p_size % 3 AS INT)) || element_at(array({lines}), CAST(p_partkey % {len(_RISKS)} AS INT) + 1)")
    found, _ = rules.run(rules.Context(modules), tuple(r for r in rules.RULES if r.category == "security"))
    return found.select("path", "rule_id", "severity", "line")


# a class of 2 + p_size % 9 methods, the k-th using attribute k % (1 + key % 6), with one special and one empty method
_CLASS = r"""'class K(B):\n    z = 1\n    def __init__(self):\n        self.q = self.a0\n    def empty(self):\n        pass\n'
 || array_join(transform(sequence(1, CAST(2 + p_size % 9 AS INT)), k -> '    def m' || k || '(self, a):\n        return self.a' || (k % (1 + p_partkey % 6)) || '\n'), '')"""


@query(
    """SELECT p_partkey, CAST(4 + p_size % 9 AS INTEGER) AS methods, CAST(3 + p_size % 9 AS INTEGER) AS public_methods, CAST(4 + p_size % 9 AS INTEGER) AS wmc, 2 AS attributes, 1 AS bases,
    CAST(6 + 2 * (2 + p_size % 9) AS INTEGER) AS length, CAST(least(2 + p_size % 9, 1 + p_partkey % 6) AS INTEGER) AS lcom FROM part"""
)
def parsed_classes(spark, d):
    rows = parse.classes(_parsed(spark, d, _CLASS))
    return rows.select(
        _key(), F.col("method_count").alias("methods"), F.col("public_method_count").alias("public_methods"), "wmc", F.col("attribute_count").alias("attributes"), F.col("base_count").alias("bases"), "length", "lcom"
    )


_IMPORTS = r"'from m' || (p_partkey * 7 % 3000 + 1) || ' import f as g\nimport m' || (p_partkey + p_size) || '.inner, ext' || (p_size % 5) || '\ndef f():\n    return g()\n'"
_IMPORTS_SQL = """names AS (SELECT 'm' || p_partkey AS name FROM part),
 i AS (SELECT 'm' || p_partkey AS src, unnest(['m' || (p_partkey * 7 % 3000 + 1), 'm' || (p_partkey + p_size), 'ext' || (p_size % 5)]) AS dst FROM part)"""


def _import_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, d, _IMPORTS)
    return resolve.import_graph(parse.parse_sources(files, "demo"), parse.module_names(files, "demo"))


@query(f"WITH {_IMPORTS_SQL} SELECT DISTINCT src, dst FROM i WHERE dst IN (SELECT name FROM names) AND src <> dst")
def import_edges(spark, d):
    return _import_graph(spark, d)[0].select("src", "dst")


@query(f"WITH {_IMPORTS_SQL} SELECT dst AS package, count(*) AS n FROM i WHERE dst NOT IN (SELECT name FROM names) GROUP BY dst")
def import_packages(spark, d):
    return _import_graph(spark, d)[1].select("package", "n")


@query("WITH names AS (SELECT p_partkey AS k FROM part) SELECT 'm' || p_partkey || '.f' AS caller, 'm' || (p_partkey * 7 % 3000 + 1) || '.f' AS callee FROM part WHERE p_partkey * 7 % 3000 + 1 IN (SELECT k FROM names) AND p_partkey * 7 % 3000 + 1 <> p_partkey")
def call_edges(spark, d):
    modules = cut(_parsed(spark, d, _IMPORTS, repeated=False).drop("lines", "signals"))  # read many times
    return resolve.call_graph(modules)[1].select("caller", "callee")


@query("SELECT 'm' || p_partkey || '.py' AS path, CAST(unnest([2, 2]) AS INTEGER) AS line FROM part")
def rule_unused_import(spark, d):
    return rules.only("dead-code/unused-import", rules.Context(_parsed(spark, d, _IMPORTS, repeated=False))).select("path", "line")


# --- whole documents


def analysis(modules: DataFrame, found: DataFrame) -> engine.Analysis:
    """A finished analysis of given modules and findings, without graphs."""
    none = modules.limit(0)
    return engine.Analysis(Path("."), Settings(), modules, none, none, none, none, found, found.limit(0))


def _told(spark, d) -> DataFrame:
    """The findings of ``part`` with the columns that reports show."""
    said = {n: F.lit(n) for n in ("title", "message", "suggestion")} | {"details": F.lit("{}")}
    return findings.with_fingerprint(A.findings(spark, d).withColumns(said))


@query(
    f"WITH {A.FINDINGS} SELECT rule_id, CASE WHEN severity >= 3 THEN 'error' WHEN severity = 2 THEN 'warning' ELSE 'note' END AS level, path AS uri, coalesce(line, 1) AS start_line, count(*) AS n FROM findings GROUP BY ALL"
)
def sarif_document(spark, d):
    """Written as a document and read again, a line a result."""
    from graphloom.reports import documents

    place = f"{shared_dir(spark).rstrip('/')}/sarif-{uuid.uuid4().hex}"
    documents.save_sarif(analysis(A.modules(spark, d), _told(spark, d)), place)
    location = "locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>"
    results = spark.read.text(place).select(F.from_json(F.ltrim(F.col("value"), F.lit(",")), f"ruleId string, level string, {location}").alias("r")).where("r.ruleId IS NOT NULL")
    at = F.col("r.locations")[0]["physicalLocation"]
    rows = results.select(F.col("r.ruleId").alias("rule_id"), "r.level", at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"))
    return rows.groupBy("rule_id", "level", "uri", "start_line").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {A.FINDINGS} SELECT row_number() OVER (ORDER BY severity DESC, path, coalesce(line, 0), rule_id, rule_ordinal, src_ordinal) AS place, rule_id, {A.LABEL} AS severity, severity AS severity_level, path, line, symbol FROM findings"
)
def json_findings(spark, d):
    """The entries of the JSON report, in its order."""
    from graphloom.reports import documents

    rows = findings.ranked(documents.entries(_told(spark, d), with_new=False), documents.entry_order(), "place")
    return rows.select("place", "rule_id", "severity", "severity_level", "path", "line", "symbol")
