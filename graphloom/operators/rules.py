"""The detection rules: each a condition on a relation and what to say where it holds.

A rule is a name and a function from the context (relations and thresholds) to its matches; a new one is one more entry of
``RULES``. All matches on one relation are evaluated in one pass over it, however many rules look at it. Plans are built
lazily, so a rule that cannot be planned is reported and the others still run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import Thresholds
from graphloom.functions import paths, severity
from graphloom.operators import graphs, history, parse
from graphloom.operators.findings import SCHEMA


@dataclass
class Context:
    """Relations that rules read. ``history`` and ``churn`` may be None; ``given`` has those that are not to be made of the
    modules, by name."""

    modules: DataFrame
    thresholds: Thresholds = field(default_factory=Thresholds)
    edges: DataFrame | None = None
    history: DataFrame | None = None
    churn: DataFrame | None = None
    given: dict[str, DataFrame] = field(default_factory=dict)

    def _relation(self, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return self.given[of.__name__] if of.__name__ in self.given else of(self.modules)

    @cached_property
    def functions(self) -> DataFrame:
        return self._relation(parse.functions)

    @cached_property
    def classes(self) -> DataFrame:
        return self._relation(parse.classes)

    @cached_property
    def imports(self) -> DataFrame:
        return self._relation(parse.imports)

    @cached_property
    def signals(self) -> DataFrame:
        return self._relation(parse.signals)


@dataclass(frozen=True)
class Match:
    """Rows of a relation (with snapshot and rel_path) where a rule holds, and its part of the finding as a struct."""

    relation: DataFrame
    where: Column
    said: Column
    #: Number of the rule in a run.
    rule: int = -1


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    description: str
    suggestion: str
    find: Callable[[Context], list[Match]]

    @property
    def category(self) -> str:
        return self.id.partition("/")[0]


def _match(relation: DataFrame, where: Column | None = None, *, level: Column, message: Column, line: Column | None = None, symbol: Column | None = None, ordinal: Column | None = None, **details: Column) -> list[Match]:
    """What a rule says of its rows; the rest of a finding is the same for all of them."""
    none = lambda kind: F.lit(None).cast(kind)
    values = F.to_json(F.struct(*(v.alias(k) for k, v in details.items())), {"ignoreNullFields": "false"}) if details else F.lit("{}")
    said = F.struct(
        level.cast("int").alias("severity"),
        message.alias("message"),
        (none("int") if line is None else line.cast("int")).alias("line"),
        (none("string") if symbol is None else symbol).alias("symbol"),
        values.alias("details"),
        (F.lit(0) if ordinal is None else ordinal).cast("long").alias("src_ordinal"),
    )
    return [Match(relation, F.lit(True) if where is None else where, said)]


def _measure(column: str, what: str, warn: str, bounds: tuple[str, ...], name: str | None = None):
    """A rule on one measured value of functions, scaled by up to three thresholds."""

    def find(c: Context) -> list[Match]:
        t = c.thresholds.as_dict()
        value, limits = F.col(column), [t[b] for b in bounds]
        level = severity.scaled(value, *limits) if len(limits) == 3 else F.when(value >= limits[-1], severity.HIGH).otherwise(severity.MEDIUM)
        names = dict(zip(("warn", "high", "critical"), map(F.lit, limits)))
        message = F.format_string(f"`%s`: {what} is %d, from %d on it is reported.", "qualname", value, F.lit(t[warn]))
        return _match(c.functions, value >= t[warn], level=level, message=message, line=F.col("lineno"), symbol=F.col("qualname"), ordinal=F.col("ordinal"), **{name or column: value}, **names)

    return find


def _syntax_errors(c: Context) -> list[Match]:
    message = F.format_string("%s cannot be parsed (%s).", "rel_path", "syntax_error")
    return _match(c.modules, F.col("syntax_error").isNotNull(), level=F.lit(severity.HIGH), message=message, line=F.lit(1), error=F.col("syntax_error"))


def _many_parameters(c: Context) -> list[Match]:
    t, n = c.thresholds, F.col("parameters")
    level = F.when(n > t.parameters_high, severity.HIGH).otherwise(severity.MEDIUM)
    message = F.format_string("`%s` takes %d parameters, more than %d.", "qualname", n, F.lit(t.parameters_warn))
    return _match(c.functions, n > t.parameters_warn, level=level, message=message, line=F.col("lineno"), symbol=F.col("qualname"), ordinal=F.col("ordinal"), parameters=n, warn=F.lit(t.parameters_warn), high=F.lit(t.parameters_high))


def _large_files(c: Context) -> list[Match]:
    t, n = c.thresholds, F.col("loc")
    level = severity.scaled(n, t.file_loc_warn, t.file_loc_high, t.file_loc_critical)
    message = F.format_string("%s has %d lines of code.", "rel_path", n)
    return _match(c.modules, (n >= t.file_loc_warn) & F.col("syntax_error").isNull(), level=level, message=message, line=F.lit(1), loc=n, warn=F.lit(t.file_loc_warn), high=F.lit(t.file_loc_high), critical=F.lit(t.file_loc_critical))


def god_criteria(methods: Column, length: Column, wmc: Column, t: Thresholds) -> Column:
    """The sizes of a class that are beyond their thresholds, as texts."""
    tests = (
        (methods, t.god_object_methods, "%d methods >= %d"),
        (length, t.god_object_loc, "%d lines >= %d"),
        (wmc, t.god_object_wmc, "summed complexity %d >= %d"),
    )
    said = F.array(*(F.when(v >= limit, F.format_string(text, v, F.lit(limit))) for v, limit, text in tests))
    return F.filter(said, lambda x: x.isNotNull())


def god_level(criteria: Column) -> Column:
    return F.when(F.size(criteria) > 1, severity.CRITICAL).otherwise(severity.HIGH)


def _god_objects(c: Context) -> list[Match]:
    criteria = god_criteria(F.col("public_method_count"), F.col("length"), F.col("wmc"), c.thresholds)
    message = F.format_string("Class `%s` in %s does too much: %s.", "name", "rel_path", F.array_join(criteria, "; "))
    return _match(
        c.classes, F.size(criteria) > 0, level=god_level(criteria), message=message, line=F.col("lineno"), symbol=F.col("symbol"), ordinal=F.col("ordinal"),
        methods=F.col("public_method_count"), loc=F.col("length"), wmc=F.col("wmc"), attributes=F.col("attribute_count"), criteria=criteria,
    )


def cohesion_level(lcom: Column, t: Thresholds) -> Column:
    return F.when(lcom >= t.lcom_high, severity.HIGH).otherwise(severity.MEDIUM)


def _low_cohesion(c: Context) -> list[Match]:
    n = F.col("lcom")
    message = F.format_string("The methods of class `%s` in %s fall into %d groups that share nothing.", "name", "rel_path", n)
    return _match(c.classes, n >= c.thresholds.lcom_warn, level=cohesion_level(n, c.thresholds), message=message, line=F.col("lineno"), symbol=F.col("symbol"), ordinal=F.col("ordinal"), lcom=n, methods=F.col("method_count"), attributes=F.col("attribute_count"))


def _unused_imports(c: Context) -> list[Match]:
    message = F.format_string("`%s` (`%s`) is not used in %s.", "bound", "display", "rel_path")
    return _match(c.imports, F.col("unused"), level=F.lit(severity.LOW), message=message, line=F.col("lineno"), ordinal=F.col("ordinal"), name=F.col("bound"), statement=F.col("display"))


def used_names(modules: DataFrame) -> DataFrame:
    """Distinct names that any file of a snapshot reads or exports."""
    each = modules.select("snapshot", F.explode("references").alias("name")).union(modules.select("snapshot", F.explode("exports").alias("name")))
    return each.distinct()


def _dead_functions(c: Context) -> list[Match]:
    rows = c.functions.where("is_private AND NOT is_decorated").join(used_names(c.modules), ["snapshot", "name"], "left_anti")
    kind = F.when(F.col("is_method"), "method").otherwise("function")
    message = F.format_string("Nothing refers to the private %s `%s`.", kind, "qualname")
    return _match(rows, level=F.lit(severity.LOW), message=message, line=F.col("lineno"), symbol=F.col("qualname"), ordinal=F.col("ordinal"), name=F.col("name"), kind=kind)


def _cyclic_imports(c: Context) -> list[Match]:
    cycles = graphs.cycles(graphs.cyclic_components(c.edges))
    where = c.modules.groupBy("snapshot", F.col("module_name").alias("component")).agg(F.max(F.split("rel_path", "/")).alias("at"))
    rows = cycles.join(where, ["snapshot", "component"], "left")
    guess = F.concat(F.replace("component", F.lit("."), F.lit("/")), F.lit(".py"))
    rows = rows.withColumn("rel_path", F.coalesce(F.array_join("at", "/"), guess))
    message = F.format_string("%d modules import each other: %s.", "size", F.array_join("members", " <-> "))
    level = F.when(F.col("size") >= 3, severity.HIGH).otherwise(severity.MEDIUM)
    return _match(rows, level=level, message=message, modules=F.col("members"), size=F.col("size"))


def _missing_docstrings(c: Context) -> list[Match]:
    checked = ~paths.is_test_module(F.col("rel_path")) & ~F.col("has_docstring")
    public = checked & ~F.col("name").startswith("_")
    tail = F.lit(" has no docstring.")
    same = {"level": F.lit(severity.LOW), "module": F.col("module_name")}
    return [
        *_match(c.modules, checked & F.col("syntax_error").isNull(), message=F.concat(F.format_string("Module `%s`", "rel_path"), tail), line=F.lit(1), ordinal=F.lit(-1), **same),
        *_match(c.functions, public & ~F.col("is_decorated"), message=F.concat(F.format_string("`%s`", "qualname"), tail), line=F.col("lineno"), symbol=F.col("qualname"), ordinal=F.col("ordinal"), **same),
        *_match(c.classes, public, message=F.concat(F.format_string("Class `%s`", "symbol"), tail), line=F.col("lineno"), symbol=F.col("symbol"), ordinal=F.col("ordinal"), **same),
    ]


def _signal(kind: str, level: int, text: str):
    def find(c: Context) -> list[Match]:
        message = F.format_string(f"{text}: %s in %s.", "detail", "rel_path")
        return _match(c.signals, F.col("kind") == kind, level=F.lit(level), message=message, line=F.col("lineno"), ordinal=F.col("ordinal"), kind=F.col("kind"), detail=F.col("detail"))

    return find


def _hotspots(c: Context) -> list[Match]:
    t = c.thresholds
    if c.history is None:
        return []
    empty = "path string, qualname string, commits long, authors long, lines int, last_modified string"
    churn = c.churn if c.churn is not None else c.modules.sparkSession.createDataFrame([], empty)
    functions = c.functions.withColumnRenamed("rel_path", "path")
    rows = history.hot_functions(functions, c.history, churn, t.hotspot_min_commits, t.hotspot_min_cyclomatic, t.cyclomatic_high)
    rows = rows.withColumnRenamed("path", "rel_path")
    of_function = F.col("scope") == "function"
    own = F.format_string("`%s` has complexity %d; its lines changed in %d commits by %d author(s), last on %s.", "qualname", "cyclomatic", "own_commits", "own_authors", F.coalesce(F.substring("own_modified", 1, 10), F.lit("unknown")))
    file = F.format_string("`%s` has complexity %d; its file changed %d times, %d lines in all.", "qualname", "cyclomatic", "file_commits", "file_churn")
    return _match(
        rows, level=F.col("level"), message=F.when(of_function, own).otherwise(file), line=F.col("lineno"), symbol=F.col("qualname"), ordinal=F.col("ordinal"),
        scope=F.col("scope"), cyclomatic=F.col("cyclomatic"), commits=F.when(of_function, F.col("own_commits")).otherwise(F.col("file_commits")),
        authors=F.when(of_function, F.col("own_authors")).otherwise(F.col("file_authors")),
        churn=F.when(~of_function, F.col("file_churn")), lines=F.col("own_lines"), last_modified=F.col("own_modified").cast("string"),
    )


RULES = (
    Rule("correctness/syntax-error", "Syntax error", "A file that cannot be parsed cannot run and hides everything else.", "Fix the syntax, then run the analysis again.", _syntax_errors),
    Rule("complexity/high-cyclomatic-complexity", "High cyclomatic complexity", "Every independent path needs a test.", "Move branches into functions of their own, or return early.", _measure("cyclomatic", "cyclomatic complexity", "cyclomatic_warn", ("cyclomatic_warn", "cyclomatic_high", "cyclomatic_critical"))),
    Rule("complexity/high-cognitive-complexity", "High cognitive complexity", "Nested control flow is hard to follow.", "Flatten the nesting and name the steps.", _measure("cognitive", "cognitive complexity", "cognitive_warn", ("cognitive_warn", "cognitive_high", "cognitive_critical"))),
    Rule("complexity/deep-nesting", "Deeply nested control flow", "Each level is one more condition to keep in mind.", "Use guard clauses or extract the inner blocks.", _measure("nesting", "nesting depth", "nesting_warn", ("nesting_warn", "nesting_high"), "depth")),
    Rule("maintainability/long-function", "Long function", "Long functions do several things.", "Split the function along its steps.", _measure("length", "length in lines", "function_length_warn", ("function_length_warn", "function_length_high", "function_length_critical"))),
    Rule("maintainability/too-many-parameters", "Too many parameters", "Long signatures are easy to call wrongly.", "Group parameters that travel together.", _many_parameters),
    Rule("maintainability/large-file", "Large file", "Large files collect unrelated code.", "Split the file by responsibility.", _large_files),
    Rule("design/god-object", "God object", "A class that does everything changes for every reason.", "Extract groups of methods into classes of their own.", _god_objects),
    Rule("design/low-cohesion", "Low class cohesion", "Methods that share nothing need not share a class.", "Split the class along its groups of methods.", _low_cohesion),
    Rule("dead-code/unused-import", "Unused import", "Unused imports cost time and mislead readers.", "Remove the import, or export the name.", _unused_imports),
    Rule("dead-code/unused-private-function", "Unused private function", "Private code without a user is dead.", "Delete it, or use it.", _dead_functions),
    Rule("dependencies/cyclic-import", "Cyclic import dependency", "Modules of a cycle can only be understood together.", "Move what they share into a module that imports neither.", _cyclic_imports),
    Rule("documentation/missing-docstring", "Missing docstring", "Public names without a docstring leave their users guessing.", "Say what it does, takes and returns.", _missing_docstrings),
    Rule("security/dynamic-execution", "Dynamic code execution", "Text that is executed can be anything.", "Parse the input instead of executing it.", _signal("dynamic-execution", severity.HIGH, "Text is executed as code")),
    Rule("security/shell-execution", "Shell command execution", "A shell interprets every character of its input.", "Pass a list of arguments without a shell.", _signal("shell-execution", severity.HIGH, "A command goes through a shell")),
    Rule("security/unsafe-deserialization", "Unsafe deserialization", "Some formats run code while they are read.", "Use a format that holds data only.", _signal("unsafe-deserialization", severity.HIGH, "Data is read in an unsafe way")),
    Rule("security/weak-hash", "Weak hash algorithm", "Collisions of these algorithms are cheap.", "Use SHA-256, or mark the use as not security relevant.", _signal("weak-hash", severity.MEDIUM, "A broken hash is used")),
    Rule("security/insecure-temp-file", "Insecure temporary file", "The name can be taken before the file is made.", "Let the library create and open the file.", _signal("insecure-temp-file", severity.MEDIUM, "A temporary file name is guessed")),
    Rule("security/hardcoded-secret", "Hardcoded secret", "Secrets in sources leak with them.", "Read it from the environment or a store.", _signal("hardcoded-secret", severity.HIGH, "A secret seems to be in the source")),
    Rule("history/complexity-hotspot", "Complexity hotspot", "Complex code that changes often is where defects gather.", "Simplify this function before others.", _hotspots),
)


def _planned(matches: list[Match]) -> DataFrame:
    """All matches on one relation, in one pass; raises if one of them does not resolve."""
    relation = matches[0].relation
    hits = F.filter(F.array(*(F.when(m.where, m.said) for m in matches)), lambda x: x.isNotNull())
    return relation.select("snapshot", F.col("rel_path").alias("path"), F.inline(hits).alias("rule_ordinal", "said")).select("snapshot", "path", "rule_ordinal", "said.*")


def run(context: Context, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, list[str]]:
    """All findings (unordered), and a warning per rule that could not be planned."""
    warnings: list[str] = []
    by_relation: dict[int, list[Match]] = {}

    def failed(k: int, error: Exception) -> None:
        warnings.append(f"rule {rules[k].id} failed: {error}")

    for k, rule in enumerate(rules):
        try:
            for m in rule.find(context):
                numbered = F.struct(F.lit(k).alias("rule_ordinal"), m.said.alias("said"))
                by_relation.setdefault(id(m.relation), []).append(Match(m.relation, m.where, numbered, k))
        except Exception as error:
            failed(k, error)
    found = context.modules.sparkSession.createDataFrame([], SCHEMA).drop("rule_id", "title", "category", "suggestion")
    for matches in by_relation.values():
        try:
            rows = _planned(matches)
        except Exception:  # one of them: the others are planned without it
            kept = []
            for m in matches:
                try:
                    _planned([m])
                    kept.append(m)
                except Exception as error:
                    failed(m.rule, error)
            if not kept:
                continue
            rows = _planned(kept)
        found = found.unionByName(rows)
    named = {n: F.get(F.array(*(F.lit(getattr(r, a)) for r in rules)), F.col("rule_ordinal")) for n, a in (("rule_id", "id"), ("title", "title"), ("category", "category"), ("suggestion", "suggestion"))}
    return found.withColumns(named), warnings


def only(rule_id: str, context: Context) -> DataFrame:
    """Findings of one rule; errors are raised."""
    (rule,) = (r for r in RULES if r.id == rule_id)
    found, warnings = run(context, (rule,))
    if warnings:
        raise ValueError(warnings[0])
    return found
