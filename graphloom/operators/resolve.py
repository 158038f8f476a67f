"""Resolution of dotted names: imports to modules, calls to functions, by longest known prefix.

A name is turned into its prefixes (as many as it has parts), these are joined with the known names, and the best match of
a row is kept by an aggregate that combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import parse


def prefixes(name: Column) -> Column:
    """A dotted name and all its leading parts, the longest first; an empty name has none."""
    parts = F.split(name, r"\.", -1)
    every = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(every)


def longest_prefix(rows: DataFrame, keys: list[str], candidates: str, names: DataFrame, by: list[str]) -> DataFrame:
    """``keys`` and ``target`` of each row: the first candidate's longest prefix that is among ``names`` (by, name), else
    the next candidate's; null if there is none. ``keys`` tell rows apart and contain ``by``."""
    tried = rows.select(*keys, F.posexplode_outer(candidates).alias("c", "candidate"))
    tried = tried.select(*keys, "c", F.posexplode_outer(prefixes(F.col("candidate"))).alias("p", "name"))
    known = names.select(*by, "name").distinct().withColumn("known", F.lit(True))
    found = tried.join(known, [*by, "name"], "left")
    return found.groupBy(*keys).agg(F.min_by(F.when(F.col("known"), F.col("name")), F.when(F.col("known"), F.struct("c", "p"))).alias("target"))


def package_of(name: Column, is_package: Column) -> Column:
    parent = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))
    return F.when(is_package, name).when(parent.isNull(), "").otherwise(F.expr("substring(module_name, 1, length(module_name) - length(substring_index(module_name, '.', -1)) - 1)"))


def _base(level: Column) -> Column:
    """The package that a relative import with so many dots starts from; empty above the top."""
    parts = F.filter(F.split(package_of(F.col("module_name"), F.col("is_package")), r"\."), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.greatest(level - 1, F.lit(0)), F.lit(0))), ".")


def import_candidates(imports: DataFrame) -> DataFrame:
    """Adds ``candidates``: modules that an import may mean, the likeliest first."""
    joined = lambda *x: F.concat_ws(".", *(F.nullif(c, F.lit("")) for c in x))
    base, module, name = F.col("base"), F.col("module"), F.col("name")
    relative = (
        F.when(module != "", F.array(joined(base, module)))
        .when((base != "") & name.isNotNull(), F.array(joined(base, name), base))
        .when(base != "", F.array(base))
        .otherwise(F.filter(F.array(name), lambda x: x.isNotNull()))
    )
    absolute = F.array(module)
    return imports.withColumn("base", _base(F.col("level"))).withColumn("candidates", F.when(F.col("level") > 0, relative).otherwise(absolute))


def import_graph(modules: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges: snapshot, src, dst, distinct and without loops; externals: snapshot, package, n, one count per import).

    ``names`` (snapshot, name) of all modules saves a second parse where ``modules`` is not kept."""
    if names is None:
        names = modules.select("snapshot", F.col("module_name").alias("name"))
    rows = import_candidates(parse.imports(modules))
    keys = ["snapshot", "rel_path", "module_name", "ordinal", "first"]
    rows = rows.withColumn("first", F.get("candidates", F.lit(0)))
    found = longest_prefix(rows, keys, "candidates", names, ["snapshot"])
    edges = found.where("target <> module_name").select("snapshot", F.col("module_name").alias("src"), F.col("target").alias("dst")).distinct()
    root = F.split_part(F.col("first"), F.lit("."), F.lit(1))
    package = F.coalesce(F.nullif(root, F.lit("")), F.col("first"))
    return edges, found.where("target IS NULL").groupBy("snapshot", package.alias("package")).agg(F.count(F.lit(1)).alias("n"))


def _last_modules(modules: DataFrame) -> DataFrame:
    """Of modules with one name the last in path order: the one that a table by name would keep."""
    last = modules.groupBy("snapshot", "module_name").agg(F.max(F.split("rel_path", "/")).alias("at"))
    return modules.join(last.withColumn("rel_path", F.array_join("at", "/")).drop("at"), ["snapshot", "module_name", "rel_path"], "left_semi")


def resolve_calls(calls: DataFrame, local: DataFrame, methods: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """Callee of each call, the first that applies: a function of the module by its whole name; without a dot, what an
    import binds; ``self`` and ``cls`` in a class, its method or nothing; a class of the module, its method or nothing;
    what an import binds, followed by the rest.

    calls: snapshot, module_name, class_name, caller, call. local: snapshot, module_name, call, local. methods: snapshot,
    module_name, class_name, method, callee. aliases: snapshot, module_name, alias, meaning. names: snapshot, name.
    Returns distinct snapshot, caller, callee without self calls.
    """
    head, tail = F.substring_index("call", ".", 1), F.expr("substring(call, instr(call, '.') + 1)")
    rows = calls.distinct().withColumn("dots", F.instr("call", ".") > 0).withColumn("head", head).withColumn("tail", F.when(F.col("dots"), tail))
    rows = rows.join(local, ["snapshot", "module_name", "call"], "left")
    own = F.col("head").isin("self", "cls") & F.col("class_name").isNotNull()
    rows = rows.withColumn("owner", F.when(F.col("dots"), F.when(own, F.col("class_name")).otherwise(F.col("head"))))
    owners = methods.select("snapshot", "module_name", F.col("class_name").alias("owner")).distinct().withColumn("is_class", F.lit(True))
    rows = rows.join(owners, ["snapshot", "module_name", "owner"], "left")
    of_class = methods.where("method IS NOT NULL").select("snapshot", "module_name", F.col("class_name").alias("owner"), F.col("method").alias("tail"), F.col("callee").alias("of_class"))
    rows = rows.join(of_class, ["snapshot", "module_name", "owner", "tail"], "left")
    rows = rows.join(aliases.withColumnRenamed("alias", "head"), ["snapshot", "module_name", "head"], "left")
    through = F.when(~F.col("dots"), F.col("meaning")).when(~own & F.col("is_class").isNull() & F.col("meaning").isNotNull(), F.concat_ws(".", "meaning", "tail"))
    rows = rows.withColumn("through", F.when(F.col("local").isNull(), through))
    direct = rows.select("snapshot", "caller", F.coalesce("local", F.when(F.col("dots"), F.col("of_class"))).alias("callee"))
    asked = rows.where("through IS NOT NULL").select("snapshot", "caller", "through").distinct()
    linked = longest_prefix(asked.withColumn("c", F.array("through")), ["snapshot", "caller", "through"], "c", names, ["snapshot"])
    every = direct.unionByName(linked.select("snapshot", "caller", F.col("target").alias("callee")))
    return every.where("callee IS NOT NULL AND callee <> caller").distinct()


def call_graph(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: snapshot, name; edges: snapshot, caller, callee) of all functions."""
    functions = parse.functions(modules)
    names = functions.select("snapshot", F.col("qualname").alias("name")).distinct()
    last = _last_modules(modules)
    local = parse.functions(last).where("class_name IS NULL").groupBy("snapshot", "module_name", F.col("name").alias("call")).agg(F.max_by("qualname", "ordinal").alias("local"))
    each = last.select("snapshot", "module_name", F.posexplode("classes").alias("ordinal", "c"))
    each = each.groupBy("snapshot", "module_name", F.col("c.name").alias("class_name")).agg(F.max_by("c.methods", "ordinal").alias("m"))
    methods = each.select("snapshot", "module_name", "class_name", F.posexplode_outer("m").alias("at", "m"))
    methods = methods.groupBy("snapshot", "module_name", "class_name", F.col("m.name").alias("method")).agg(F.max_by("m.qualname", "at").alias("callee"))
    bound = parse.imports(last).where("bound IS NOT NULL").withColumn("base", _base(F.col("level")))
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    meaning = F.when(F.col("is_from"), F.concat_ws(".", F.when(F.col("level") > 0, part("base")), part("module"), part("name"))).otherwise(F.col("module"))
    aliases = bound.withColumn("meaning", meaning).groupBy("snapshot", "module_name", F.col("bound").alias("alias")).agg(F.max_by("meaning", "ordinal").alias("meaning"))
    calls = functions.select("snapshot", "module_name", "class_name", F.col("qualname").alias("caller"), F.explode("calls").alias("call"))
    return names, resolve_calls(calls, local, methods, aliases, names)
