"""What the parse stage does with many files: all cores at work, and a text that stands in many files parsed once."""

import ast
import io
import tokenize

import pytest

from graphloom.operators import parse
from graphloom.operators import visitor as v
from graphloom.plans import catalogue, generated

SHARED = (
    "import os\nfrom . import a\n\ndef f(x):\n    return g(x)\n\nclass K(B):\n    def m(self):\n        return self.q\n    def n(self):\n        return self.m()\n\nclass L:\n    pass\n",
    "", "def (", "x = eval('1')\n", None,
)


def test_repeated_texts_give_the_same_rows(spark):
    files = [("s1", f"src/p{k}/{name}", None if text is None else text.encode(), None) for k in range(3) for name in ("__init__.py", "a.py", "b.py") for text in SHARED[k : k + 3]]
    files += [("s2", "__init__.py", b"\xff", None), ("s2", "c.py", b"x", "gone"), ("s2", "d.py", b"y", "gone"), ("s2", "e.py", None, "gone too"), ("s2", "f.py", "é = 1".encode(), None)]
    rows = spark.createDataFrame(files, "snapshot string, rel_path string, content binary, read_error string")
    for root in ("root", ""):
        plain, once = parse.parse_sources(rows, root), parse.parse_sources(rows, root, repeated=True)
        assert plain.columns == once.columns
        assert sorted(map(repr, once.collect())) == sorted(map(repr, plain.collect())) and once.count() == len(files)
    assert sorted(map(tuple, parse.module_names(rows).collect())) == sorted(map(tuple, parse.parse_sources(rows).select("snapshot", "module_name").collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["parsed_functions", "code_chunks", "rule_syntax_error", "security_rules", "parsed_classes", "lcom_components", "rule_low_cohesion"])
def test_repeated_texts_are_parsed_once(spark, sf_dir, name):
    plan = plan_of(catalogue.QUERIES[name](spark, sf_dir))
    below = plan[plan.index("MapInArrow") :]
    assert plan.count("MapInArrow") == 1 and "REPARTITION_BY_NUM" in below and "HashAggregate(keys=[content" in below


@pytest.mark.parametrize("name, parses", [("import_edges", 1), ("import_packages", 1), ("rule_unused_import", 1), ("call_edges", 0)])
def test_imports_are_parsed_once_by_all_cores(spark, sf_dir, name, parses):
    """The call graph reads rows that were kept."""
    plan = plan_of(catalogue.QUERIES[name](spark, sf_dir))
    assert plan.count("MapInArrow") == parses and (not parses or "REPARTITION_BY_NUM" in plan[plan.index("MapInArrow") :])
    assert generated._files(spark, sf_dir, "'x'").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


SOURCES = ["x = 1\n\n# c\n  # d\ny = [\n\n 1,  # e\n]\n", "x = f'{\n  1 # c\n  + 2\n}'\n", "\x0c\nx = 1;\n", "x = 'a\\\nb'\n", 'x = """\na\n"""\n', "x = 1 \\\n\n", "# '''\nx\n", ""]


@pytest.mark.parametrize("source", SOURCES)
def test_code_lines(source):
    """Counting lines and reading tokens agree."""
    assert v.code_lines(source) == len({t.start[0] for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in v._NOT_CODE})


def test_nodes_are_listed_once():
    tree = ast.parse("def f(a, *, b=1):\n    match a:\n        case {'k': x, **y}:\n            global z\n    return {**a, 'b': lambda: a}\n")
    every = {id(n) for n in ast.walk(tree) if not isinstance(n, (ast.expr_context, ast.operator))}
    assert {id(n) for n in v.walk(tree)} == every and v.children(tree) is v.children(tree)
