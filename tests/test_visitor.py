"""Metrics of single functions, classes and files; expected values follow from the definitions."""

import ast
from textwrap import dedent

import pytest

from graphloom.operators import visitor as v


def function(source):
    return ast.parse(dedent(source)).body[0]


@pytest.mark.parametrize(
    "source, cyclomatic, cognitive, depth",
    [
        ("def f():\n    return 1", 1, 0, 0),
        ("def f(a):\n    if a:\n        return 1\n    else:\n        return 2", 2, 2, 1),
        ("def f(a, b):\n    return 1 if a and b else 2", 3, 2, 0),
        ("def f(a):\n    def g():\n        if a:\n            return 1\n    return g", 1, 0, 0),
        ("def f(a):\n    if a:\n        if a:\n            if a:\n                return 1", 4, 6, 3),
        ("def f(a):\n    if a:\n        return 1\n    elif not a:\n        if a is None:\n            return 2", 4, 4, 2),
        ("def f(a):\n    return [x for x in a if x]", 2, 1, 0),
        ("def f(a):\n    try:\n        return 1\n    except ValueError:\n        return 2", 2, 1, 1),
        ("def f(a):\n    match a:\n        case 1:\n            return 1\n        case _:\n            return 2", 3, 1, 1),
        ("def f(a):\n    for x in a:\n        pass\n    else:\n        if a:\n            pass", 3, 3, 2),
        ("def f(a):\n    with a:\n        while a:\n            assert a", 4, 1, 2),
        ("def f(a):\n    try:\n        pass\n    except* ValueError:\n        pass", 2, 1, 0),
        ("async def f(a):\n    async for x in a:\n        async with x:\n            pass", 3, 1, 2),
        ("def f(a=lambda: 1 if 2 else 3):\n    return a", 1, 0, 0),
        ("@d(1 if 2 else 3)\ndef f():\n    pass", 2, 1, 0),
        ("def f(a):\n    for x in (y if a else z):\n        pass", 3, 1, 1),
        ("def f(a):\n    try:\n        pass\n    finally:\n        if a:\n            pass", 2, 1, 2),
    ],
)
def test_complexity(source, cyclomatic, cognitive, depth):
    f = function(source)
    assert (v.cyclomatic(f), v.cognitive(f), v.nesting(f)) == (cyclomatic, cognitive, depth)


@pytest.mark.parametrize(
    "source, groups",
    [
        ("class A:\n    def __init__(self):\n        self.x = 1\n    def a(self):\n        return self.x\n    def b(self):\n        self.x = 2", 1),
        ("class A:\n    def a(self):\n        return self.x\n    def b(self):\n        return self.y\n    def c(self):\n        return self.z", 3),
        ("class A:\n    def run(self):\n        self.step()\n    def step(self):\n        return 1\n    def helper(self):\n        return 2", 2),
        ("class A:\n    def a(self):\n        ...\n    def b(self):\n        raise NotImplementedError", 0),
        ("class A:\n    @property\n    def a(self):\n        return self.x\n    @a.setter\n    def a(self, v):\n        self.y = v\n    def b(self):\n        return self.y", 1),
    ],
)
def test_cohesion(source, groups):
    assert v.class_row(function(source), "m")["lcom"] == groups


def test_function_row():
    f = function('''
    class C(Base):
        limit: int = 3
        @staticmethod
        def s(a, /, b, *c, d, **e):
            """Text."""
            Service().run(a.b.c(), (x or y).z(), t[0]())
        @cached.property
        def p(self, q=call()):
            self.k = self.n.m()
            def inner():
                other()
    ''')
    row = v.class_row(f, "pkg.mod")
    s, p = row["methods"]
    assert (s["parameters"], p["parameters"], s["has_docstring"], p["has_docstring"]) == (5, 1, True, False)
    assert s["calls"] == ["Service", "Service.run", "a.b.c"] and p["calls"] == ["call", "self.n.m"]
    assert (s["decorators"], p["decorators"]) == (["staticmethod"], ["property"])
    assert (p["attributes"], p["qualname"], s["length"]) == (["k", "n"], "pkg.mod.C.p", 3)
    assert (row["attribute_count"], row["base_count"]) == (2, 1)


@pytest.mark.parametrize(
    "source, kinds",
    [
        ("import subprocess as s\nfrom os import system\nfrom hashlib import md5\ns.run('x', shell=True)\nsystem('x')\nmd5(b'')", ["shell-execution", "shell-execution", "weak-hash"]),
        ("import yaml, hashlib\ntoken = 'your_token_here'\npassword = 'short'\nhashlib.md5(b'', usedforsecurity=False)\nyaml.load(f, Loader=yaml.SafeLoader)\nyaml.load(f, Loader=CSafeLoader)", []),
        ("import yaml\nyaml.load(f)\nyaml.load(f, Loader=yaml.Loader)", ["unsafe-deserialization"] * 2),
        ("import hashlib\nhashlib.new('MD5', b'')\nhashlib.new('sha256')", ["weak-hash"]),
        ("anything(shell=True)\nanything(shell=1)", ["shell-execution"]),
        ("import pickle, tempfile\ndef f():\n    pickle.loads(x)\n    return tempfile.mktemp(), eval('1')", ["unsafe-deserialization", "dynamic-execution", "insecure-temp-file"]),
        ("API_KEY: str = 'a1b2c3d4e5'\nself.password = 'a1b2c3d4e5'\nx = api_key2 = 'a1b2c3d4e5'", ["hardcoded-secret"] * 2),
        ("def f():\n    import pickle as p\n    p.load(x)", ["unsafe-deserialization"]),
    ],
)
def test_signals(source, kinds):
    rows = v.Signals(v.walk(ast.parse(source))).rows
    assert [r["kind"] for r in rows] == kinds and not any("a1b2" in r["detail"] for r in rows)


def test_module_row():
    row = v.module_row('"""Doc."""\n# no\n__all__ = ["a", b, 1]\n\nx = """\ntwo\n"""\nif x:\n    import hidden\nfrom . import (y,\n  z)\nget("name", "no name")\n'.encode(), "m")
    assert (row["loc"], row["total_lines"], row["has_docstring"], row["exports"]) == (8, 12, True, ["a"])
    assert [i["name"] for i in row["imports"]] == ["y", "z"] and {"x", "b", "get", "name", "a"} == set(row["references"])


@pytest.mark.parametrize("content", [b"def f(:\n", b"\xff\xfe\x00", b"# coding: nonsense\n", b"x = '\x00'\n", b"(" * 5000])
def test_broken_files_are_rows(content):
    row = v.module_row(content, "m")
    assert row["syntax_error"] and row["loc"] == 0 and row["functions"] == []


def test_decoding():
    assert v.module_row("# coding: latin-1\nx = 'é'\r\ny = 2\r".encode("latin-1"), "m")["lines"] == ["# coding: latin-1", "x = 'é'", "y = 2"]
    assert v.module_row(b"\xef\xbb\xbfx = 1\n", "m")["syntax_error"] is None and v.module_row(b"", "m")["loc"] == 0
