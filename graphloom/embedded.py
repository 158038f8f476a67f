"""A small project with known flaws, for demonstrations and checks of the parse stage.

The expected values below are worked out by hand from the rules of the metrics, not taken from the engine's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "shop/__init__.py": '"""Shop."""\nfrom .cart import Cart\n__all__ = ["Cart"]\n',
    "shop/cart.py": '''"""Carts."""
import json
import os.path
from . import price
from .price import total as sum_up


class Cart:
    """Items."""

    def __init__(self):
        self.items = []

    def add(self, item):
        """Add."""
        self.items.append(item)
        self.check()

    def check(self):
        """Check."""
        return sum_up(self.items)

    def name(self):
        return json.dumps("cart")
''',
    "shop/price.py": '''"""Prices."""
from shop import cart


def total(items, *, tax=0, **more):
    """Total."""
    amount = 0
    for item in items:
        if item and tax:
            amount += item
        elif item:
            amount -= 1
        else:
            amount = helper(amount) if tax else 0
    return amount


def helper(x):
    """Help."""
    while x:
        try:
            x -= 1
        except ValueError:
            return total([y for y in [x] if y])
    return x


def _unused():
    return 1
''',
    "shop/run.py": '''"""Run."""
import hashlib
import pickle
import subprocess as sp

api_token = "9f8e7d6c5b4a"


def go(command, data):
    """Go."""
    sp.run(command, shell=True)
    match data:
        case 1:
            return eval("1")
        case _:
            return pickle.loads(data), hashlib.md5(data)
''',
    "shop/broken.py": "def f(:\n    pass\n",
    "tests/test_shop.py": "def test_nothing():\n    assert True\n",
}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v.encode()) for k, v in SOURCES.items()], "rel_path string, content binary")


def _values(rows: list[tuple], names: str) -> str:
    def shown(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v + "'"

    body = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({names})"


#: qualname, lineno, length, parameters, cyclomatic, cognitive, nesting, has_docstring
FUNCTIONS_SQL = _values(
    [
        ("shop.cart.Cart.__init__", 11, 2, 0, 1, 0, 0, False),
        ("shop.cart.Cart.add", 14, 4, 1, 1, 0, 0, True),
        ("shop.cart.Cart.check", 19, 3, 0, 1, 0, 0, True),
        ("shop.cart.Cart.name", 23, 2, 0, 1, 0, 0, False),
        # for, if, and, elif, conditional: 1 + 5 paths. for 1, if 2, and 1, elif 2, else 1, conditional 2 (else stays at
        # its own level, one below the loop)
        ("shop.price.total", 5, 11, 3, 6, 9, 2, True),
        # while, handler, filter of the comprehension: while 1, handler 2, filter 1
        ("shop.price.helper", 18, 8, 1, 4, 4, 2, True),
        ("shop.price._unused", 28, 2, 0, 1, 0, 0, False),
        ("shop.run.go", 9, 8, 2, 3, 1, 1, True),
        ("tests.test_shop.test_nothing", 1, 2, 0, 2, 0, 0, False),
    ],
    "qualname, lineno, length, parameters, cyclomatic, cognitive, nesting, has_docstring",
)

#: rule_id, path, line, symbol, severity
FINDINGS_SQL = _values(
    [
        ("correctness/syntax-error", "shop/broken.py", 1, None, 3),
        ("dead-code/unused-import", "shop/cart.py", 3, None, 1),
        ("dead-code/unused-import", "shop/cart.py", 4, None, 1),
        ("dead-code/unused-import", "shop/price.py", 2, None, 1),
        ("dead-code/unused-private-function", "shop/price.py", 28, "shop.price._unused", 1),
        ("dependencies/cyclic-import", "shop/__init__.py", None, None, 3),
        ("documentation/missing-docstring", "shop/cart.py", 23, "shop.cart.Cart.name", 1),
        ("security/dynamic-execution", "shop/run.py", 14, None, 3),
        ("security/shell-execution", "shop/run.py", 11, None, 3),
        ("security/unsafe-deserialization", "shop/run.py", 16, None, 3),
        ("security/weak-hash", "shop/run.py", 16, None, 2),
        ("security/hardcoded-secret", "shop/run.py", 6, None, 3),
    ],
    "rule_id, path, line, symbol, severity",
)

CALLS_SQL = _values(
    [
        ("shop.cart.Cart.add", "shop.cart.Cart.check"),
        ("shop.cart.Cart.check", "shop.price.total"),
        ("shop.price.total", "shop.price.helper"),
        ("shop.price.helper", "shop.price.total"),
    ],
    "caller, callee",
)
