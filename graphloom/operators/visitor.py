"""Metrics of one Python file from its syntax tree: plain Python, run inside the parse stage.

Every function of the file is measured without what is nested in it: inner functions, classes and lambdas count for
nothing in the function around them.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Iterable

Function = ast.FunctionDef | ast.AsyncFunctionDef
_INNER = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
_NOT_CODE = {
    tokenize.COMMENT,
    tokenize.NL,
    tokenize.NEWLINE,
    tokenize.INDENT,
    tokenize.DEDENT,
    tokenize.ENDMARKER,
}

# Fixed values of the security signals.
DYNAMIC_CALLS = ("eval", "exec")
SHELL_CALLS = ("os.system", "os.popen")
UNSAFE_LOADERS = ("pickle", "cPickle", "marshal", "dill")
WEAK_HASHES = ("md5", "sha1")
SECRET_PARTS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential")
PLACEHOLDERS = (
    "example", "placeholder", "changeme", "change_me", "dummy", "fake", "sample",
    "xxxx", "your_", "todo", "<", "${", "{{", "test",
)
SECRET_LENGTH = 8


def dotted(node: ast.AST) -> str | None:
    """Name of a call target; a call inside it stands for what it constructs. None for other expressions."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=ast.Call(func=base), attr=attr) | ast.Attribute(value=base, attr=attr):
            inner = dotted(base)
            return inner and f"{inner}.{attr}"
        case ast.Call(func=func):
            return dotted(func)
    return None


#: Fields without a node that any metric looks at: operators, contexts and plain values.
_LEAVES = {"ctx", "op", "ops", "id", "attr", "asname", "module", "level", "type_comment", "kind", "simple", "conversion", "is_async"}
_fields: dict[type, tuple[str, ...]] = {}


def _node_fields(cls: type) -> tuple[str, ...]:
    """Fields of a kind of node that can hold nodes."""
    kinds = getattr(cls, "_field_types", {})  # from Python 3.13 on
    plain = (str, int, object, str | None, int | None, list[str])
    return tuple(f for f in cls._fields if f not in _LEAVES and kinds.get(f) not in plain)


def children(node: ast.AST) -> list[ast.AST]:
    """``ast.iter_child_nodes`` without ``_LEAVES``, which are half of all nodes. A node keeps them: each measure asks again."""
    try:
        return node._below
    except AttributeError:
        pass
    cls, out = node.__class__, []
    names = _fields.get(cls)
    if names is None:
        _fields[cls] = names = _node_fields(cls)
    for name in names:
        value = getattr(node, name, None)
        if value.__class__ is list:
            out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    node._below = out
    return out


def walk(node: ast.AST) -> list[ast.AST]:
    """The node and all below it, level by level."""
    nodes = [node]
    for n in nodes:
        nodes += children(n)
    return nodes


def own_nodes(function: ast.AST) -> list[ast.AST]:
    """What belongs to a function itself, its decorators and defaults included."""
    nodes = [n for n in children(function) if not isinstance(n, _INNER)]
    for node in nodes:
        nodes += [n for n in children(node) if not isinstance(n, _INNER)]
    return nodes


def cyclomatic(function: ast.AST, own: list[ast.AST] | None = None) -> int:
    """Independent paths."""
    paths = 1
    for node in own_nodes(function) if own is None else own:
        match node:
            case ast.BoolOp(values=operands):
                paths += len(operands) - 1
            case ast.comprehension(ifs=conditions):
                paths += len(conditions)
            case ast.Match(cases=cases):
                paths += len(cases)
            case ast.If() | ast.IfExp() | ast.For() | ast.AsyncFor() | ast.While() | ast.ExceptHandler() | ast.With() | ast.AsyncWith() | ast.Assert():
                paths += 1
    return paths


def _is_elif(branch: list[ast.stmt]) -> bool:
    return len(branch) == 1 and isinstance(branch[0], ast.If)


def _effort(node: ast.AST, depth: int) -> tuple[int, list[tuple[Iterable[ast.AST], int]]]:
    """Points of a node at a nesting depth, and the groups of nodes to go on with, each with its depth."""
    match node:
        case ast.For() | ast.AsyncFor() | ast.While():
            return 1 + depth + bool(node.orelse), [(node.body, depth + 1), (node.orelse, depth)]
        case ast.If():
            alternative = bool(node.orelse) and not _is_elif(node.orelse)
            return 1 + depth + alternative, [([node.test], depth), (node.body, depth + 1), (node.orelse, depth)]
        case ast.ExceptHandler():
            return 1 + depth, [(node.body, depth + 1)]
        case ast.Match():
            return 1 + depth, [(node.cases, depth + 1)]
        case ast.IfExp():
            return 1 + depth, [(children(node), depth)]
        case ast.BoolOp():
            return len(node.values) - 1, [(children(node), depth)]
        case ast.comprehension():
            return len(node.ifs), [([node.iter, *node.ifs], depth)]
    return 0, [(children(node), depth)]


def cognitive(function: ast.AST) -> int:
    """Effort to follow the control flow: structures cost more the deeper they stand."""
    total, todo = 0, [(children(function), 0)]
    while todo:
        nodes, depth = todo.pop()
        for node in nodes:
            if not isinstance(node, _INNER):
                points, more = _effort(node, depth)
                total += points
                todo.extend(more)
    return total


def _inside(node: ast.AST) -> list[tuple[list, int]]:
    """Statements that a statement holds, with what their depth grows by."""
    match node:
        case ast.If() if _is_elif(node.orelse):
            return [(node.body, 1), (node.orelse, 0)]
        case ast.If() | ast.For() | ast.AsyncFor() | ast.While():
            return [(node.body, 1), (node.orelse, 1)]
        case ast.With() | ast.AsyncWith():
            return [(node.body, 1)]
        case ast.Try():
            return [(part, 1) for part in (node.body, node.orelse, node.finalbody, *(h.body for h in node.handlers))]
        case ast.Match():
            return [(case.body, 1) for case in node.cases]
    body = getattr(node, "body", ())
    return [(body, 0)] if isinstance(body, list) else []


def nesting(function: Function) -> int:
    """Deepest level of nested control structures."""
    deepest, todo = 0, [(function.body, 0)]
    while todo:
        statements, depth = todo.pop()
        deepest = max(deepest, depth)
        for statement in statements:
            if not isinstance(statement, _INNER):
                todo.extend((inner, depth + more) for inner, more in _inside(statement))
    return deepest


def _of_self(node: ast.AST) -> str | None:
    match node:
        case ast.Attribute(value=ast.Name(id="self"), attr=name):
            return name
    return None


def _targets(node: ast.AST) -> list[ast.expr]:
    match node:
        case ast.Assign(targets=targets):
            return targets
        case ast.AnnAssign(target=target):
            return [target]
    return []


def _is_stub(function: Function) -> bool:
    for statement in function.body:
        match statement:
            case ast.Pass() | ast.Raise() | ast.Expr(value=ast.Constant()):
                continue
        return False
    return True


def _decorator(node: ast.expr) -> str:
    match node.func if isinstance(node, ast.Call) else node:
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return name
        case other:
            return ast.unparse(other)


def function_row(node: Function, module: str, owner: str | None) -> dict:
    decorators = [_decorator(d) for d in node.decorator_list]
    a = node.args
    positional = len(a.posonlyargs) + len(a.args)
    if owner is not None and "staticmethod" not in decorators:
        positional = max(0, positional - 1)  # the receiver
    end, own = node.end_lineno or node.lineno, own_nodes(node)
    return {
        "name": node.name,
        "qualname": ".".join(filter(None, (module, owner, node.name))),
        "lineno": node.lineno,
        "end_lineno": end,
        "length": end - node.lineno + 1,
        "parameters": positional + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None),
        "cyclomatic": cyclomatic(node, own),
        "cognitive": cognitive(node),
        "nesting": nesting(node),
        "class_name": owner,
        "decorators": decorators,
        "calls": sorted({name for n in own if isinstance(n, ast.Call) and (name := dotted(n.func))}),
        "attributes": sorted({name for n in walk(node) if isinstance(n, ast.Attribute) and (name := _of_self(n))}),
        "is_stub": _is_stub(node),
        "has_docstring": ast.get_docstring(node) is not None,
    }


def cohesion_groups(methods: list[dict]) -> int:
    """Groups of methods that share no attribute and do not call each other; special and empty methods stay out.

    Methods of one qualified name are one. Linear: each attribute links its users in a chain.
    """
    parts = [m for m in methods if not m["name"].startswith("__") and not m["is_stub"]]
    leader = {m["qualname"]: m["qualname"] for m in parts}

    def lead(name: str) -> str:
        while leader[name] != name:
            leader[name] = name = leader[leader[name]]
        return name

    user: dict[str, str] = {}
    by_name = {m["name"]: m["qualname"] for m in parts}
    for m in parts:
        for attribute in m["attributes"]:
            leader[lead(user.setdefault(attribute, m["qualname"]))] = lead(m["qualname"])
        for call in m["calls"]:
            if call.startswith("self.") and (other := by_name.get(call[5:])):
                leader[lead(other)] = lead(m["qualname"])
    return sum(lead(name) == name for name in leader)


def class_row(node: ast.ClassDef, module: str) -> dict:
    methods, attributes = [], set()
    for child in node.body:
        if isinstance(child, Function):
            methods.append(function_row(child, module, node.name))
            attributes.update(name for n in walk(child) for t in _targets(n) if (name := _of_self(t)))
        else:
            attributes.update(t.id for t in _targets(child) if isinstance(t, ast.Name))
    end = node.end_lineno or node.lineno
    return {
        "name": node.name,
        "lineno": node.lineno,
        "end_lineno": end,
        "length": end - node.lineno + 1,
        "methods": methods,
        "attribute_count": len(attributes),
        "base_count": len(node.bases),
        "lcom": cohesion_groups(methods),
        "has_docstring": ast.get_docstring(node) is not None,
    }


def import_rows(node: ast.Import | ast.ImportFrom) -> list[dict]:
    is_from = isinstance(node, ast.ImportFrom)
    return [
        {
            "module": (node.module or "") if is_from else alias.name,
            "name": alias.name if is_from else None,
            "alias": alias.asname,
            "lineno": node.lineno,
            "is_from": is_from,
            "level": node.level if is_from else 0,
        }
        for alias in node.names
    ]


def references(nodes: list[ast.AST]) -> set[str]:
    """Names that count as used: those read, all attributes, and texts that could be names."""
    found = set()
    for node in nodes:
        match node:
            case ast.Name(id=name, ctx=ast.Load()) | ast.Attribute(attr=name):
                found.add(name)
            case ast.Constant(value=str(text)) if text.isidentifier():
                found.add(text)
    return found


def exports(statement: ast.stmt) -> set[str]:
    """Entries of an ``__all__`` that is assigned a literal."""
    if any(isinstance(t, ast.Name) and t.id == "__all__" for t in _targets(statement)):
        match statement.value:
            case ast.List(elts=entries) | ast.Tuple(elts=entries) | ast.Set(elts=entries):
                return {e.value for e in entries if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return set()


class Signals:
    """Security signals of a file; imports anywhere in it name what a call means."""

    def __init__(self, nodes: list[ast.AST]):
        self.aliases: dict[str, str] = {}
        for node in nodes:
            match node:
                case ast.Import(names=names):
                    self.aliases |= {a.asname: a.name for a in names if a.asname}
                case ast.ImportFrom(module=str(module), names=names):
                    self.aliases |= {a.asname or a.name: f"{module}.{a.name}" for a in names}
        found = []
        for node in nodes:
            if not isinstance(node, (ast.Call, ast.Assign, ast.AnnAssign)):
                continue
            if said := self.of_call(node) if isinstance(node, ast.Call) else self.of_assignment(node):
                found.append({"kind": said[0], "lineno": node.lineno, "detail": said[1]})
        self.rows = sorted(found, key=lambda s: (s["lineno"], s["kind"]))

    def of_call(self, call: ast.Call) -> tuple[str, str] | None:
        name = dotted(call.func)
        if name is None:
            return None
        head, dot, tail = name.partition(".")
        name = self.aliases.get(head, head) + dot + tail
        given = {k.arg: k.value for k in reversed(call.keywords)}
        constant = {k: v.value for k, v in given.items() if isinstance(v, ast.Constant)}
        package, _, function = name.rpartition(".")
        if name in DYNAMIC_CALLS:
            return "dynamic-execution", f"{name}()"
        if name in SHELL_CALLS:
            return "shell-execution", f"{name}()"
        if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in call.keywords):
            return "shell-execution", f"{name}(shell=True)"
        if function in ("load", "loads") and name.split(".")[0] in UNSAFE_LOADERS:
            return "unsafe-deserialization", f"{name}()"
        if name == "yaml.load":
            loader = given.get("Loader")
            if loader is None:
                return "unsafe-deserialization", "yaml.load() without a safe loader"
            if not (dotted(loader) or "").endswith("SafeLoader"):
                return "unsafe-deserialization", "yaml.load() with an unsafe loader"
        if package == "hashlib" and constant.get("usedforsecurity") is not False:
            if function in WEAK_HASHES:
                return "weak-hash", f"{name}()"
            match call.args[:1]:
                case [ast.Constant(value=str(algorithm))] if function == "new" and algorithm.lower() in WEAK_HASHES:
                    return "weak-hash", f"hashlib.new({algorithm.lower()!r})"
        if name == "tempfile.mktemp":
            return "insecure-temp-file", f"{name}()"
        return None

    def of_assignment(self, node: ast.AST) -> tuple[str, str] | None:
        """The name of a variable that seems to hold a secret; never its value."""
        value = getattr(node, "value", None)
        for target in _targets(node):
            match target, value:
                case ast.Name(id=name), ast.Constant(value=str(text)) if is_secret(name, text):
                    return "hardcoded-secret", f"a text is assigned to `{name}`"
        return None


def is_secret(name: str, text: str) -> bool:
    name, lowered = name.lower(), text.lower()
    return len(text) >= SECRET_LENGTH and any(p in name for p in SECRET_PARTS) and not any(p in lowered for p in PLACEHOLDERS)


def code_lines(source: str) -> int:
    """Lines on which a token of code begins, of a source that can be parsed."""
    # without a token over several lines, every line begins one that is neither blank nor a comment
    if not any(x in source for x in ("\\\n", "\"\"\"", "'''")) and not source.endswith("\\"):
        return sum(bool(x) and x[0] != "#" for x in map(str.strip, source.split("\n")))
    lines = set()
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type not in _NOT_CODE:
                lines.add(token.start[0])
    except (tokenize.TokenError, SyntaxError):
        pass  # what was counted so far stands
    return len(lines)


def decode(content: bytes) -> str:
    """Source text by its coding line or byte order mark, with plain newlines."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
    return re.sub("\r\n?", "\n", content.decode(encoding))


def module_row(content: bytes, module: str, failed: str | None = None) -> dict:
    """All that is known of one file. A file that cannot be parsed, or be read (``failed``), has ``syntax_error`` and nothing
    else."""
    row = {"total_lines": 0, "loc": 0, "functions": [], "classes": [], "imports": [], "signals": [], "exports": [], "references": [], "has_docstring": False, "syntax_error": failed, "lines": []}
    if failed is not None:
        return row
    try:
        source = decode(content)
    except (SyntaxError, UnicodeDecodeError, LookupError) as error:
        return row | {"syntax_error": f"{type(error).__name__}: {error}"}
    row["lines"] = source.splitlines()
    row["total_lines"] = len(row["lines"])
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
            return row | _tree_rows(tree, module) | {"loc": code_lines(source)}
    except SyntaxError as error:
        return row | {"syntax_error": f"line {error.lineno}: {error.msg}"}
    except (ValueError, RecursionError, MemoryError) as error:
        return row | {"syntax_error": f"{type(error).__name__}: {error}"}


def _tree_rows(tree: ast.Module, module: str) -> dict:
    functions, classes, imports, exported, nodes = [], [], [], set(), walk(tree)
    for statement in tree.body:
        match statement:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                functions.append(function_row(statement, module, None))
            case ast.ClassDef():
                classes.append(class_row(statement, module))
            case ast.Import() | ast.ImportFrom():
                imports += import_rows(statement)
            case _:
                exported |= exports(statement)
    return {
        "functions": functions,
        "classes": classes,
        "imports": imports,
        "signals": Signals(nodes).rows,
        "exports": sorted(exported),
        "references": sorted(references(nodes)),
        "has_docstring": ast.get_docstring(tree) is not None,
    }
