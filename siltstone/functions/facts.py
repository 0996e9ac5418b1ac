"""The one Python operator of the engine: source text to syntax facts.

``facts(text)`` parses a file once with the standard library's ``ast`` and returns a struct of plain facts;
every syntax rule is a filter over it in Catalyst. As a column it is pruned wherever no rule asks for it.
A text that cannot be parsed (syntax, null bytes, nesting) has null facts.

``events`` lists calls, exception handlers, function definitions with their parameters, assignments and
request-model fields in the order of a walk from the top. The other members are line numbers: of calls whose
argument is built from nothing but constants, imports and local names, and of calls on HTTP session objects.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT = "struct<kind:string,line:int,name:string,bare:boolean,dynamic:boolean,keywords:array<string>,true_keywords:array<string>,inner:string,at:int,flags:array<boolean>>"
FACTS = f"struct<events:array<{EVENT}>,sql_safe:array<int>,driver_safe:array<int>,ssrf_safe:array<int>,session_lines:array<int>,session_safe:array<int>,lxml:string>"

# Names that the rules know.
LOG_METHODS = frozenset("debug info warning warn error critical exception log".split())
LOG_WORDS = frozenset("log logs logger logging".split())
HTTP_METHODS = frozenset("get post put patch delete head options request".split())
SESSIONS = frozenset(("requests.Session", "httpx.Client", "httpx.AsyncClient"))
REQUEST_SUFFIXES = ("Request", "Input", "Payload", "Body", "Params")
MOST_DEPTH = 8

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_CLOSED = (*_DEFS, ast.ClassDef, ast.Lambda)


def walk(nodes: list[ast.AST], closed: tuple[type, ...] = ()) -> Iterator[ast.AST]:
    """Every node below ``nodes``, parents first; a ``closed`` node is given but not entered."""
    stack = list(reversed(nodes))
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, closed):
            stack.extend(reversed(list(ast.iter_child_nodes(node))))


def dotted(node: ast.AST) -> str:
    """``a.b.c`` of an attribute chain; a base that is no name is left out."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names))


def _true(node: ast.AST | None) -> bool:
    return isinstance(node, ast.Constant) and node.value is True


def _reports(handler: ast.ExceptHandler) -> bool:
    """Whether a handler raises, logs, warns, or uses the exception it caught."""
    for node in walk(handler.body, _CLOSED):
        if isinstance(node, ast.Raise) or (isinstance(node, ast.Name) and handler.name and node.id == handler.name):
            return True
        if isinstance(node, ast.Call):
            name = dotted(node.func)
            if isinstance(node.func, ast.Attribute) and node.func.attr in LOG_METHODS:
                return True
            if name == "warnings.warn" or not LOG_WORDS.isdisjoint(name.lower().replace("_", ".").split(".")):
                return True
    return False


def _text_type(note: ast.AST) -> str | None:
    """``str`` or ``bytes``, bare or within Optional, Annotated or a union."""
    plain = lambda n: n.id if isinstance(n, ast.Name) and n.id in ("str", "bytes") else None
    if isinstance(note, ast.Subscript) and isinstance(note.value, ast.Name):
        if note.value.id == "Optional":
            return plain(note.slice)
        if note.value.id == "Annotated" and isinstance(note.slice, ast.Tuple) and note.slice.elts:
            return plain(note.slice.elts[0])
        return None
    if isinstance(note, ast.BinOp) and isinstance(note.op, ast.BitOr):
        return plain(note.left) or plain(note.right)
    return plain(note)


def _limits(node: ast.AST | None) -> bool:
    return isinstance(node, ast.Call) and dotted(node.func) in ("Field", "StringConstraints") and any(k.arg == "max_length" for k in node.keywords)


def _limited(field: ast.AnnAssign) -> bool:
    note = field.annotation
    inside = isinstance(note, ast.Subscript) and isinstance(note.value, ast.Name) and note.value.id == "Annotated" and isinstance(note.slice, ast.Tuple)
    return _limits(field.value) or (inside and any(_limits(x) for x in note.slice.elts[1:]))


def _is_model(node: ast.ClassDef) -> bool:
    def base(b: ast.AST) -> bool:
        root = b
        while isinstance(root, ast.Attribute):
            root = root.value
        return isinstance(root, ast.Name) and dotted(b).rpartition(".")[2] == "BaseModel"

    return node.name.endswith(REQUEST_SUFFIXES) and any(map(base, node.bases))


def _event(kind: str, line: int, name: str = "", **more) -> dict:
    return {"kind": kind, "line": line, "name": name, "bare": False, "dynamic": False, "keywords": [], "true_keywords": [], "inner": None, "at": None, "flags": []} | more


def _allow_pickle(target: ast.AST) -> bool:
    return (target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else "") == "allow_pickle"


def events(tree: ast.Module) -> list[dict]:
    out = []
    for node in walk(tree.body):
        match node:
            case ast.Call():
                named = [k for k in node.keywords if k.arg is not None]
                risky = [k.value.lineno for k in named if k.arg == "allow_pickle" and _true(k.value)]
                values = [*node.args, *(k.value for k in node.keywords)]
                inner = dotted(node.args[0].func) if node.args and isinstance(node.args[0], ast.Call) else None
                out.append(_event("call", node.lineno, dotted(node.func), bare=isinstance(node.func, ast.Name), dynamic=not all(isinstance(v, ast.Constant) for v in values), keywords=[k.arg for k in named], true_keywords=[k.arg for k in named if _true(k.value)], inner=inner, at=risky[0] if risky else None))
            case ast.ExceptHandler():
                only = type(node.body[0]) if len(node.body) == 1 else None
                broad = node.type is None or (isinstance(node.type, ast.Name) and node.type.id == "Exception")
                out.append(_event("except", node.lineno, flags=[broad, only is ast.Pass, only is ast.Continue, _reports(node)]))
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                out.append(_event("def", node.lineno, node.name, bare=isinstance(node, ast.FunctionDef)))
                a = node.args
                plain = [*a.posonlyargs, *a.args]
                given = [*zip(plain[len(plain) - len(a.defaults) :], a.defaults, strict=True), *zip(a.kwonlyargs, a.kw_defaults, strict=True)]
                out += [_event("risky", d.lineno) for p, d in given if p.arg == "allow_pickle" and _true(d)]
            case ast.ClassDef() if _is_model(node):
                fields = [(f, _text_type(f.annotation)) for f in node.body if isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name)]
                out += [_event("field", f.lineno, f.target.id, inner=kind, flags=[_limited(f)]) for f, kind in fields if kind]
            case ast.Assign() if any(map(_allow_pickle, node.targets)) and _true(node.value):
                out.append(_event("risky", node.lineno))
            case ast.AnnAssign() if _allow_pickle(node.target) and _true(node.value):
                out.append(_event("risky", node.lineno))
    return out


class Scope:
    """The module or one function: its parameters, what its names are bound to, and the calls it makes itself."""

    def __init__(self, body: list[ast.stmt], params: frozenset[str], outer: Scope | None):
        self.params = params
        self.bound: dict[str, ast.AST] = dict(outer.bound) if outer else {}
        self.known: set[str] = set(outer.known) if outer else set()
        self.calls: list[ast.Call] = []
        for node in walk(body, _CLOSED):
            match node:
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    self.known.add(node.name)
                case ast.Import():
                    self.known.update(a.asname or a.name.partition(".")[0] for a in node.names)
                case ast.ImportFrom():
                    self.known.update(a.asname or a.name for a in node.names)
                case ast.Assign():
                    self.bound.update((t.id, node.value) for t in node.targets if isinstance(t, ast.Name))
                case ast.AnnAssign() if isinstance(node.target, ast.Name) and node.value is not None:
                    self.bound[node.target.id] = node.value
                case ast.With() | ast.AsyncWith():
                    self.bound.update((i.optional_vars.id, i.context_expr) for i in node.items if isinstance(i.optional_vars, ast.Name))
                case ast.Call():
                    self.calls.append(node)

    def safe(self, node: ast.AST, depth: int = 0) -> bool:
        """Whether an expression depends on nothing but constants, imports and local definitions."""
        if depth > MOST_DEPTH:
            return False
        match node:
            case ast.Constant():
                return True
            case ast.Name(id=name):
                if name in self.params:
                    return False
                return name in self.known or (name in self.bound and self.safe(self.bound[name], depth + 1))
            case ast.Attribute(value=inner):
                return self.safe(inner, depth + 1)
            case ast.Call():
                return all(self.safe(x, depth + 1) for x in (node.func, *node.args, *(k.value for k in node.keywords)))
            case ast.JoinedStr(values=parts):
                return all(self.safe(p.value, depth + 1) for p in parts if isinstance(p, ast.FormattedValue))
            case ast.BinOp(left=a, right=b):
                return self.safe(a, depth + 1) and self.safe(b, depth + 1)
        return False


def scopes(tree: ast.Module) -> Iterator[Scope]:
    module = Scope(tree.body, frozenset(), None)
    yield module
    for node in walk(tree.body):
        if isinstance(node, _DEFS):
            a = node.args
            yield Scope(node.body, frozenset(p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs)), module)


def call_lines(tree: ast.Module) -> dict[str, list[int]]:
    """Line numbers of calls, by what the scope analysis says of them."""
    out: dict[str, set[int]] = {k: set() for k in ("sql_safe", "driver_safe", "ssrf_safe", "session_lines", "session_safe")}
    for scope in scopes(tree):
        for call in scope.calls:
            func, first = call.func, call.args[0] if call.args else None
            safe = first is not None and scope.safe(first)
            if isinstance(func, ast.Attribute):
                if safe and isinstance(first, ast.JoinedStr) and func.attr in ("execute", "exec_driver_sql"):
                    out["sql_safe"].add(call.lineno)
                    if func.attr == "exec_driver_sql":
                        out["driver_safe"].add(call.lineno)
                base = func.value.id if isinstance(func.value, ast.Name) else None
                if base and func.attr in HTTP_METHODS:
                    if safe and base in ("requests", "httpx"):
                        out["ssrf_safe"].add(call.lineno)
                    made = scope.bound.get(base)
                    if isinstance(made, ast.Call) and dotted(made.func) in SESSIONS:
                        out["session_lines"].add(call.lineno)
                        if safe:
                            out["session_safe"].add(call.lineno)
            if safe and dotted(func) == "urllib.request.urlopen":
                out["ssrf_safe"].add(call.lineno)
    return {k: sorted(v) for k, v in out.items()}


def lxml_name(tree: ast.Module) -> str | None:
    """The name that the last import of lxml.etree binds."""
    found = None
    for node in walk(tree.body):
        if isinstance(node, ast.ImportFrom) and node.module == "lxml":
            for a in node.names:
                found = (a.asname or a.name) if a.name == "etree" else found
        elif isinstance(node, ast.Import):
            for a in node.names:
                found = (a.asname or a.name) if a.name == "lxml.etree" else found
    return found


def facts_of(text: str | None) -> dict | None:
    if text is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        return {"events": events(tree), **call_lines(tree), "lxml": lxml_name(tree)}
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


_INT, _TEXT, _FLAG = pa.int32(), pa.string(), pa.bool_()
_MEMBERS = {"kind": _TEXT, "line": _INT, "name": _TEXT, "bare": _FLAG, "dynamic": _FLAG, "keywords": pa.list_(_TEXT), "true_keywords": pa.list_(_TEXT), "inner": _TEXT, "at": _INT, "flags": pa.list_(_FLAG)}
_LINES = ("sql_safe", "driver_safe", "ssrf_safe", "session_lines", "session_safe")


def _facts(texts: pa.Array) -> pa.Array:
    """Column by column: the members of all files' events are one array each."""
    found = [facts_of(t) for t in texts.to_pylist()]
    each = [e for f in found if f for e in f["events"]]
    flat = pa.StructArray.from_arrays([pa.array([e[k] for e in each], t) for k, t in _MEMBERS.items()], list(_MEMBERS))
    offsets, n = [], 0
    for f in found:
        offsets.append(n if f else None)
        n += len(f["events"]) if f else 0
    rest = [pa.array([f and f[k] for f in found], pa.list_(_INT)) for k in _LINES]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array([*offsets, n], _INT), flat), *rest, pa.array([f and f["lxml"] for f in found], _TEXT)], ["events", *_LINES, "lxml"])


def facts(text: Column, ext: Column) -> Column:
    """Facts of the Python files; members are null for all others."""
    return F.arrow_udf(_facts, FACTS)(F.when(ext == "py", text))
