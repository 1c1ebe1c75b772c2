"""Python extraction (EX-P): functions, symbols, call forms and statement spans of source files.

Files are parsed with the standard `ast` in Arrow batches, a file a row, so extraction
spreads over tasks like any scan.  A file that does not parse yields one `error` record
and stops nothing.  Records have the columns of `static_source`.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import static_source, syntax
from .static_source import RECORDS

#: fixed values: built-in types that say nothing about a parameter
BUILTIN_TYPES = frozenset("int str float bool bytes list dict set tuple None object Any type complex frozenset bytearray".split())
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


#: fixed values: parts of nodes that are no nodes, or marks without parts
_PLAIN = frozenset("ctx op ops id attr arg asname module level kind type_comment type_ignores simple is_async conversion".split())
_PARTS: dict[type, tuple[str, ...]] = {}


def _children(node: ast.AST) -> list[ast.AST]:
    """The nodes right below a node, but operators and contexts."""
    kind, out = type(node), []
    if kind not in _PARTS:
        _PARTS[kind] = tuple(f for f in kind._fields if f not in _PLAIN)
    for f in _PARTS[kind]:
        part = getattr(node, f, None)
        if part.__class__ is list:
            out += [x for x in part if isinstance(x, ast.AST)]
        elif isinstance(part, ast.AST):
            out.append(part)
    return out


def module_of(file: str) -> str:
    return file.removesuffix(".py")


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """A node and those below it, without nested functions and lambdas; parents first."""
    stack = [node]
    while stack:
        node = stack.pop()
        if not isinstance(node, _SCOPES):
            yield node
            stack += _children(node)[::-1]


def _inside(fn: ast.AST) -> list[ast.AST]:
    """What a function's defaults and body are made of (EX-P6)."""
    roots = [*fn.args.defaults, *(d for d in fn.args.kw_defaults if d), *fn.body]
    return [n for root in roots for n in _own(root)]


def _imported(nodes: list[ast.AST], stars: bool) -> dict[str, str]:
    """Local name to qualified name (EX-P2); relative imports lose their dots."""
    out: dict[str, str] = {}
    for node in nodes:
        if isinstance(node, ast.Import):
            out |= {a.asname or a.name: a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            prefix = f"{node.module}." if node.module else ""
            out |= {a.asname or a.name: prefix + a.name for a in node.names if stars or a.name != "*"}
    return out


def annotated(node: ast.AST | None) -> str | None:
    """The name an annotation stands for (EX-P3): X, a.X, the first side of a union that names one, Optional[X]."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return ast.unparse(node)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return annotated(node.left) or annotated(node.right)
    if isinstance(node, ast.Subscript) and ast.unparse(node.value) in ("Optional", "typing.Optional"):
        return annotated(node.slice)
    return None


def _telling(name: str | None, imports: dict[str, str]) -> str | None:
    return imports.get(name, name) if name and name.rpartition(".")[2] not in BUILTIN_TYPES else None


def _is_mine(node: ast.AST) -> bool:
    return isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self"


def self_attributes(inside: list[ast.AST]) -> tuple[list[str], list[str]]:
    """Attributes of self that what a function is made of reads and writes (EX-P5)."""
    read, written = set(), set()

    def assigned(target: ast.AST) -> None:
        if _is_mine(target):
            written.add(target.attr)
        for part in target.elts if isinstance(target, (ast.Tuple, ast.List)) else []:
            assigned(part)

    for node in inside:
        if _is_mine(node) and not isinstance(node.ctx, ast.Store):
            read.add(node.attr)
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                assigned(t)
        elif isinstance(node, ast.AugAssign):
            assigned(node.target)
            if _is_mine(node.target):
                read.add(node.target.attr)
        elif isinstance(node, ast.AnnAssign) and node.value is not None:
            assigned(node.target)
    return sorted(read), sorted(written)


def _calls(node: ast.AST, awaited: bool = False) -> Iterator[tuple[ast.Call, bool]]:
    """Calls below a node, outer ones first, and whether each stands under `await` with no call between."""
    if isinstance(node, _SCOPES):
        return
    if isinstance(node, ast.Call):
        yield node, awaited
    below = isinstance(node, ast.Await) or awaited and not isinstance(node, ast.Call)
    for child in _children(node):
        yield from _calls(child, below)


def _form(func: ast.AST, cls: str | None) -> dict:
    """A called expression as a form with its parts."""
    raw = ast.unparse(func)
    raw = raw if len(raw) <= 80 else raw[:77] + "..."
    out = {"form": "other", "head": None, "name": raw, "raw": raw}
    if isinstance(func, ast.Name):
        out |= {"form": "bare", "name": func.id}
    elif isinstance(func, ast.Attribute):
        if isinstance(func.value, ast.Name):
            mine = func.value.id == "self" and cls is not None
            out |= {"form": "self" if mine else "member", "head": func.value.id, "name": func.attr}
        elif _is_mine(func.value) and cls is not None:
            out |= {"form": "self_attr", "head": func.value.attr, "name": func.attr}
    return out


def _learnt(methods: list[tuple[str, ast.AST]], imports: dict[str, str]) -> Iterator[tuple[str, str, str]]:
    """(class, attribute, type) of attributes made by a call (EX-P4), the first that tells counts."""
    returns = {(cls, fn.name): ast.unparse(fn.returns) if fn.returns else "" for cls, fn in methods}
    seen = set()
    for cls, fn in methods:
        for node in ast.walk(fn):
            if not (isinstance(node, ast.Assign) and len(node.targets) == 1 and _is_mine(node.targets[0]) and isinstance(node.value, ast.Call)):
                continue
            made, key = node.value.func, (cls, node.targets[0].attr)
            kind = made.id if isinstance(made, ast.Name) else None
            if _is_mine(made):
                said = returns.get((cls, made.attr), "").replace(" | None", "").strip()
                kind = said if said and not re.search(r"[\[\]|, ]", said) else None
            kind = _telling(kind, imports)
            if kind and key not in seen:
                seen.add(key)
                yield *key, kind


def records(file: str, source: str, kinds: Collection[str] | None = None) -> list[dict]:
    """All records of one file: kinds function, call, import, type (classes), free, method, field, error; of some kinds only those, less being read for them."""
    told, called, learnt = (kinds is None or k in kinds for k in ("function", "call", "field"))
    module = module_of(file)
    base = {"lang": "python", "file": file, "module": module}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [{**base, "kind": "error", "raw": str(e)[:200]}] if kinds is None or "error" in kinds else []
    outside = [n for n in _own(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    imports, out, methods = _imported(outside, True), [], []
    out += [{**base, "kind": "import", "name": k, "target": v} for k, v in imports.items()]

    def function(fn: ast.AST, cls: str | None, outer: list[str]) -> None:
        qualname = ".".join([*([cls] if cls else []), *outer, fn.name])
        ident = f"{module}.{qualname}"
        inside = _inside(fn) if told or called else []
        local = imports | _imported([n for n in inside if isinstance(n, (ast.Import, ast.ImportFrom))], False)
        args = [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs, *filter(None, [fn.args.vararg, fn.args.kwarg])]
        types = {a.arg: t for a in args if a.arg != "self" and (t := _telling(annotated(a.annotation), imports))}
        if told:
            decorators = [ast.unparse(d) for d in fn.decorator_list]
            read, written = self_attributes(inside)
            is_async = isinstance(fn, ast.AsyncFunctionDef)
            returns = f" -> {ast.unparse(fn.returns)}" if fn.returns else ""
            out.append(
                {
                    **base, "kind": "function", "id": ident, "name": fn.name, "qualname": qualname, "class_name": cls, "line_start": fn.lineno, "line_end": fn.end_lineno,
                    "signature": f"{'async ' if is_async else ''}def {fn.name}({ast.unparse(fn.args)}){returns}", "is_async": is_async,
                    "is_method": cls is not None and not outer and not any(d.startswith("staticmethod") for d in decorators),
                    "decorators": decorators, "used_self_attrs_read": read, "used_self_attrs_written": written, "params_types": types,
                }
            )
        if not outer:
            out.append({**base, "kind": "method" if cls else "free", "owner": cls, "name": fn.name, "id": ident})
            if cls:
                methods.append((cls, fn))
        for root in [*fn.args.defaults, *(d for d in fn.args.kw_defaults if d), *fn.body] if called else ():
            for call, awaited in _calls(root):
                form = _form(call.func, cls)
                named = form["name"] if form["form"] == "bare" else form["head"]
                out.append({**base, "kind": "call", "id": ident, "class_name": cls, "owner": cls, "params_types": types, **form, "line": call.lineno, "is_await": awaited, "target": local.get(named)})
        for node in fn.body:
            nested(node, cls, [*outer, fn.name])

    def nested(node: ast.AST, cls: str | None, outer: list[str]) -> None:
        if isinstance(node, _DEFS):
            function(node, cls, outer)
        else:
            for child in _children(node):
                nested(child, cls, outer)

    def visit(node: ast.AST, cls: str | None) -> None:
        if isinstance(node, _DEFS):
            function(node, cls, [])
        elif isinstance(node, ast.ClassDef):
            out.append({**base, "kind": "type", "name": node.name})
            for child in node.body:
                visit(child, node.name)
        else:
            for child in _children(node):
                visit(child, cls)

    visit(tree, None)
    out += [{**base, "kind": "field", "owner": cls, "name": attr, "target": kind} for cls, attr, kind in (_learnt(methods, imports) if learnt else ())]
    return out if kinds is None else [r for r in out if r["kind"] in kinds]


def statement_spans(source: str, qualname: str) -> list[tuple[int, int]]:
    """Spans of all statements inside a function, sorted and distinct (EX-P8).

    Leading parts of the name that the file doesn't define are left out; of a class the
    direct member of the last name is taken.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    parts, top = qualname.split("."), {n.name: n for n in reversed(tree.body) if isinstance(n, (*_DEFS, ast.ClassDef))}
    while parts and parts[0] not in top:
        parts = parts[1:]
    if not parts:
        return []
    found = top[parts[0]]
    if isinstance(found, ast.ClassDef):
        found = next((n for n in found.body if len(parts) > 1 and isinstance(n, _DEFS) and n.name == parts[-1]), None)
    elif len(parts) > 1:
        found = None
    return sorted({(n.lineno, n.end_lineno) for s in (found.body if found else []) for n in ast.walk(s) if isinstance(n, ast.stmt)})


def definition_spans(source: str) -> list[tuple[str, int, int]]:
    """(qualname, first line with decorators, last line) of every function (EX-X3)."""
    out: list[tuple[str, int, int]] = []

    def visit(node: ast.AST, path: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (*_DEFS, ast.ClassDef)):
                if isinstance(child, _DEFS):
                    out.append((".".join([*path, child.name]), min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno))
                visit(child, [*path, child.name])
            else:
                visit(child, path)

    try:
        visit(ast.parse(source), [])
    except (SyntaxError, ValueError):
        return []
    return out


def parses(source: str) -> bool:
    """The syntax gate (EX-X4)."""
    try:
        compile(source, "file", "exec", dont_inherit=True)
    except (SyntaxError, ValueError):
        return False
    return True


def tail_repaired(source: str, most: int = 8) -> str | None:
    """The source, or it without up to `most` last lines, if that parses (CH-12); null if none does."""
    lines = source.splitlines(keepends=True)
    for cut in range(min(most, max(0, len(lines) - 1)) + 1):
        text = "".join(lines[: len(lines) - cut])
        if parses(text):
            return text
    return None


def extract(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Records of Python files (file, source, ord), of all kinds or the named ones, with file_ord and ord, their order in all that are given; a null source is an empty file."""
    return static_source.mapped(files, ["file", "source"], RECORDS, lambda file, source: records(file, source or "", kinds))


def spans_of(file: str, source: str, qualname: str) -> list[tuple[int, int]]:
    """Statement spans by the language of the file's extension (RG-4); none for other files."""
    if file.endswith(".py"):
        return statement_spans(source, qualname)
    lang = next((lang for lang, ends in static_source.EXTENSIONS.items() if file.endswith(ends)), None)
    return static_source.spans(lang, source, qualname) if lang else []


def statements(requests: DataFrame) -> DataFrame:
    """Statement spans of functions: requests (file, source, qualname) to (file, qualname, s, e); RG-4."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, q, s, e) for f, t, q in zip(b["file"], b["source"], b["qualname"], strict=True) for s, e in spans_of(f, t or "", q)]
            yield pd.DataFrame(rows, columns=["file", "qualname", "s", "e"])

    return requests.select("file", "source", "qualname").mapInPandas(run, "file string, qualname string, s int, e int")


def definitions(files: DataFrame) -> DataFrame:
    """EX-X3 over files (file, source): (file, qualname, line_start, line_end, parses); a file without functions has one row with nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, source in zip(b["file"], b["source"], strict=True):
                if file.endswith(".py"):
                    ok, found = parses(source or ""), definition_spans(source or "")
                else:
                    lang = next((lang for lang, ends in static_source.EXTENSIONS.items() if file.endswith(ends)), None)
                    own = [r for r in static_source.records(lang, file, source or "") if r["kind"] == "function"] if lang else []
                    ok, found = not syntax.errors(lang, source or "", file.endswith(".tsx")) if lang else True, [(r["qualname"], r["line_start"], r["line_end"]) for r in own]
                rows += [(file, *x, ok) for x in found or [(None, None, None)]]
            yield pd.DataFrame(rows, columns=["file", "qualname", "line_start", "line_end", "parses"]).astype({"line_start": "Int32", "line_end": "Int32"})

    return files.select("file", "source").mapInPandas(run, "file string, qualname string, line_start int, line_end int, parses boolean")


def freeze_gate(files: DataFrame) -> DataFrame:
    """CH-12 over edited files (file, source): file, source to hash, state `ok`, `repaired` (a Python tail of up to 8 lines cut) or `frozen`.

    A null source is a missing file and frozen.  Inputs are not rewritten.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, source in zip(b["file"], b["source"], strict=True):
                lang = next((lang for lang, ends in static_source.EXTENSIONS.items() if file.endswith(ends)), None)
                fixed = source
                if source is not None and file.endswith(".py"):
                    fixed = tail_repaired(source)
                elif source is not None and lang and syntax.errors(lang, source, file.endswith(".tsx")):
                    fixed = None
                rows.append((file, fixed, "frozen" if fixed is None else "ok" if fixed == source else "repaired"))
            yield pd.DataFrame(rows, columns=["file", "source", "state"])

    return files.select("file", "source").mapInPandas(run, "file string, source string, state string")
