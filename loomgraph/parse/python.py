"""Python source by the standard library's syntax tree."""

from __future__ import annotations

import ast

from .records import Parsed, add_calls, start_file

_BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match, ast.match_case, ast.IfExp, ast.BoolOp)


def _decorators(node: ast.AST) -> set[str]:
    return {ast.unparse(d).split("(")[0].split(".")[-1] for d in getattr(node, "decorator_list", [])}


def _doc(node: ast.AST) -> str | None:
    text = ast.get_docstring(node)
    return text[:512] if text else None


def _complexity(node: ast.AST) -> int:
    return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else 1 for n in ast.walk(node) if isinstance(n, _BRANCHES))


def _function(out: Parsed, node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> None:
    marks, is_async = _decorators(node), isinstance(node, ast.AsyncFunctionDef)
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    name = f"{owner}.{node.name}" if owner else node.name
    made = out.symbol(
        "function", node.name, node.lineno, node.end_lineno, qualified_name=name, docstring=_doc(node), complexity=_complexity(node), is_async=is_async, is_exported=True,
        signature=f"{'async ' * is_async}def {node.name}({ast.unparse(node.args)}){returns}"[:200], is_property="property" in marks, is_classmethod="classmethod" in marks, is_staticmethod="staticmethod" in marks,
    )
    out.edge(f"class:{out.path}::{owner}" if owner else out.file_id, made, "defines")


def _imports(out: Parsed, node: ast.Import | ast.ImportFrom) -> None:
    if isinstance(node, ast.Import):
        out.edge(out.file_id, f"module:{node.names[0].name}", "imports", line=node.lineno)
        return
    module = "." * node.level + (node.module or "")
    out.edge(out.file_id, f"module:{module}", "imports", line=node.lineno, module=module, is_relative=node.level > 0, is_star=any(a.name == "*" for a in node.names))


def _class(out: Parsed, node: ast.ClassDef) -> None:
    bases, marks = [ast.unparse(b) for b in node.bases], _decorators(node)
    made = out.symbol("class", node.name, node.lineno, node.end_lineno, bases=bases, docstring=_doc(node), is_abstract=bool({"ABC", "abc.ABC", "ABCMeta"} & set(bases)), is_dataclass="dataclass" in marks, is_exported=True)
    out.edge(out.file_id, made, "defines")
    for base in bases:
        out.edge(made, f"class:?::{base.split('[')[0].split('.')[-1]}", "inherits", resolved=False)


def _callee(node: ast.Call) -> tuple[str, int, str]:
    f = node.func
    if isinstance(f, ast.Name):
        return f.id, node.lineno, "free"
    if isinstance(f, ast.Attribute):
        own = isinstance(f.value, ast.Name) and f.value.id in ("self", "cls")
        return f.attr, node.lineno, "self" if own else "attr"
    return "", node.lineno, "free"


def parse(path: str, source: bytes) -> Parsed:
    out, text = start_file(path, "python", source)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.errors.append(f"not parsed: {e}")
        return out
    classes = [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
    classes.sort(key=lambda n: (n.lineno, n.col_offset))
    for node in classes:
        _class(out, node)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            owner = next((c.name for c in classes if c.lineno < node.lineno <= c.end_lineno), None)
            _function(out, node, owner)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            _imports(out, node)
        elif isinstance(node, ast.TypeAlias):
            name = node.name.id
            out.symbol("type", name, node.lineno, node.end_lineno, definition=ast.unparse(node.value), is_exported=not name.startswith("_"))
    add_calls(out, (_callee(n) for n in ast.walk(tree) if isinstance(n, ast.Call)))
    return out
