"""What a parser gives for a file, and the rules that all languages share."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions.text import TEST_PATHS, todo_pattern

# Methods of built-in types, which a call on an unknown receiver never binds to.
BUILTIN_METHODS = frozenset({
    "append", "extend", "keys", "values", "items", "setdefault", "popitem",
    "read", "readline", "readlines", "write", "writelines", "flush", "seek", "tell",
    "strip", "lstrip", "rstrip", "split", "rsplit", "splitlines", "encode", "decode", "lower", "upper", "title", "capitalize",
    "startswith", "endswith", "isdigit", "isalpha", "isalnum", "isspace",
    "exists", "is_file", "is_dir", "mkdir", "resolve", "glob", "rglob", "unlink", "iterdir", "absolute", "as_posix",
    "read_text", "write_text", "read_bytes", "write_bytes",
})
#: What an editor's backend leaves out besides.
EDITOR_METHODS = BUILTIN_METHODS | {
    "forEach", "map", "filter", "reduce", "slice", "splice", "push", "pop", "shift", "unshift", "concat", "indexOf", "includes", "trim", "toString", "then", "catch", "finally",
}

NODE_FIELDS = """node_id string, kind string, name string, qualified_name string, file string, path string, lang string, line_start int, line_end int,
line_count int, size_bytes bigint, sha256 string, signature string, docstring string, bases array<string>, definition string, complexity int, is_test boolean,
is_async boolean, is_property boolean, is_classmethod boolean, is_staticmethod boolean, is_abstract boolean, is_dataclass boolean, is_exported boolean"""
EDGE_FIELDS = "src string, dst string, kind string, line int, module string, is_relative boolean, is_star boolean, resolved boolean, callee string, self_call boolean"
TODO_FIELDS = "node_id string, file string, line int, kind string, text string"


@dataclass
class Parsed:
    path: str
    lang: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    todos: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    @property
    def file_id(self) -> str:
        return f"file:{self.path}"

    def symbol(self, kind: str, name: str, start: int, end: int | None = None, **more) -> str:
        """Add a symbol's node; its id."""
        prefix = {"function": "func"}.get(kind, kind)
        node_id = f"{prefix}:{self.path}::{more.get('qualified_name') or name}"
        self.nodes.append({"node_id": node_id, "kind": kind, "name": name, "qualified_name": name, "file": self.file_id, "line_start": start, "line_end": end or start, **more})
        return node_id

    def edge(self, src: str, dst: str, kind: str, **more) -> None:
        self.edges.append({"src": src, "dst": dst, "kind": kind, **more})


def start_file(path: str, lang: str, source: bytes) -> tuple[Parsed, str]:
    """The file's own node and its marks; the decoded text."""
    text = source.decode("utf-8", "replace")
    lines = text.splitlines()
    out = Parsed(path, lang)
    tests = TEST_PATHS.get("c" if lang == "cpp" else lang)
    out.nodes.append({"node_id": out.file_id, "kind": "file", "path": path, "lang": lang, "size_bytes": len(source), "sha256": hashlib.sha256(source).hexdigest(), "line_count": len(lines), "is_test": bool(tests and re.search(tests, path))})
    mark = re.compile(todo_pattern({"cpp": "c", "javascript": "typescript"}.get(lang, lang)))
    for k, line in enumerate(lines, 1):
        if m := mark.search(line):
            out.todos.append({"node_id": out.file_id, "file": path, "line": k, "kind": m[1].upper(), "text": m[2].strip()})
    return out, text


def add_calls(out: Parsed, sites: Iterable[tuple[str, int, str]], builtin: frozenset[str] = BUILTIN_METHODS) -> None:
    """Open calls from (callee, line, scope free, attr or self), each from the tightest function around its line.

    Calls outside functions, repeated ones on a line, and those on other receivers to a built-in type's method are left out.
    """
    functions = [n for n in out.nodes if n["kind"] == "function"]
    seen = set()
    for callee, line, scope in sites:
        if not callee or scope == "attr" and callee in builtin:
            continue
        around = [f for f in functions if f["line_start"] <= line <= f["line_end"]]
        if not around:
            continue
        caller = min(around, key=lambda f: f["line_end"] - f["line_start"])["node_id"]
        if (caller, callee, line) not in seen:
            seen.add((caller, callee, line))
            out.edge(caller, f"func:?::{callee}", "calls", line=line, callee=callee, resolved=False, self_call=scope == "self")
