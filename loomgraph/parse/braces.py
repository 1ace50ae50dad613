"""Languages with braces, by one scanner that a table of patterns drives."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from .records import Parsed, add_calls, start_file


@dataclass(frozen=True)
class Spec:
    """Patterns of a language over text whose comments and strings are blank. Named groups: name, owner, bases, head."""

    lang: str
    extensions: tuple[str, ...]
    classes: str
    functions: str
    branches: str
    imports: tuple[str, ...]
    types: str = r"(?!)"
    owners: str = r"(?!)"  # blocks whose functions belong to a name, such as impl
    implements: str = r"(?!)"
    own: tuple[str, ...] = ()  # receivers that mean the enclosing object
    exported: str = ""  # what a head has to hold
    signature: int = 200
    bare_calls_own: bool = False


_NAME = r"[A-Za-z_$][\w$]*"
_KEYWORDS = set("if for while switch catch return new sizeof else do try match loop func fn function async await throw typeof super".split())

SPECS = (
    Spec(
        "typescript", (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"),
        classes=rf"(?P<head>(?:export\s+)?(?:default\s+)?(?:abstract\s+)?)class\s+(?P<name>{_NAME})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<bases>[\w$.]+))?[^{{;]*\{{",
        functions=rf"(?P<head>(?:export\s+)?(?:default\s+)?(?:async\s+)?)function\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^(]*>)?\([^)]*\)[^{{;]*\{{|^[ \t]*(?P<head2>(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*)(?P<name2>{_NAME})\s*(?:<[^(]*>)?\([^)]*\)\s*(?::[^{{;=]+)?\{{",
        branches=r"\b(?:if|for|while|catch|case)\b|\?(?![.?:])|&&|\|\|", imports=(r"(?m)^\s*import\b[^'\"\n]*['\"](?P<module>[^'\"]+)['\"]",),
        types=rf"(?P<head>(?:export\s+)?)(?:interface|type)\s+(?P<name>{_NAME})", own=("this",),
    ),
    Spec(
        "go", (".go",), classes=rf"(?m)^type\s+(?P<name>{_NAME})\s+struct\s*\{{", functions=rf"(?m)^func\s+(?:\(\s*\w+\s+\*?(?P<owner>{_NAME})[^)]*\)\s*)?(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\([^{{]*\{{",
        branches=r"\b(?:if|for|case)\b", imports=(r"(?m)^import\s+(?:\w+\s+)?\"(?P<module>[^\"]+)\"", r"(?m)^\s+(?:[\w.]+\s+)?\"(?P<module>[^\"\n]+)\"\s*$"), types=rf"(?m)^type\s+(?P<name>{_NAME})\s+(?!struct\b)", exported="Upper",
    ),
    Spec(
        "rust", (".rs",), classes=rf"(?P<head>(?:pub(?:\([^)]*\))?\s+)?)(?:struct|enum)\s+(?P<name>{_NAME})[^;{{(]*[{{;(]", functions=rf"(?P<head>(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?)fn\s+(?P<name>{_NAME})[^;{{]*\{{",
        branches=r"\b(?:if|while|for|loop)\b|=>", imports=(r"(?m)^\s*(?:pub\s+)?use\s+(?P<module>[^;]+);",), types=rf"(?P<head>(?:pub(?:\([^)]*\))?\s+)?)(?:trait|type)\s+(?P<name>{_NAME})",
        owners=rf"\bimpl(?:<[^{{]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<name>{_NAME})[^{{;]*\{{", implements=rf"\bimpl(?:<[^{{]*?>)?\s+(?P<trait>[\w:]+)(?:<[^{{]*?>)?\s+for\s+(?P<name>{_NAME})", own=("self", "Self"), exported="pub",
    ),
    Spec(
        "java", (".java",), classes=rf"(?P<head>(?:(?:public|private|protected|abstract|static|final)\s+)*)(?:class|interface|enum|record)\s+(?P<name>{_NAME})(?:<[^{{]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.<>, ]+?))?(?:\s+implements\s+(?P<traits>[\w.<>, ]+?))?\s*\{{",
        functions=rf"(?m)^[ \t]*(?P<head>(?:(?:public|private|protected|abstract|static|final|synchronized|default)\s+|@\w+\s+)*)(?:<[^>]+>\s*)?(?:[\w.<>\[\], ?]+\s+)?(?P<name>{_NAME})\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\{{",
        branches=r"\b(?:if|for|while|do|catch|case)\b|\?(?![.?:>,])", imports=(r"(?m)^\s*import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;",), own=("this",), exported="public", signature=250, bare_calls_own=True,
    ),
    Spec(
        "c", (".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hh", ".hxx"), classes=rf"\b(?:class|struct|enum(?:\s+class)?)\s+(?P<name>{_NAME})(?:\s+final)?(?:\s*:\s*(?P<bases>[^{{;]+))?\s*\{{",
        functions=rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?P<head>(?:[\w:<>,*&~]+\s+)*?[*&]*)(?:(?P<owner>{_NAME})::)?(?P<name>~?{_NAME})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?::[^{{;]+)?\{{",
        branches=r"\b(?:if|for|while|do|switch|case|catch)\b|\?(?![?:])", imports=(r"(?m)^\s*#\s*include\s*[<\"](?P<module>[^>\"]+)[>\"]",), own=("this",), exported="not static", signature=250,
    ),
)
CPP = {".cpp", ".hpp", ".cc", ".cxx", ".hh", ".hxx"}


def blank(text: str) -> str:
    """The text with comments and strings as spaces, line ends kept; quotes of Rust lifetimes stay."""
    pattern = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _end(code: str, brace: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, brace):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(code) - 1


def _doc(lines: list[str], line: int) -> str | None:
    """The comment that ends right above a line: ``//`` lines or one block; attributes between are skipped."""
    at, found = line - 2, []
    while at >= 0 and line - at <= 20:
        text = lines[at].strip()
        if text.startswith(("#[", "@")) and not found:
            at -= 1
            continue
        if text.startswith("//"):
            found.insert(0, text.lstrip("/!").strip())
        elif text.endswith("*/"):
            while at >= 0:
                found.insert(0, lines[at].strip().strip("/*").strip())
                if "/*" in lines[at]:
                    break
                at -= 1
            break
        else:
            break
        at -= 1
    return " ".join(x for x in found if x)[:512] or None


def _exported(spec: Spec, name: str, head: str) -> bool:
    if spec.exported == "Upper":
        return name[:1].isupper()
    if spec.exported == "not static":
        return "static" not in head.split()
    return not spec.exported or spec.exported in head


def parse(path: str, source: bytes, spec: Spec) -> Parsed:
    suffix = path[path.rfind(".") :].lower()
    out, text = start_file(path, "cpp" if suffix in CPP else "javascript" if spec.lang == "typescript" and suffix not in (".ts", ".tsx") else spec.lang, source)
    code, lines = blank(text), text.splitlines()
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line_of = lambda at: bisect_right(starts, at)
    spans: list[tuple[int, int, str]] = []

    for m in re.finditer(spec.classes, code):
        name, brace = m["name"], m.end() - 1
        close = _end(code, brace) if code[brace] == "{" else m.end()
        start = line_of(m.start() + len(m[0]) - len(m[0].lstrip()))
        groups = m.groupdict()
        bases = [re.sub(r"\b(?:public|private|protected|virtual)\b|<.*", "", b).strip() for b in (groups.get("bases") or "").split(",") if b.strip()]
        if spec.lang == "go":
            bases = re.findall(r"(?m)^\s*\*?(\w+)\s*$", code[brace + 1 : close])
        made = out.symbol("class", name, start, line_of(close), bases=bases, docstring=_doc(lines, start), is_abstract="abstract" in (groups.get("head") or ""), is_dataclass=False, is_exported=_exported(spec, name, groups.get("head") or ""))
        out.edge(out.file_id, made, "defines")
        if spec.lang in ("go", "typescript"):
            for base in bases:
                out.edge(made, f"class:?::{base.split('.')[-1]}", "inherits", resolved=False)
        for trait in (groups.get("traits") or "").split(","):
            if trait.strip():
                out.edge(made, f"type:{path}::{trait.strip().split('<')[0]}", "implements")
        spans.append((m.start(), close, name))
    for m in re.finditer(spec.owners, code):
        spans.append((m.start(), _end(code, m.end() - 1), m["name"]))
    for m in re.finditer(spec.implements, code):
        out.edge(f"class:{path}::{m['name']}", f"type:{path}::{m['trait'].split('::')[-1]}", "implements")
    for m in re.finditer(spec.types, code):
        if spec.lang != "typescript" or suffix in (".ts", ".tsx"):
            start = line_of(m.start("name"))
            out.symbol("type", m["name"], start, definition=lines[start - 1].strip()[:200], is_exported=_exported(spec, m["name"], m.groupdict().get("head") or ""), docstring=_doc(lines, start))

    heads = []
    for m in re.finditer(spec.functions, code, re.M):
        groups = m.groupdict()
        which = "name" if groups["name"] else "name2"
        name, head = groups[which], groups.get("head" if which == "name" else "head2") or ""
        inside = [s for s in spans if s[0] < m.start(which) < s[1]]
        if name in _KEYWORDS or which == "name2" and not inside:
            continue
        owner = groups.get("owner") or (min(inside, key=lambda s: s[1] - s[0])[2] if inside else None)
        start, brace = line_of(m.start(which)), m.end() - 1
        close = _end(code, brace)
        says = re.sub(r"\s+", " ", text[m.start() : brace]).strip()[: spec.signature]
        qualified = f"{owner}.{name}" if owner else name
        body = code[brace : close + 1]
        made = out.symbol("function", name, start, line_of(close), qualified_name=qualified, signature=says, docstring=_doc(lines, start), complexity=1 + len(re.findall(spec.branches, body)), is_async="async" in head.split(), is_property=False, is_classmethod=False, is_staticmethod="static" in head.split(), is_exported=_exported(spec, name, head))
        heads.append(m.start(which))
        if owner:
            out.edge(f"class:{path}::{owner}", made, "defines")
        if not owner or spec.lang != "typescript":
            out.edge(out.file_id, made, "defines")
    for pattern in spec.imports:
        for m in re.finditer(pattern, re.sub(r"//[^\n]*|/\*.*?\*/", lambda c: re.sub(r"[^\n]", " ", c[0]), text, flags=re.S)):
            module = re.sub(r"\s+", "", m["module"]) if spec.lang == "rust" else m["module"]
            relative = spec.lang == "typescript" and module.startswith(".")
            out.edge(out.file_id, f"file:{module}" if relative else f"module:{module}", "imports", line=line_of(m.start("module")), module=module, is_relative=relative, is_star=module.endswith("*"))

    def sites():
        taken = set(heads)
        for m in re.finditer(rf"(?:(?P<on>[\w$\])]+)\s*(?:\.|->|::)\s*)?(?P<name>{_NAME})\s*\(", code):
            if m.start("name") in taken or m["name"] in _KEYWORDS:
                continue
            scope = "self" if m["on"] in spec.own and m["on"] else "attr" if m["on"] else "self" if spec.bare_calls_own else "free"
            yield m["name"], line_of(m.start("name")), scope

    add_calls(out, sites())
    return out
