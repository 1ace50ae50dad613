"""Scalar rules over names, paths and texts, all as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules below decide results, so they are the same as in the behaviour this library reproduces.
LAYER_RULES = (
    ("test", r"(?i)(^|/)tests?/|_test\.|test_|\.test\.|\.spec\."),
    ("data", r"(?i)(^|/)(migration|schema|model|entity|orm|dao|repository)\b"),
    ("presentation", r"(?i)(^|/)(route|handler|controller|view|template|api|endpoint|graphql|rest)\b"),
    ("business", r"(?i)(^|/)(service|usecase|business|domain|core|logic|workflow)\b"),
    ("infrastructure", r"(?i)(^|/)(infra|infrastructure|adapter|gateway|provider|client|driver)\b"),
    ("config", r"(?i)(^|/)(config|setting|env|constant)\b"),
    ("utility", r"(?i)(^|/)(util|helper|common|shared|lib|pkg)\b"),
)
EDITOR_LAYER_RULES = (
    ("test", r"(^|/)tests?/"),
    ("config", r"(?i)config|settings"),
    ("presentation", r"(^|/)(cli|mcp|api|server|web)"),
    ("data", r"(^|/)(graph|store|db|data)"),
)
PRIVATE, DOUBLE_PRIVATE = "^_[a-z]", "^__[a-z]"
NAMING_RULES = (
    ("UPPER_SNAKE", "^[A-Z][A-Z0-9_]+$"),
    ("PascalCase", "^[A-Z][a-zA-Z0-9]*$"),
    ("snake_case", "^[a-z][a-z0-9_]*$"),
    ("camelCase", "^[a-z][a-zA-Z0-9]*$"),
    ("dunder", "^__"),
    ("private", "^_"),
)
TODO_KINDS = ("TODO", "FIXME", "HACK", "NOTE", "XXX", "BUG")
TODO_PREFIX = {"python": r"#\s*", "typescript": r"[/*#]+\s*", "go": r"//\s*", "rust": r"//+\s*", "java": r"(?://+|\*)\s*", "c": r"(?://+|\*)\s*", "generic": r"[/#*]+\s*"}
TEST_PATHS = {
    "python": r"(?i)(^|/)tests?/|_test\.py$|test_.*\.py$",
    "typescript": r"(?i)(^|/)(tests?|__tests?__)/|\.test\.(ts|tsx|js|jsx)$|\.spec\.(ts|tsx|js|jsx)$",
    "go": r"_test\.go$",
    "rust": r"(?i)(^|/)tests?/|_test\.rs$",
    "java": r"(?i)(^|/)tests?/|Tests?\.java$",
    "c": r"(^|/)tests?/|[Tt]est[s]?\.|_test\.(c|cpp|cc|cxx|h|hpp)$",
}
THEMES: dict[str, tuple[str, ...]] = {
    "type_hints": (r"type hint", r"type annotation", r"add types?", r"missing types?", r"\btyping\b", r"\bmypy\b", r"\bpyright\b"),
    "error_handling": (r"error handling", r"exception", r"try[- ]?except", r"\bcatch\b", r"handle.{0,15}error", r"what if.{0,25}fail", r"edge case", r"invalid input"),
    "testing": (r"add test", r"test case", r"unit test", r"missing test", r"\bcoverage\b", r"\bmock\b", r"\bassert\b", r"\bfixture\b", r"not tested"),
    "documentation": (r"docstring", r"add doc", r"missing doc", r"documentation", r"explain", r"unclear", r"add comment", r"document this"),
    "naming": (r"naming", r"rename", r"better name", r"variable name", r"misleading", r"more descriptive", r"confusing name", r"abbrev"),
    "complexity": (r"complex", r"simplify", r"refactor", r"extract method", r"too long", r"too many", r"split this", r"\breadability\b"),
    "performance": (r"performance", r"\bslow\b", r"optimiz", r"efficient", r"\bn\+1\b", r"\bcache\b", r"unnecessary.{0,15}call", r"redundant"),
    "security": (r"security", r"injection", r"sanitiz", r"\bXSS\b", r"\bCSRF\b", r"\bauth\b", r"secret", r"password.{0,10}leak", r"token.{0,10}log"),
    "imports": (r"unused import", r"import.{0,10}order", r"circular import", r"absolute import", r"relative import"),
    "style": (r"\bstyle\b", r"\bformat\b", r"\blint\b", r"whitespace", r"\bpep8\b", r"\bflake8\b", r"\bblack\b", r"\bisort\b", r"trailing comma"),
}


def first_rule(value: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first rule whose pattern is found."""
    chain = F.lit(default)
    for name, pattern in reversed(rules):
        chain = F.when(value.rlike(pattern), name).otherwise(chain)
    return chain


def detect_layer(path: Column, rules: Sequence[tuple[str, str]] = LAYER_RULES) -> Column:
    return first_rule(F.coalesce(path, F.lit("")), rules, "unknown")


def naming_style(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(first_rule(name, NAMING_RULES, "other"))


def file_naming_style(path: Column) -> Column:
    """Style of a file's name up to its first dot."""
    stem = F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))
    first = F.substring(stem, 1, 1)
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(stem.contains("-"), "kebab-case").when(stem.contains("_"), "snake_case").when(upper, "PascalCase").when((F.lower(stem) == stem) & (F.upper(stem) != stem), "lowercase").otherwise("camelCase")


def is_private(name: Column) -> Column:
    return F.coalesce(name.rlike(PRIVATE), F.lit(False))


def is_double_private(name: Column) -> Column:
    return F.coalesce(name.rlike(DOUBLE_PRIVATE), F.lit(False))


def is_test_path(path: Column, lang: str = "python") -> Column:
    return path.rlike(TEST_PATHS[lang]) if lang in TEST_PATHS else F.lit(False)


def todo_pattern(lang: str = "generic", kinds: Sequence[str] = TODO_KINDS, prefix: str | None = None) -> str:
    """Groups: 1 the kind, 2 the text."""
    before = prefix if prefix is not None else TODO_PREFIX.get(lang, TODO_PREFIX["generic"])
    return rf"(?i){before}({'|'.join(kinds)})\b[:\s]*(.*)"


def match_themes(text: Column, themes: Mapping[str, Sequence[str]] = THEMES) -> Column:
    """Array of the themes, in their order, of which any pattern occurs; one alternation for each theme."""
    found = F.array(*(F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in themes.items()))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(found))


#: Lower-case letters with marks and the letters without, wherever Unicode takes one apart; one rule for Spark and SQL.
_APART = {chr(c): d[0] for c in range(0xC0, 0x1F00) if (d := unicodedata.normalize("NFD", chr(c))) and len(d) > 1 and chr(c) == chr(c).lower() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])}
MARKED, PLAIN = "".join(_APART), "".join(_APART.values())


def words(text: Column) -> Column:
    """Full-text tokens: runs of letters and digits, lower-cased, without marks; ``_`` separates."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def truncate(text: Column, n: int, ellipsis: str = "…", inside: bool = True) -> Column:
    """At most ``n`` characters; the ellipsis counts among them if ``inside``."""
    keep = n - len(ellipsis) if inside else n
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, keep), F.lit(ellipsis))).otherwise(text)


def cache_key(node_id: Column, signature: Column, docstring: Column) -> Column:
    return F.sha2(F.concat(node_id, F.lit("|"), F.coalesce(signature, F.lit("")), F.lit("|"), F.coalesce(docstring, F.lit(""))), 256)


def strip_fence(reply: Column) -> Column:
    """A model's reply without a Markdown code fence around it."""
    return F.regexp_replace(F.trim(reply), r"(?s)^```[a-zA-Z]*\s*(.*?)\s*```$", "$1")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def round_percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to even, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(100.0 * part / whole))


def parse_reply(reply: Column) -> Column:
    """A model's reply as a map of strings: without a fence around it, and empty if it is no JSON object."""
    empty = F.create_map().cast("map<string,string>")
    bare = strip_fence(F.coalesce(reply, F.lit("")))
    return F.when(bare.rlike(r"^\s*\{"), F.coalesce(F.from_json(bare, "map<string,string>"), empty)).otherwise(empty)


def date_of(epoch: Column) -> Column:
    """The UTC date of seconds since 1970."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(epoch), F.current_timezone()), "yyyy-MM-dd")


def minute_stamp(at: Column) -> Column:
    """A timestamp as notes carry it."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def prompt_entry(kind: Column, name: Column, qualified_name: Column, signature: Column, definition: Column, file: Column, docstring: Column) -> Column:
    """What a model is told of a symbol."""
    filled = lambda c: F.when(c != "", c)
    label = F.coalesce(filled(qualified_name), name, F.lit("?"))
    sign = F.coalesce(filled(signature), filled(definition), label)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.coalesce(kind, F.lit("symbol")), F.lit("] "), label),
        F.when(sign != label, F.concat(F.lit("   Signature: "), sign)),
        F.concat(F.lit("   File: "), F.coalesce(file, F.lit(""))),
        F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit("   Existing doc: "), F.substring(docstring, 1, 120))).otherwise("   (no existing documentation)"),
    )
