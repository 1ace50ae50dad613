"""Kinds, ids and table schemas of the source graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_KINDS = ("repo", "file", "module", "class", "function", "type", "test", "commit")
EDGE_KINDS = ("imports", "defines", "calls", "inherits", "implements", "tests", "modifies", "exports", "contains", "depends_on", "resolves_to")

#: One wide table of nodes; what a kind doesn't have is null. Partition it by kind on disk.
NODES = """node_id string, kind string, name string, qualified_name string, file string, path string, lang string, line_start int, line_end int,
line_count int, size_bytes bigint, sha256 string, signature string, docstring string, llm_summary string, bases array<string>, definition string,
layer string, complexity int, pagerank double, commit_count bigint, is_test boolean, is_async boolean, is_property boolean, is_classmethod boolean,
is_staticmethod boolean, is_abstract boolean, is_dataclass boolean, is_exported boolean"""
EDGES = """src string, dst string, kind string, line int, module string, is_relative boolean, is_star boolean, resolved boolean, callee string,
self_call boolean, confidence double"""
TODOS = "node_id string, file string, line int, kind string, text string"
COMMITS = "sha string, short_sha string, author string, author_email string, ts bigint, message string, files_changed array<string>"
FILE_COMMITS = "file string, sha string"
FILES = "path string, lang string, sha256 string, last_analyzed bigint, line_count int"
REVIEW_COMMENTS = "pr int, source string, login string, path string, body string"
SYMBOLS = "kind string, name string, qualified_name string, file string, signature string, is_async boolean, complexity int, bases array<string>, is_abstract boolean"


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(prefix: str, path: Column, name: Column) -> Column:
    """``func``, ``class`` or ``type`` id of a name in a file."""
    return F.concat(F.lit(f"{prefix}:"), path, F.lit("::"), name)


def bare_path(file: Column) -> Column:
    """A file id without its prefix."""
    return F.regexp_replace(file, "^file:", "")
