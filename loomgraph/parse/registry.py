"""Parsers by extension, and the table function that runs them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import Raw
from . import braces, python
from .records import EDGE_FIELDS, NODE_FIELDS, TODO_FIELDS, Parsed, start_file

Parser = Callable[[str, bytes], Parsed]


def generic(path: str, source: bytes) -> Parsed:
    """The file and its marks; the language is the extension."""
    name = path.rsplit("/", 1)[-1]
    return start_file(path, name.rsplit(".", 1)[1].lower() if "." in name else "text", source)[0]


class Registry:
    """The first parser registered for a file's extension, else the generic one."""

    def __init__(self):
        self.parsers: list[tuple[tuple[str, ...], Parser]] = []

    def register(self, extensions: tuple[str, ...], parser: Parser) -> Registry:
        self.parsers.append((extensions, parser))
        return self

    def of(self, path: str) -> Parser:
        return next((p for extensions, p in self.parsers if path.lower().endswith(extensions)), generic)

    def parse(self, path: str, source: bytes) -> Parsed:
        """A parser that breaks leaves the file's own row and the error."""
        try:
            return self.of(path)(path, source)
        except Exception as e:  # noqa: BLE001  a parser may be anybody's
            out = generic(path, source)
            out.errors.append(f"{type(e).__name__}: {e}")
            return out


def default_registry() -> Registry:
    registry = Registry().register((".py", ".pyi"), python.parse)
    for spec in braces.SPECS:
        registry.register(spec.extensions, partial(braces.parse, spec=spec))
    return registry


def _fill(rows: list[dict], fields: str) -> list[dict]:
    names = [f.split()[0] for f in fields.replace("\n", " ").split(", ")]
    return [{n: row.get(n) for n in names} for row in rows]


def parse_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(path, nodes, edges, todos, errors) of files (path, content), each parsed where it lies."""
    chosen = registry or default_registry()
    schema = f"path string, nodes array<struct<{NODE_FIELDS.replace(' string', ':string').replace(' int', ':int').replace(' bigint', ':bigint').replace(' boolean', ':boolean').replace(' array<string>', ':array<string>')}>>, "
    schema += f"edges array<struct<{EDGE_FIELDS.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>, todos array<struct<{TODO_FIELDS.replace(' string', ':string').replace(' int', ':int')}>>, errors array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [chosen.parse(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": [d.path for d in done], "nodes": [_fill(d.nodes, NODE_FIELDS) for d in done], "edges": [_fill(d.edges, EDGE_FIELDS) for d in done], "todos": [_fill(d.todos, TODO_FIELDS) for d in done], "errors": [d.errors for d in done]})

    return files.select("path", "content").mapInPandas(run, schema)


def raw_tables(parsed: DataFrame) -> Raw:
    """The parsed rows as tables keyed by the path they come from."""
    nodes, edges, todos = (parsed.select("path", F.explode(c).alias("r")) for c in ("nodes", "edges", "todos"))
    of_file = nodes.select("r.*")
    files = of_file.where("kind = 'file'").select("path", "lang", "sha256", "line_count")
    strip = lambda df: df.select("path", "r.*")
    return Raw(nodes.select("path", "r"), strip(edges), strip(todos), files)

