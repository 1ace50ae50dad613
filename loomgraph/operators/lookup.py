"""Filters and point lookups over nodes, edges and todos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import bare_path
from .search import match


def locate(nodes: DataFrame) -> DataFrame:
    """Nodes as symbol locations; the file falls back to the path."""
    return nodes.select("node_id", "kind", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("file", "path", F.lit("")).alias("file"), F.coalesce("line_start", F.lit(0)).alias("line_start"), "signature", "docstring")


def by_kind(nodes: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    return nodes if kinds is None else nodes.where(F.col("kind").isin(*kinds))


def by_name(nodes: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    found = nodes.where(F.col("name") == name)
    return found if kind is None else found.where(F.col("kind") == kind)


def by_prefix(nodes: DataFrame, prefix: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Names like ``prefix%``, whatever their case; ``_`` and ``%`` in the prefix stand for any character or text."""
    found = nodes.where(F.col("name").ilike(prefix + "%"))
    found = found if kind is None else found.where(F.col("kind") == kind)
    return found.orderBy("node_id").limit(limit)


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id).limit(1)


def config_value(config: DataFrame, key: str, default: str = "") -> DataFrame:
    """One row, value, whether or not the key exists."""
    return config.where(F.col("key") == key).agg(F.coalesce(F.first("value"), F.lit(default)).alias("value"))


def find_definition(nodes: DataFrame, postings: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Exact name, else prefix (10), else full text (10, kinds filtered after the limit): the first that finds anything, with its priority.

    A later branch runs only if those before it found nothing.
    """
    exact = by_name(nodes, name, kind).withColumn("priority", F.lit(1))
    if not exact.isEmpty():
        return exact
    prefix = by_prefix(nodes, name, kind, 10).withColumn("priority", F.lit(2))
    if not prefix.isEmpty():
        return prefix
    hits = match(postings, name).orderBy("node_id").limit(10)
    text = nodes.join(hits, "node_id", "left_semi").withColumn("priority", F.lit(3))
    return text if kind is None else text.where(F.col("kind") == kind)


def find_symbol(nodes: DataFrame, postings: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    found = locate(find_definition(nodes, postings, name, kind))
    return found.select("node_id", "kind", "name", bare_path(F.col("file")).alias("file"), F.col("line_start").alias("line"), "signature", F.substring("docstring", 1, 200).alias("docstring"), F.count(F.lit(1)).over(Window.partitionBy()).alias("count"))


def resolve_symbol(nodes: DataFrame, postings: DataFrame, symbol: str) -> DataFrame:
    """One row, node_id: the symbol itself if it is an id, else the first definition found, else the symbol."""
    if ":" in symbol:
        return nodes.sparkSession.range(1).select(F.lit(symbol).alias("node_id"))
    return find_definition(nodes, postings, symbol).agg(F.coalesce(F.min("node_id"), F.lit(symbol)).alias("node_id"))


def best_ranked(nodes: DataFrame, symbol: str) -> DataFrame:
    """The node of that id, else the function or class of that name with the highest PageRank."""
    hits = nodes.where((F.col("node_id") == symbol) | (F.col("kind").isin("function", "class") & (F.col("name") == symbol)))
    return hits.orderBy((F.col("node_id") != symbol), F.coalesce("pagerank", F.lit(0.0)).desc(), "node_id").limit(1)


def public_api(nodes: DataFrame, file: str | None = None) -> DataFrame:
    """Public functions, classes and types; of methods, none."""
    kept = nodes.where(F.col("kind").isin("function", "class", "type") & ~F.coalesce("name", F.lit("")).startswith("_"))
    kept = kept.where((F.col("kind") == "class") | ~F.coalesce("qualified_name", F.lit("")).contains("."))
    kept = kept if file is None else kept.where(F.col("file") == file)
    return locate(kept)


def todos(table: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    kept = table if kind is None else table.where(F.col("kind") == kind.upper())
    return kept.orderBy("file", "line", "node_id", "text").limit(limit)


def file_symbols(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where(F.col("kind").isin("function", "class") & (F.col("file") == file)).orderBy("line_start", "node_id")


def enrichment_candidates(nodes: DataFrame, documented_too: bool = False) -> DataFrame:
    """Functions and classes without a summary and, unless ``documented_too``, without a docstring."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bare = nodes.where(F.col("kind").isin("function", "class") & empty("llm_summary"))
    return bare if documented_too else bare.where(empty("docstring"))


def batches(candidates: DataFrame, cached: DataFrame, key: Column, size: int = 20) -> DataFrame:
    """Candidates without a cached answer, numbered in batches; the numbering is local to hash ranges, so no task holds all."""
    missing = candidates.withColumn("cache_key", key).join(cached.select("cache_key"), "cache_key", "left_anti")
    parted = missing.withColumn("part", F.substring("cache_key", 1, 2))
    turn = F.row_number().over(Window.partitionBy("part").orderBy("cache_key", "node_id"))
    return parted.withColumn("batch", F.floor((turn - 1) / size))


def caller_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with the number of edges that call them, zero included."""
    called = edges.where("kind = 'calls'").groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("callers"))
    return nodes.where("kind = 'function'").select("node_id", "name").join(called, "node_id", "left").select("node_id", "name", F.coalesce("callers", F.lit(0)).alias("callers"))


def test_coverage(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """Tests of a symbol with their confidence, 0.0 where none is given; unknown tests have null names."""
    covering = edges.where((F.col("kind") == "tests") & (F.col("dst") == symbol)).select(F.col("src").alias("node_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return covering.join(nodes.select("node_id", "name", "file"), "node_id", "left").select("node_id", "name", "file", "confidence")


def edge_details(edges: DataFrame, kind: str, column: str = "meta") -> DataFrame:
    """Edges of a kind whose details, a JSON object in ``column``, can be read; the others are skipped."""
    whole = F.col(column).rlike(r"(?s)^\s*\{.*\}\s*$")  # the parser ignores what follows a value
    return edges.where((F.col("kind") == kind) & whole & F.try_parse_json(column).isNotNull())


def file_hash(files: DataFrame, path: str) -> DataFrame:
    """One row, sha256: what is stored of the file, null if it is unknown."""
    return files.where(F.col("path") == path).agg(F.first("sha256").alias("sha256"))
