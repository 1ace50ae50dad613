"""Upserts and incremental refresh: raw rows by file are replaced, everything else is derived again."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new`` take the place of those with their key; ``new`` has each key once (see :func:`latest`)."""
    return table.join(new.select(*key).distinct(), list(key), "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def latest(rows: DataFrame, order: Column, *key: str) -> DataFrame:
    """The last row of each key by ``order``; combines before the shuffle."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("row"))
    return best.select("row.*")


def delete_keys(table: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    return table.join(gone.select(*key).distinct(), list(key), "left_anti")


def set_attribute(nodes: DataFrame, updates: DataFrame, attribute: str) -> DataFrame:
    """``updates``: node_id and the attribute; nodes without an update keep theirs."""
    new = updates.select("node_id", F.col(attribute).alias("_new"))
    return nodes.join(new, "node_id", "left").withColumn(attribute, F.coalesce("_new", attribute)).drop("_new").select(*nodes.columns)


def append_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new.select(*links.columns)).dropDuplicates(["file", "sha"])


def changed(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming files (path, sha256) that aren't known with that hash."""
    return incoming.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")


@dataclass
class Raw:
    """What parsing gave, by file: nodes and edges (with a column path), todos, files."""

    nodes: DataFrame
    edges: DataFrame
    todos: DataFrame
    files: DataFrame


def replace_files(raw: Raw, parsed: Raw, deleted: DataFrame) -> Raw:
    """``parsed`` rows stand for the files they come from; rows of those and of ``deleted`` (path) go, todos and edges too.

    Applying the same update again changes nothing.
    """
    gone = parsed.files.select("path").unionByName(deleted.select("path")).distinct()
    swap = lambda old, new: old.join(gone, "path", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    return replace(raw, nodes=swap(raw.nodes, parsed.nodes), edges=swap(raw.edges, parsed.edges), todos=swap(raw.todos, parsed.todos), files=swap(raw.files, parsed.files))


def counters(parsed_errors: DataFrame, changed_files: DataFrame, deleted: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: commits_processed, files_updated, files_deleted, errors of an update."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [n(commits, "commits_processed"), n(changed_files, "files_updated"), n(deleted, "files_deleted"), n(parsed_errors, "errors")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy().pivot("name", ["commits_processed", "files_updated", "files_deleted", "errors"]).agg(F.first("n"))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A bulk write that Spark's commit protocol makes visible as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def first_per_group(rows: DataFrame, k: int, order: list[Column], *group: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("k", turn).where(F.col("k") <= k)


def innermost(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``lines`` (file, line) with the node_id of the tightest span (file, line_start, line_end, node_id) around each, the
    earliest where spans tie, null outside all."""
    held = lines.join(spans.withColumnRenamed("file", "span_file"), (F.col("file") == F.col("span_file")) & F.col("line").between(F.col("line_start"), F.col("line_end")), "left")
    tight = F.struct(F.col("line_end") - F.col("line_start"), F.col("line_start"), F.col("node_id"))
    return held.groupBy("file", "line").agg(F.min_by("node_id", tight).alias("node_id"))
