"""Integrity of the stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end has no node; modules, commits and names that are still open don't count."""
    real = edges.where("src not like 'module:%' and src not like 'commit:%' and dst not like 'module:%' and dst not like 'commit:%' and dst not like '%:?::%'")
    ids = nodes.select("node_id").distinct()
    flagged = real.select("src", "dst", "kind").join(ids.select(F.col("node_id").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(ids.select(F.col("node_id").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    return flagged.where("has_src is null or has_dst is null").select("src", "dst", "kind").distinct()


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def doctor(nodes: DataFrame, edges: DataFrame, postings: DataFrame, config: DataFrame, head: str | None = None) -> DataFrame:
    """(check, problems): zero problems everywhere is a healthy graph."""
    named, indexed = nodes.where("name is not null").select("node_id"), postings.select("node_id").distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("problems")).select(F.lit(name).alias("check"), "problems")
    checks = [n(duplicate_keys(nodes, "node_id"), "node_keys"), n(duplicate_keys(edges, "src", "dst", "kind"), "edge_keys"), n(orphan_edges(edges, nodes), "orphan_edges"), n(indexed.join(named, "node_id", "left_anti"), "stale_index")]
    if head is not None:
        last = config.where("key = 'last_indexed_sha'").agg(F.coalesce(F.first("value"), F.lit("")).alias("value"))
        checks.append(last.select(F.lit("freshness").alias("check"), F.when(F.col("value") == head, 0).otherwise(1).cast("long").alias("problems")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def drop_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(orphan_edges(edges, nodes), ["src", "dst", "kind"], "left_anti")
