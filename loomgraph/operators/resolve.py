"""Cross-file resolution of names that parsers left open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_calls(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls of ``func:?::name`` bound to a function, or gone; other edges as they are. Adds rule: own, unique, same_file.

    First a call through self goes to the caller's own class, then a name that one function has to that one, then
    one that one function of the caller's file has. A call that would bind to its caller is dropped, as is one that
    stays ambiguous. ``functions``: node_id, name, qualified_name, file.
    """
    named = functions.select("node_id", "name", "qualified_name", "file")
    unique = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("unique_id")).where("n = 1").select(F.col("name").alias("callee"), "unique_id")
    same = named.groupBy("name", "file").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("same_id")).where("n = 1").select(F.col("name").alias("callee"), F.col("file").alias("src_file"), "same_id")
    callers = named.select(F.col("node_id").alias("src"), F.col("qualified_name").alias("src_name"), F.col("file").alias("src_file"))
    is_open = (F.col("kind") == "calls") & F.col("dst").startswith("func:?::")
    calls = edges.where(is_open).withColumn("callee", F.regexp_replace("dst", r"^func:\?::", ""))
    placed = calls.join(callers, "src", "left")
    prefix = F.regexp_extract("src", "^(func:[^:]*::)", 1)
    owner = F.regexp_extract("src_name", r"^(.*)\.[^.]*$", 1)
    own = F.when(F.coalesce("self_call", F.lit(False)) & (owner != ""), F.concat(prefix, owner, F.lit("."), F.col("callee")))
    known = functions.select(F.col("node_id").alias("own_id"))
    joined = placed.withColumn("own_id", own).join(known.withColumn("own_found", F.lit(True)), "own_id", "left").join(unique, "callee", "left").join(same, ["callee", "src_file"], "left")
    by_own = F.col("own_found") & (F.col("own_id") != F.col("src"))
    target = F.when(by_own, F.col("own_id")).when(F.col("unique_id").isNotNull(), F.col("unique_id")).otherwise(F.col("same_id"))
    rule = F.when(by_own, "own").when(F.col("unique_id").isNotNull(), "unique").otherwise("same_file")
    bound = joined.withColumn("dst", target).withColumn("rule", rule).where("dst is not null and dst != src").withColumn("resolved", F.lit(True))
    return bound.select(*edges.columns, "rule").unionByName(edges.where(~is_open).withColumn("rule", F.lit(None).cast("string")))


def resolve_inherits(edges: DataFrame, classes: DataFrame, drop_ambiguous: bool = False) -> DataFrame:
    """``class:?::N`` bound to the one class of that name; left open, or dropped, where there is none or several."""
    unique = classes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("unique_id")).where("n = 1").select(F.col("name").alias("base"), "unique_id")
    is_open = F.col("dst").startswith("class:?::")
    joined = edges.where(is_open).withColumn("base", F.regexp_replace("dst", r"^class:\?::", "")).join(unique, "base", "left")
    joined = joined.withColumn("resolved", F.col("unique_id").isNotNull()).withColumn("dst", F.coalesce("unique_id", "dst"))
    kept = joined.where("unique_id is not null") if drop_ambiguous else joined
    return kept.select(*edges.columns).unionByName(edges.where(~is_open))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, kind): a call through self stays one, of other details the latest line's hold."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "kind", "self_call")]
    latest = F.max_by(F.struct(*rest), F.coalesce("line", F.lit(-1))).alias("latest")
    return edges.groupBy("src", "dst", "kind").agg(F.bool_or("self_call").alias("self_call"), latest).select("src", "dst", "kind", "latest.*", "self_call").select(*edges.columns)
