"""Breadth-first walks over edges, with the frontier deduplicated at each step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import bare_path
from ..storage import cut

def reach(edges: DataFrame, starts: DataFrame, depth: int, kinds: Sequence[str] | None = None, reverse: bool = True) -> DataFrame:
    """(start, node_id, depth): the nodes that a walk of 1 to ``depth`` edges reaches from each start, at their least depth.

    A start is among them iff it lies on a cycle. ``starts`` has a column node_id; walks of different starts share the joins. Each
    step reads the edges once, keeps those that leave the new nodes, and takes away what was met before; repeated edges are
    dropped afterwards, among those few. What a step finds is written down, so plans don't grow, and Spark, which then knows its
    size, broadcasts it where it is small.
    """
    here, there = ("dst", "src") if reverse else ("src", "dst")
    kept = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    hops = kept.select(F.col(here).alias("at"), F.col(there).alias("node_id"))
    frontier = starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("at")).distinct()
    seen = None
    for step in range(1, depth + 1):
        new = hops.join(frontier, "at").select("start", "node_id").distinct()
        if seen is not None:
            new = new.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
        new = new.withColumn("depth", F.lit(step))
        if step < depth:
            new = cut(new)
        seen = new if seen is None else seen.unionByName(new)
        if step < depth and new.isEmpty():
            break
        frontier = new.select("start", F.col("node_id").alias("at"))
    return seen if seen is not None else frontier.select("start", F.col("at").alias("node_id"), F.lit(0).alias("depth")).limit(0)


def _one(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(node_id).alias("node_id"))


def callers(edges: DataFrame, function: str, depth: int = 1) -> DataFrame:
    return reach(edges, _one(edges, function), depth, ["calls"]).select("node_id", "depth")


def direct_callers(edges: DataFrame, function: str) -> DataFrame:
    return edges.where((F.col("kind") == "calls") & (F.col("dst") == function)).select(F.col("src").alias("node_id"))


def direct_callees(edges: DataFrame, function: str) -> DataFrame:
    return edges.where((F.col("kind") == "calls") & (F.col("src") == function)).select(F.col("dst").alias("node_id"))


def caller_details(edges: DataFrame, nodes: DataFrame, function: str, depth: int = 1) -> DataFrame:
    """Callers with their nodes; an unknown caller has nulls."""
    return callers(edges, function, depth).join(nodes.select("node_id", "kind", "name", "file", "line_start"), "node_id", "left")


def file_dependencies(edges: DataFrame, file: str, depth: int = 2, inclusive: bool = False) -> DataFrame:
    """Files that imports lead to in fewer than ``depth`` steps, or up to ``depth`` if ``inclusive``; never the file itself."""
    steps = depth if inclusive else depth - 1
    if steps < 1:
        return edges.select(F.col("src").alias("node_id")).limit(0)
    return reach(edges, _one(edges, file), steps, ["imports"], reverse=False).where(F.col("node_id") != file).select("node_id")


def dependencies(edges: DataFrame, file: str, depth: int = 2, inclusive: bool = False) -> DataFrame:
    """(target, how, direct_count): direct imports and the transitive ones of :func:`file_dependencies`, without their prefixes."""
    direct = edges.where((F.col("kind") == "imports") & (F.col("src") == file)).select(F.col("dst").alias("node_id")).distinct()
    strip = F.regexp_replace("node_id", "^(file|module):", "")
    count = direct.agg(F.count(F.lit(1)).alias("direct_count"))
    both = direct.select(strip.alias("target"), F.lit("direct").alias("how")).unionByName(file_dependencies(edges, file, depth, inclusive).select(strip.alias("target"), F.lit("transitive").alias("how")))
    return both.join(F.broadcast(count), F.lit(True), "left")  # one row


def importers(edges: DataFrame, file: str, limit: int = 10) -> DataFrame:
    return edges.where((F.col("kind") == "imports") & (F.col("dst") == file)).select(bare_path(F.col("src")).alias("file")).distinct().orderBy("file").limit(limit)


def imported(edges: DataFrame, file: str, limit: int = 10) -> DataFrame:
    return edges.where((F.col("kind") == "imports") & (F.col("src") == file)).select(F.regexp_replace("dst", "^(file|module):", "").alias("file")).distinct().orderBy("file").limit(limit)


IMPACT_KINDS = ("calls", "tests", "imports")


def impact(edges: DataFrame, nodes: DataFrame, symbol: str, depth: int = 3, kinds: Sequence[str] = IMPACT_KINDS) -> DataFrame:
    """The nodes affected by a change of ``symbol``: (node_id, kind, file, depth); unknown ones have null kind and file."""
    found = reach(edges, _one(edges, symbol), depth, kinds).select("node_id", "depth")
    return found.join(nodes.select("node_id", "kind", "file"), "node_id", "left")


def impact_summary(affected: DataFrame) -> DataFrame:
    """One row: how many nodes, distinct non-empty files and tests an impact holds; blast_radius is the first of them."""
    return affected.agg(
        F.count(F.lit(1)).alias("affected"),
        F.count_distinct(F.when(F.coalesce("file", F.lit("")) != "", F.col("file"))).alias("affected_files"),
        F.count_if(F.coalesce("kind", F.lit("")) == "test").alias("affected_tests"),
        F.count(F.lit(1)).alias("blast_radius"),
    )


# What counts as a test file where nothing else says so.
TEST_FILE = "(?i)test"


def file_impact(edges: DataFrame, nodes: DataFrame, symbol: str, depth: int = 3) -> DataFrame:
    """(node_id, file, is_test) of what calls or inherits from ``symbol``, in up to ``depth`` steps; the ids are its blast radius."""
    found = impact(edges, nodes, symbol, depth, ("calls", "inherits")).select("node_id", bare_path(F.coalesce("file", F.lit(""))).alias("file"))
    marked = nodes.select("node_id", F.coalesce("is_test", F.lit(False)).alias("marked"))
    return found.join(marked, "node_id", "left").select("node_id", "file", (F.coalesce("marked", F.lit(False)) | F.col("file").rlike(TEST_FILE)).alias("is_test"))
