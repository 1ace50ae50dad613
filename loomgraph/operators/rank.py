"""PageRank, churn and the rankings built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import bare_path
from ..storage import cut, release

ALPHA, ITERATIONS, TOLERANCE = 0.85, 100, 1e-6
STRUCTURAL = ("imports", "inherits", "implements", "defines")


def rank_edges(edges: DataFrame) -> DataFrame:
    """The calls, or the structural edges if there are no calls; one plan, one row decides."""
    has = edges.where("kind = 'calls'").limit(1).agg((F.count(F.lit(1)) > 0).alias("has_calls"))
    kept = edges.where(F.col("kind").isin("calls", *STRUCTURAL)).join(F.broadcast(has), F.lit(True), "left")  # one row
    return kept.where((F.col("kind") == "calls") == F.col("has_calls")).select("src", "dst")


def pagerank(edges: DataFrame, alpha: float = ALPHA, iterations: int = ITERATIONS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """(node_id, pagerank) of all ends of ``edges`` (src, dst), repeated edges counting as often as they come.

    Power iteration from equal ranks; what nodes without out-edges hold is spread evenly. Stops when the ranks change by less
    than ``tolerance`` in sum, or after ``iterations``.

    Edges are combined and counted once, and nodes numbered, so that steps join and sum numbers. A step is one join and one sum, written
    down, so all steps have the same plan; a target with very many in-edges is summed before the shuffle, and two numbers come to the driver.
    """
    counted = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("times")))
    both = counted.select(F.col("src").alias("node_id"), F.col("times").alias("outs")).unionByName(counted.select(F.col("dst").alias("node_id"), F.lit(0.0).alias("outs")))
    ends = cut(both.groupBy("node_id").agg(F.sum("outs").alias("outs")).withColumn("id", F.monotonically_increasing_id()))
    source, target = ends.select(F.col("node_id").alias("src"), F.col("id").alias("from_id"), "outs"), ends.select(F.col("node_id").alias("dst"), F.col("id").alias("to_id"))
    shares = cut(counted.join(source, "src").join(target, "dst").select("from_id", "to_id", (F.col("times") / F.col("outs")).alias("share")))
    release(counted)
    n, idle = ends.agg(F.count(F.lit(1)), F.count_if(F.col("outs") == 0)).first()
    if not n:
        return ends.select("node_id", F.lit(0.0).alias("pagerank"))
    ranks, lost = ends.select("id", (F.col("outs") > 0).alias("leads"), F.lit(1.0 / n).alias("pagerank")), idle / n
    for _ in range(iterations):
        given = ranks.join(shares, F.col("id") == F.col("from_id")).groupBy("to_id").agg(F.sum(F.col("pagerank") * F.col("share")).alias("given"))
        base = (1.0 - alpha) / n + alpha * lost / n
        new = ranks.join(given, F.col("id") == F.col("to_id"), "left")
        last = ranks
        ranks = cut(new.select("id", "leads", F.col("pagerank").alias("before"), (base + alpha * F.coalesce("given", F.lit(0.0))).alias("pagerank")))
        release(last)
        moved, lost = ranks.agg(F.sum(F.abs(F.col("pagerank") - F.col("before"))), F.coalesce(F.sum(F.when(~F.col("leads"), F.col("pagerank"))), F.lit(0.0))).first()
        if tolerance is not None and moved < tolerance:
            break
    release(shares)
    return ends.join(ranks.select("id", "pagerank"), "id").select("node_id", "pagerank")


def churn(commits: DataFrame, files: DataFrame, newest: int | None = 1000) -> DataFrame:
    """(file, commit_count) over the newest commits, of the files that ``files`` (path) knows.

    ``commits`` has sha, ts and files_changed; a commit counts once for a file.
    """
    kept = commits if newest is None else commits.orderBy(F.desc("ts"), "sha").limit(newest)
    touched = kept.select("sha", F.explode("files_changed").alias("file")).distinct()
    return touched.join(files.select(F.col("path").alias("file")), "file", "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("commit_count"))


def link_counts(file_commits: DataFrame) -> DataFrame:
    """(file, commit_count) of a table of (file, sha) links, repeated links counting once."""
    return file_commits.select("file", "sha").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("commit_count"))


def hot_paths(nodes: DataFrame, top: int = 20, weight: float = 0.01) -> DataFrame:
    """Functions and files by PageRank plus ``weight`` for each commit."""
    pagerank, commits = F.coalesce("pagerank", F.lit(0.0)), F.coalesce("commit_count", F.lit(0))
    scored = nodes.where(F.col("kind").isin("function", "file"))
    return scored.select("node_id", "kind", "name", pagerank.alias("pagerank"), commits.alias("commit_count"), (pagerank + weight * commits).alias("score")).orderBy(F.desc("score"), "node_id").limit(top)


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))


def top_modules(nodes: DataFrame, edges: DataFrame, top: int = 60) -> DataFrame:
    """Files by commits plus twice their in-edges of every kind, modifications included."""
    files = nodes.where("kind = 'file'").join(in_degrees(edges), "node_id", "left")
    score = F.coalesce("commit_count", F.lit(0)) + 2 * F.coalesce("in_degree", F.lit(0))
    return files.select("node_id", "path", "lang", score.alias("score")).orderBy(F.desc("score"), "node_id").limit(top)


def key_classes(nodes: DataFrame, edges: DataFrame, top: int = 40) -> DataFrame:
    """Classes by the number of those that inherit from them."""
    subclasses = edges.where("kind = 'inherits'").groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("subclasses"))
    classes = nodes.where("kind = 'class'").join(subclasses, "node_id", "left")
    return classes.select("node_id", "name", bare_path(F.col("file")).alias("file"), F.coalesce("subclasses", F.lit(0)).alias("subclasses")).orderBy(F.desc("subclasses"), "node_id").limit(top)


def kind_counts(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of every kind, zero where there are none."""
    every = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def adjacency(edges: DataFrame, by: str = "dst") -> DataFrame:
    """Edges written down in ranges of an end, so that walks that look for few of them skip the other files."""
    return cut(edges.repartitionByRange(by).sortWithinPartitions(by))
