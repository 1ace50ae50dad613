"""Symbol-level differences between two states, and who is affected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPLEXITY_STEP = 3


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, qualified_name, file, change_type, detail) of added, removed and modified symbols.

    Functions are the same by qualified name, classes and types by name, within a file. A function is modified if its
    signature or async flag changed or its complexity by 3 or more; a class if its bases or abstract flag did; types never.
    """
    key = F.when(F.col("kind") == "function", F.col("qualified_name")).otherwise(F.col("name"))
    b = before.select(F.col("kind"), F.col("file"), key.alias("key"), F.struct("name", "qualified_name", "signature", "is_async", "complexity", "bases", "is_abstract").alias("b"))
    a = after.select(F.col("kind"), F.col("file"), key.alias("key"), F.struct("name", "qualified_name", "signature", "is_async", "complexity", "bases", "is_abstract").alias("a"))
    both = b.join(a, ["kind", "file", "key"], "full_outer")
    changed = lambda c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    old, new = F.coalesce("b.complexity", F.lit(1)), F.coalesce("a.complexity", F.lit(1))
    of_function = [
        F.when(changed("signature"), "signature changed"),
        F.when(changed("is_async"), "async changed"),
        F.when(F.abs(new - old) >= COMPLEXITY_STEP, F.concat(F.lit("complexity "), old.cast("string"), F.lit("→"), new.cast("string"))),
    ]
    of_class = [F.when(changed("bases"), "inheritance changed"), F.when(changed("is_abstract"), "abstract flag changed")]
    detail = F.when(F.col("kind") == "function", F.concat_ws(", ", *of_function)).when(F.col("kind") == "class", F.concat_ws(", ", *of_class)).otherwise("")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(detail != "", "modified")
    told = both.select("kind", F.coalesce("a.name", "b.name").alias("name"), F.coalesce("a.qualified_name", "b.qualified_name").alias("qualified_name"), "file", change.alias("change_type"), F.when(change == "modified", detail).alias("detail"))
    return told.where("change_type is not null")


def file_symbol_diff(before: DataFrame, after: DataFrame, status: DataFrame) -> DataFrame:
    """:func:`symbol_diff` of the files in ``status`` (path, status); types of files that were added or removed don't count.

    ``before`` and ``after`` have the columns of symbols, with the bare path as their file.
    """
    named = status.select(F.col("path").alias("file"), "status")
    of = lambda rows: rows.join(named.select("file"), "file", "left_semi")
    changes = symbol_diff(of(before), of(after)).join(named, "file")
    return changes.where("not (kind = 'type' and status in ('A', 'D'))").select("kind", "name", "qualified_name", "file", "change_type", "detail")


def diff_summary(changes: DataFrame) -> DataFrame:
    of = lambda t: F.count_if(F.col("change_type") == t).alias(t)
    return changes.agg(F.count_distinct("file").alias("files_changed"), of("added"), of("removed"), of("modified"))


def blast_radius(changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, caller): who calls, imports or defines each changed symbol, which stands for the first node of its name."""
    label = F.coalesce("qualified_name", "name")
    symbols = changes.select(label.alias("symbol")).distinct()
    named = nodes.select("node_id", label.alias("symbol")).where("symbol is not null").groupBy("symbol").agg(F.min("node_id").alias("dst"))
    into = edges.where(F.col("kind").isin("calls", "imports", "defines")).select("src", "dst").distinct()
    callers = nodes.select(F.col("node_id").alias("src"), F.coalesce("qualified_name", "name", "node_id").alias("caller"))
    found = symbols.join(named, "symbol").join(into, "dst").join(callers, "src", "left").withColumn("caller", F.coalesce("caller", "src"))
    return found.where("caller != symbol").select("symbol", "caller").distinct()


def affected(radius: DataFrame) -> DataFrame:
    return radius.groupBy("symbol").agg(F.count(F.lit(1)).alias("callers"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) from two lists of (path, sha256): A added, D removed, M modified; equal hashes are no change."""
    both = before.select("path", F.col("sha256").alias("b")).join(after.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    status = F.when(F.col("b").isNull(), "A").when(F.col("a").isNull(), "D").when(F.col("a") != F.col("b"), "M")
    return both.select("path", status.alias("status")).where("status is not null")


def recent_changes(commits: DataFrame, nodes: DataFrame, newest: int = 10, files: int = 5, symbols: int = 20) -> DataFrame:
    """(sha, ts, message, file_pos, file, node_id): the newest commits, their first files, and so many symbols of those."""
    kept = commits.orderBy(F.desc("ts"), "sha").limit(newest).select("sha", "ts", "message", F.posexplode_outer(F.slice("files_changed", 1, files)).alias("file_pos", "file"))
    held = nodes.where("kind != 'file'").select(F.col("file").alias("file_id"), "node_id")
    joined = kept.join(held, F.concat(F.lit("file:"), "file") == F.col("file_id"), "left").drop("file_id")
    turn = F.row_number().over(Window.partitionBy("sha").orderBy("file_pos", "node_id"))
    return joined.withColumn("k", turn).where(F.col("k") <= symbols).drop("k")
