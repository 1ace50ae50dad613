"""Counts, conventions and reports; each report is one aggregate over one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_naming_style, is_private, naming_style, round_percent

def _rows() -> Column:
    return F.count(F.lit(1))


def top_counts(rows: DataFrame, key: str, top: int | None = None) -> DataFrame:
    counted = rows.groupBy(key).agg(_rows().alias("n")).orderBy(F.desc("n"), key)
    return counted if top is None else counted.limit(top)


def todo_by_kind(todos: DataFrame) -> DataFrame:
    return top_counts(todos, "kind")


def todo_hotspots(todos: DataFrame, top: int = 10) -> DataFrame:
    return top_counts(todos, "file", top)


def todo_summary(todos: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    return {"total": todos.agg(_rows().alias("total")), "by_kind": todo_by_kind(todos), "hottest_files": todo_hotspots(todos, top)}


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts. node_count holds the ends of edges that have no node."""
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(f"{kind}_count")
    ends = nodes.select("node_id", F.lit(0).alias("end")).unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node_id"), F.lit(1).alias("end")))
    totals = nodes.agg(of("file"), of("class"), of("function"), of("type"), F.count_if((F.col("kind") == "file") & F.coalesce("is_test", F.lit(False))).alias("test_file_count"))
    each = ends.groupBy("node_id").agg(F.sum("end").alias("ends"))
    counts = each.agg((F.coalesce(F.sum("ends"), F.lit(0)) / 2).cast("bigint").alias("edge_count"), _rows().alias("node_count"))
    return totals.join(counts, F.lit(True), "left")  # one row each


def languages(nodes: DataFrame) -> DataFrame:
    """Files and lines by language."""
    return nodes.where("kind = 'file' and coalesce(lang, '') != ''").groupBy("lang").agg(_rows().alias("files"), F.sum(F.coalesce("line_count", F.lit(0))).alias("lines")).orderBy(F.desc("files"), "lang")


def primary_language(nodes: DataFrame) -> DataFrame:
    return languages(nodes).limit(1).select("lang")


def layer_sizes(nodes: DataFrame) -> DataFrame:
    layer = F.coalesce(F.when(F.col("layer") != "", F.col("layer")), F.lit("unknown"))
    return nodes.where("kind = 'file'").groupBy(layer.alias("layer")).agg(_rows().alias("files"))


def layers(nodes: DataFrame, per_layer: int | None = None) -> DataFrame:
    """(layer, node_id) of the files, all or the first by id of each layer; ``collect_list`` it only where layers are small."""
    layer = F.coalesce(F.when(F.col("layer") != "", F.col("layer")), F.lit("unknown"))
    files = nodes.where("kind = 'file'").select(layer.alias("layer"), "node_id")
    if per_layer is None:
        return files
    return files.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy("node_id"))).where(F.col("k") <= per_layer).drop("k")


def styles(names: DataFrame, column: str, style: Column | None = None) -> DataFrame:
    return names.groupBy((style if style is not None else naming_style(F.col(column))).alias("style")).agg(_rows().alias("n"))


def dominant(histogram: DataFrame) -> DataFrame:
    """One row: the most common style that is neither other nor unknown; the first by name where styles tie."""
    return histogram.where("style not in ('other', 'unknown')").orderBy(F.desc("n"), "style").limit(1).select(F.col("style").alias("dominant"))


def function_names(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'function' and not (name like 'test\\_%' or name like 'Test%')").select("name")


def naming_report(nodes: DataFrame) -> dict[str, DataFrame]:
    functions, classes = styles(function_names(nodes), "name"), styles(nodes.where("kind = 'class'"), "name")
    files = styles(nodes.where("kind = 'file'"), "path", file_naming_style(F.col("path")))
    private = nodes.where("kind = 'function'").agg(F.count_if(is_private(F.col("name"))).alias("private"), _rows().alias("functions"))
    return {"functions": functions, "classes": classes, "files": files, "dominant": dominant(functions), "private": private}


def doc_coverage(nodes: DataFrame, kinds: tuple[str, ...] = ("function", "class"), exported_only: bool = True) -> DataFrame:
    """(kind, total, documented, pct), a row for each kind, zero where there is none."""
    pool = nodes.where(F.coalesce("is_exported", F.lit(False))) if exported_only else nodes
    every = nodes.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counted = pool.where(F.col("kind").isin(*kinds)).groupBy("kind").agg(_rows().alias("total"), F.count_if(F.coalesce("docstring", F.lit("")) != "").alias("documented"))
    full = every.join(counted, "kind", "left").select("kind", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("documented", F.lit(0)).alias("documented"))
    return full.withColumn("pct", round_percent(F.col("documented"), F.col("total")))


FLAGS = ("is_async", "is_property", "is_classmethod", "is_staticmethod", "is_exported")


def pattern_counts(nodes: DataFrame) -> DataFrame:
    """One row: functions with each flag, and how signatures say that they may fail; percent of functions."""
    functions = nodes.where("kind = 'function'")
    says = F.coalesce("signature", F.lit(""))
    counts = [F.count_if(F.coalesce(f, F.lit(False))).alias(f[3:] + "_count") for f in FLAGS]
    errors = [F.count_if(says.contains(word)).alias(f"{name}_returns") for name, word in (("result", "Result"), ("optional", "Optional"))]
    totals = functions.agg(_rows().alias("functions"), *counts, *errors)
    return totals.select("*", *(round_percent(F.col(f[3:] + "_count"), F.col("functions")).alias(f[3:] + "_pct") for f in FLAGS))


def class_patterns(nodes: DataFrame) -> DataFrame:
    flags = ("is_abstract", "is_dataclass")
    totals = nodes.where("kind = 'class'").agg(_rows().alias("classes"), *(F.count_if(F.coalesce(f, F.lit(False))).alias(f[3:] + "_count") for f in flags))
    return totals.select("*", *(round_percent(F.col(f[3:] + "_count"), F.col("classes")).alias(f[3:] + "_pct") for f in flags))


def _complexity() -> Column:
    return F.when(F.coalesce("complexity", F.lit(0)) == 0, 1).otherwise(F.col("complexity"))


def complexity_stats(nodes: DataFrame) -> DataFrame:
    c = _complexity()
    return nodes.where("kind = 'function'").agg(F.round(F.avg(c), 1).alias("avg_complexity"), F.max(c).alias("max_complexity"), F.min(c).alias("min_complexity"), F.count_if(c > 10).alias("high"), F.count_if((c > 5) & (c <= 10)).alias("medium"))


def most_complex(nodes: DataFrame, top: int = 10, above: int = 10) -> DataFrame:
    return nodes.where("kind = 'function'").select("node_id", "name", _complexity().alias("complexity")).where(F.col("complexity") > above).orderBy(F.desc("complexity"), "node_id").limit(top)


def top_imports(edges: DataFrame, top: int = 15) -> DataFrame:
    """Imported top-level packages; edges without a module don't count, relative ones count as an empty name."""
    package = F.split_part(F.split_part(F.split_part("module", F.lit("::"), F.lit(1)), F.lit("."), F.lit(1)), F.lit("/"), F.lit(1))
    return top_counts(edges.where("kind = 'imports' and module is not null").select(package.alias("package")), "package", top)


def test_stats(nodes: DataFrame) -> DataFrame:
    is_file, is_test = F.col("kind") == "file", F.coalesce("is_test", F.lit(False))
    counted = nodes.agg(
        F.count_if(is_file & is_test).alias("test_files"),
        F.count_if(is_file & ~is_test).alias("code_files"),
        F.count_if((F.col("kind") == "function") & F.col("name").rlike("^(test_|Test)")).alias("test_functions"),
    )
    return counted.withColumn("ratio_pct", round_percent(F.col("test_files"), F.col("code_files")))


def conventions(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Every part of the convention report, each lazy."""
    return {
        **{f"naming_{k}": v for k, v in naming_report(nodes).items()},
        "doc_coverage": doc_coverage(nodes),
        "patterns": pattern_counts(nodes),
        "class_patterns": class_patterns(nodes),
        "complexity": complexity_stats(nodes),
        "most_complex": most_complex(nodes),
        "imports": top_imports(edges),
        "tests": test_stats(nodes),
        "languages": languages(nodes),
    }


def extract_todos(lines: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """``lines`` (any columns and a text of many lines) with line, kind and text of the first mark in each line."""
    split = F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "content")
    rows = lines.select(*(c for c in lines.columns if c != text), split).where(F.col("content").rlike(pattern))
    return rows.select(*(c for c in lines.columns if c != text), (F.col("line") + 1).alias("line"), F.upper(F.regexp_extract("content", pattern, 1)).alias("kind"), F.trim(F.regexp_extract("content", pattern, 2)).alias("text"))


def save_report(report: dict[str, DataFrame], path: str) -> None:
    """Each part of a report as a small JSON table under its name."""
    for name, part in report.items():
        part.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def load_report(report: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """What was saved of the parts of ``report``, whose schemas it has."""
    return {name: part.sparkSession.read.schema(part.schema).json(f"{path}/{name}") for name, part in report.items()}


def overview_report(nodes: DataFrame, edges: DataFrame, todos: DataFrame, hot: int = 10, todo_cap: int = 1000) -> dict[str, DataFrame]:
    """The overview with layer sizes, the hottest symbols and the number of marks, counted up to a cap."""
    from .rank import hot_paths

    return {
        "overview": overview(nodes, edges),
        "layers": layer_sizes(nodes),
        "hot_paths": hot_paths(nodes, hot),
        "todo_total": todos.limit(todo_cap).agg(_rows().alias("total")),
    }


def summary_sentence(nodes: DataFrame) -> DataFrame:
    """One row, summary: sizes and languages in a sentence."""
    of = lambda kind: F.count_if(F.col("kind") == kind).cast("string")
    spoken = languages(nodes).agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("k"), "lang", "files"))).alias("l"))
    told = F.array_join(F.transform("l", lambda x: F.concat(x["lang"], F.lit("("), x["files"].cast("string"), F.lit(")"))), ", ")
    counts = nodes.agg(of("file").alias("f"), of("function").alias("g"), of("class").alias("c"))
    both = counts.join(spoken, F.lit(True), "left")  # one row each
    return both.select(F.concat(F.lit("Repository with "), "f", F.lit(" files, "), "g", F.lit(" functions, "), "c", F.lit(" classes. Languages: "), told, F.lit(".")).alias("summary"))
