"""A source graph as one object: its tables, and what is asked of them."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import detect_layer
from .operators import diff, enrich, health, incremental, lookup, pack, rank, resolve, search, stats, traverse
from .parse.registry import Registry, parse_files, raw_tables
from .sources import repository
from .storage import cut


@dataclass(frozen=True)
class SourceGraph:
    """Tables of a graph, all lazy; methods name what they do and leave plans to Catalyst."""

    nodes: DataFrame
    edges: DataFrame
    todos: DataFrame
    commits: DataFrame
    config: DataFrame | None = None  # key, value
    stored_index: DataFrame | None = None

    @classmethod
    def of_raw(cls, raw: incremental.Raw, commits: DataFrame, config: DataFrame | None = None, summaries: DataFrame | None = None) -> SourceGraph:
        """The graph that follows from raw tables by file; ``summaries`` (node_id, llm_summary) are kept."""
        nodes = raw.nodes.select("r.*").dropDuplicates(["node_id"])
        if summaries is not None:
            nodes = nodes.join(summaries.select("node_id", "llm_summary"), "node_id", "left")
        edges = raw.edges.drop("path").withColumn("confidence", F.lit(None).cast("double"))
        return cls(nodes, edges, raw.todos.drop("path"), commits, config).derived()

    @classmethod
    def build(cls, spark: SparkSession, files: DataFrame, commits: DataFrame | None = None, registry: Registry | None = None) -> SourceGraph:
        """Parse files (path, content), resolve names across them, detect layers, rank, and count commits."""
        parsed = cut(parse_files(files, registry))
        history = commits if commits is not None else spark.createDataFrame([], "sha string, ts bigint, message string, files_changed array<string>")
        return cls.of_raw(raw_tables(parsed), history)

    def derived(self) -> SourceGraph:
        """What follows from raw tables: resolved edges, layers, PageRank, churn. Deriving again changes nothing."""
        functions, classes = self.nodes.where("kind = 'function'"), self.nodes.where("kind = 'class'")
        merged = resolve.merge_edges(self.edges)
        calls = resolve.resolve_calls(merged, functions).drop("rule")
        edges = resolve.merge_edges(resolve.resolve_inherits(calls, classes))
        summary = self.nodes["llm_summary"] if "llm_summary" in self.nodes.columns else F.lit(None)
        bare = self.nodes.withColumn("llm_summary", summary.cast("string")).drop("layer", "pagerank", "commit_count")
        counts = rank.churn(self.commits, bare.where("kind = 'file'").select("path")).select(F.concat(F.lit("file:"), "file").alias("node_id"), "commit_count")
        ranked = bare.join(rank.pagerank(rank.rank_edges(edges)), "node_id", "left").join(counts, "node_id", "left")
        layer = F.when(F.col("kind") == "file", detect_layer(F.col("path")))
        nodes = ranked.withColumns({"layer": layer, "pagerank": F.coalesce("pagerank", F.lit(0.0)), "commit_count": F.coalesce("commit_count", F.lit(0))})
        return replace(self, nodes=nodes, edges=edges)

    @property
    def index(self) -> DataFrame:
        """The stored index, or one built where none is stored."""
        return self.stored_index if self.stored_index is not None else search.build_index(self.nodes)

    def find_symbol(self, name: str, kind: str | None = None) -> DataFrame:
        return lookup.find_symbol(self.nodes, self.index, name, kind)

    def find_callers(self, function: str, depth: int = 1) -> DataFrame:
        return traverse.caller_details(self.edges, self.nodes, function, depth)

    def dependencies(self, file: str, depth: int = 2) -> DataFrame:
        return traverse.dependencies(self.edges, file, depth)

    def recent_changes(self, newest: int = 10) -> DataFrame:
        return diff.recent_changes(self.commits, self.nodes, newest)

    def hot_paths(self, top: int = 20) -> DataFrame:
        return rank.hot_paths(self.nodes, top)

    def test_coverage(self, symbol: str) -> DataFrame:
        return lookup.test_coverage(self.nodes, self.edges, symbol)

    def public_api(self, file: str | None = None) -> DataFrame:
        return lookup.public_api(self.nodes, file)

    def list_todos(self, kind: str | None = None, limit: int = 50) -> DataFrame:
        return lookup.todos(self.todos, kind, limit)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search.search(self.nodes, self.index, query, limit)

    def layers(self) -> DataFrame:
        return stats.layers(self.nodes)

    def impact(self, symbol: str, depth: int = 3) -> DataFrame:
        return traverse.impact(self.edges, self.nodes, symbol, depth)

    def conventions(self) -> dict[str, DataFrame]:
        return stats.conventions(self.nodes, self.edges)

    def overview(self) -> DataFrame:
        return stats.overview(self.nodes, self.edges)

    def doctor(self, head: str | None = None) -> DataFrame:
        """Problems by check; with ``head``, also whether the graph was indexed at it."""
        return health.doctor(self.nodes, self.edges, self.index, self._config(), head)

    def _config(self) -> DataFrame:
        return self.config if self.config is not None else self.nodes.sparkSession.createDataFrame([], "key string, value string")

    def with_config(self, key: str, value: str) -> SourceGraph:
        new = self.nodes.sparkSession.createDataFrame([(key, value)], "key string, value string")
        return replace(self, config=incremental.upsert(self._config(), new, "key"))

    def cleared(self) -> SourceGraph:
        """No rows, the same configuration."""
        none = {n: getattr(self, n).limit(0) for n in ("nodes", "edges", "todos", "commits")}
        return replace(self, **none, stored_index=None)

    def enriched(self, cached: DataFrame, ask: enrich.Ask, size: int = 20) -> tuple[SourceGraph, DataFrame]:
        """(graph, cache): with summaries from the cache (cache_key, llm_summary), and from ``ask`` for what it lacks."""
        new = cut(enrich.answers(enrich.prompts(self.nodes, cached, size), ask))
        cache = cached.select("cache_key", "llm_summary").unionByName(new.select("cache_key", "llm_summary")).dropDuplicates(["cache_key"])
        return replace(self, nodes=enrich.patched(self.nodes, cached, new)), cache

    def compress(self, focus: str | None = None, role: str = "general", budget: int = 8000, **given: DataFrame) -> dict[str, list[dict]]:
        return pack.compress(pack.sections(self.nodes, self.edges, self.todos, self.commits, budget, **given), self.nodes, self.edges, focus, role)

    def overview_report(self) -> dict[str, DataFrame]:
        return stats.overview_report(self.nodes, self.edges, self.todos)

    def context_pack(self, title: str, budget: int = 8000, comments: DataFrame | None = None, notes: DataFrame | None = None) -> str:
        return pack.fit(pack.sections(self.nodes, self.edges, self.todos, self.commits, budget, comments, notes), title, budget)

    def register_views(self) -> None:
        """For Spark SQL: nodes, edges, todos, commits."""
        for name in ("nodes", "edges", "todos", "commits"):
            getattr(self, name).createOrReplaceTempView(name)

    def save(self, path: str) -> str:
        """Write a version of all tables, nodes and edges by kind, with a full-text index, and then name it: readers see all of it or none. Its name."""
        version = str(time.time_ns())
        for name, by in (("nodes", "kind"), ("edges", "kind"), ("todos", None), ("commits", None)):
            incremental.write_table(getattr(self, name), f"{path}/{version}/{name}", by)
        incremental.write_table(self._config(), f"{path}/{version}/config")
        search.save_index(search.build_index(self.nodes), f"{path}/{version}/index")
        self.nodes.sparkSession.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/version")
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SourceGraph:
        return cls.reload(spark, path)[0]

    @classmethod
    def reload(cls, spark: SparkSession, path: str, seen: str | None = None) -> tuple[SourceGraph | None, str]:
        """(graph, version): the graph if it was saved again since the version ``seen``, else None."""
        spark.catalog.refreshByPath(f"{path}/version")
        now = spark.read.text(f"{path}/version").first()[0]
        if now == seen:
            return None, now
        return cls(*(spark.read.parquet(f"{path}/{now}/{n}") for n in ("nodes", "edges", "todos", "commits", "config", "index"))), now


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all versions of a saved graph but the newest ``keep``; readers of older ones fail afterwards."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted((s.getPath() for s in store.listStatus(root) if s.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    for old in versions[: max(0, len(versions) - keep)]:
        store.delete(old, True)


@dataclass(frozen=True)
class Updated:
    """After an update: raw tables by file, commits, configuration, and one row of counters."""

    raw: incremental.Raw
    commits: DataFrame
    config: DataFrame
    counters: DataFrame

    def graph(self, summaries: DataFrame | None = None) -> SourceGraph:
        return SourceGraph.of_raw(self.raw, self.commits, self.config, summaries)


def update(raw: incremental.Raw, commits: DataFrame, config: DataFrame, files: DataFrame, deleted: DataFrame, new_commits: DataFrame, registry: Registry | None = None) -> Updated:
    """Take in changed ``files`` (path, content), ``deleted`` ones (path) and new commits, and move the mark of what is indexed.

    Files whose hash is known are left alone; the others are parsed, and their rows replace those of their files. The mark,
    ``last_indexed_sha``, becomes the newest commit. Doing the same again changes nothing. Everything else follows from :meth:`Updated.graph`.
    """
    hashed = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    todo = incremental.changed(hashed, raw.files)
    parsed = cut(parse_files(todo, registry))
    gone = deleted.select("path").distinct()
    merged = incremental.replace_files(raw, raw_tables(parsed), gone)
    every = commits.unionByName(new_commits.select(*commits.columns)).dropDuplicates(["sha"])
    newest = new_commits.orderBy(F.desc("ts"), "sha").limit(1).select(F.lit("last_indexed_sha").alias("key"), F.col("sha").alias("value"))
    counts = incremental.counters(parsed.where("size(errors) > 0"), parsed, gone.join(raw.files, "path", "left_semi"), new_commits)
    return Updated(merged, every, incremental.upsert(config, newest, "key"), counts)


def update_from_git(spark: SparkSession, root: str, raw: incremental.Raw, commits: DataFrame, config: DataFrame, newest: int = 50, registry: Registry | None = None) -> Updated:
    """:func:`update` by what Git says has changed since the mark; without a mark, by the files of the newest commits."""
    mark = lookup.config_value(config, "last_indexed_sha").first().value
    new = repository.commits(spark, root, since=mark or None, limit=newest if mark else 20)
    if mark:
        status = [(r.status, r.path) for r in repository.changed_files(spark, root, mark).collect()]
    else:
        status = [("M", p) for p in sorted({p for r in new.collect() for p in r.files_changed})]
    kept = [p for s, p in status if s != "D"]
    deleted = spark.createDataFrame([(p,) for s, p in status if s == "D"], "path string")
    return update(raw, commits, config, repository.tree_at(spark, root, "HEAD", kept).select("path", "content"), deleted, new, registry)


def diff_refs(spark: SparkSession, root: str, old: str, new: str, graph: SourceGraph | None = None, registry: Registry | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(changes, blast radius): symbols that differ between two refs, and with a graph those that they concern."""
    status = repository.changed_files(spark, root, old, new)
    paths = [r.path for r in status.collect()]

    def symbols(ref: str) -> DataFrame:
        parsed = parse_files(repository.tree_at(spark, root, ref, paths).select("path", "content"), registry)
        rows = parsed.select("path", F.explode("nodes").alias("n")).where("n.kind in ('function', 'class', 'type')")
        return rows.select("n.kind", "n.name", "n.qualified_name", F.col("path").alias("file"), "n.signature", "n.is_async", "n.complexity", "n.bases", "n.is_abstract")

    changes = cut(diff.file_symbol_diff(symbols(old), symbols(new), status))
    return changes, None if graph is None else diff.blast_radius(changes, graph.nodes, graph.edges)


def from_repository(spark: SparkSession, root: str, max_commits: int = 1000) -> SourceGraph:
    return SourceGraph.build(spark, repository.scan(spark, root), repository.commits(spark, root, limit=max_commits))


@contextmanager
def writer_lock(path: str, wait: float = 10.0) -> Iterator[None]:
    """One writer on this machine at a time; the lock of a process that is gone is taken over."""
    deadline = time.monotonic() + wait
    while True:
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            try:
                owner = int(open(path).read() or 0)
                os.kill(owner, 0) if owner else None
            except (ProcessLookupError, ValueError):
                os.unlink(path)
                continue
            if time.monotonic() > deadline:
                raise TimeoutError(f"{path} is held by process {owner}") from None
            time.sleep(0.1)
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        os.unlink(path)
