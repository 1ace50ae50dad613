"""The star schema seen as a source graph: parts are files and functions, orders are commits, and so on.

Each table is given twice: as a DataFrame and as the SQL of a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut

FOLDERS = ("tests", "model", "api", "service", "infra", "config", "util", "models", "misc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDER = "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(FOLDERS)) + " END"
_SNAKE = "replace(p_name, ' ', '_')"
_NAME = f"CASE p_partkey % 5 WHEN 0 THEN {_SNAKE} WHEN 1 THEN concat('_', {_SNAKE}) WHEN 2 THEN upper({_SNAKE}) WHEN 3 THEN concat('test_', {_SNAKE}) ELSE replace(p_name, ' ', '') END"
_PATH = f"concat({_FOLDER}, '/', {_SNAKE}, '_', CAST(p_partkey AS {{s}}), '.py')"
_ASYNC = "CASE WHEN p_partkey % 7 = 0 THEN 'async ' ELSE '' END"
_RETURN = "CASE p_partkey % 4 WHEN 0 THEN 'Optional[int]' WHEN 1 THEN 'Result' ELSE 'int' END"


def _parts(s: str) -> str:
    """Columns of a part as a file and a function; ``s`` is the engine's name for text."""
    return f"""SELECT p_partkey, p_brand, p_type, p_name, CAST(p_size AS INT) AS size, {_PATH.format(s=s)} AS path, {_NAME} AS name,
  concat({_ASYNC}, 'def ', {_NAME}, '(x) -> ', {_RETURN}) AS signature, CASE WHEN p_size % 3 = 0 THEN concat(p_name, ' of ', p_brand) END AS docstring FROM part"""


_COLUMNS = ("node_id", "kind", "name", "qualified_name", "file", "path", "lang", "line_start", "line_end", "line_count", "signature", "docstring", "complexity", "is_test", "is_async", "is_property", "is_classmethod", "is_staticmethod", "is_abstract", "is_dataclass", "is_exported")


def _nodes(s: str) -> str:
    null, no = f"CAST(NULL AS {s})", "CAST(NULL AS BOOLEAN)"
    none = "CAST(NULL AS INT)"
    return f"""
SELECT concat('file:', path) AS node_id, 'file' AS kind, {null} AS name, {null} AS qualified_name, {null} AS file, path, lower(p_type) AS lang, {none} AS line_start, {none} AS line_end,
  size * 10 AS line_count, {null} AS signature, {null} AS docstring, {none} AS complexity, path LIKE 'tests/%' AS is_test, {no} AS is_async, {no} AS is_property, {no} AS is_classmethod, {no} AS is_staticmethod, {no} AS is_abstract, {no} AS is_dataclass, {no} AS is_exported FROM parts
UNION ALL SELECT concat('func:part/', CAST(p_partkey AS {s})), 'function', name, CASE WHEN p_partkey % 3 = 0 THEN concat(p_type, '.', name) ELSE name END, concat('file:', path), {null}, {null}, CAST(p_partkey % 200 + 1 AS INT), CAST(p_partkey % 200 + 1 AS INT) + size,
  {none}, signature, docstring, size, {no}, p_partkey % 7 = 0, p_partkey % 11 = 0, p_partkey % 13 = 0, p_partkey % 17 = 0, {no}, {no}, p_partkey % 4 <> 0 FROM parts
UNION ALL SELECT concat('class:nation/', CAST(n_nationkey AS {s})), 'class', n_name, n_name, concat('file:region/', CAST(n_regionkey AS {s})), {null}, {null}, CAST(n_nationkey AS INT), CAST(n_nationkey + 5 AS INT),
  {none}, {null}, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, {none}, {no}, {no}, {no}, {no}, {no}, n_nationkey % 5 = 0, n_nationkey % 3 = 0, true FROM nation
UNION ALL SELECT concat('class:region/', CAST(r_regionkey AS {s})), 'class', r_name, r_name, concat('file:region/', CAST(r_regionkey AS {s})), {null}, {null}, 1, 9,
  {none}, {null}, {null}, {none}, {no}, {no}, {no}, {no}, {no}, true, false, true FROM region
UNION ALL SELECT concat('type:segment/', c_mktsegment), 'type', c_mktsegment, c_mktsegment, 'file:segments.py', {null}, {null}, 1, 1, {none}, {null}, {null}, {none}, {no}, {no}, {no}, {no}, {no}, {no}, {no}, true FROM (SELECT DISTINCT c_mktsegment FROM customer) g"""


def _calls(s: str, distinct: str = "DISTINCT ") -> str:
    """Keys are made distinct as numbers, before they become names."""
    return f"""SELECT concat('func:part/', CAST(x AS {s})) AS src, concat('func:part/', CAST(y AS {s})) AS dst, 'calls' AS kind
FROM (SELECT {distinct}a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey) d"""


def _hierarchy(s: str, distinct: str = "DISTINCT ") -> str:
    key = lambda kind, c: f"concat('file:{kind}/', CAST({c} AS {s}))"
    return f"""SELECT {key("order", "l_orderkey")} AS src, {key("supplier", "l_suppkey")} AS dst, 'imports' AS kind FROM (SELECT {distinct}l_orderkey, l_suppkey FROM lineitem) d
UNION ALL SELECT {key("supplier", "s_suppkey")}, {key("nation", "s_nationkey")}, 'imports' FROM supplier
UNION ALL SELECT {key("customer", "c_custkey")}, {key("nation", "c_nationkey")}, 'imports' FROM customer
UNION ALL SELECT {key("nation", "n_nationkey")}, {key("region", "n_regionkey")}, 'imports' FROM nation"""


_TOUCHED = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) d JOIN parts ON l_partkey = p_partkey"


def _structure(s: str) -> str:
    return f"""SELECT concat('file:', path) AS src, concat('func:part/', CAST(p_partkey AS {s})) AS dst, 'defines' AS kind FROM parts
UNION ALL SELECT concat('class:nation/', CAST(n_nationkey AS {s})), concat('class:region/', CAST(n_regionkey AS {s})), 'inherits' FROM nation
UNION ALL SELECT concat('commit:', CAST(l_orderkey AS {s})), concat('file:', path), 'modifies' FROM {_TOUCHED}"""


_FILE_COMMITS = f"SELECT path AS file, CAST(l_orderkey AS {{s}}) AS sha FROM {_TOUCHED}"
_COMMITS = "SELECT DISTINCT path AS file, CAST(l_orderkey AS {s}) AS sha FROM lineitem JOIN parts ON l_partkey = p_partkey"
_COMMITS = "SELECT CAST(o_orderkey AS {s}) AS sha, concat('author', CAST(o_custkey AS {s})) AS author, o_orderdate AS ts, o_orderpriority AS message FROM orders"
_TESTS = "SELECT concat('test:user/', CAST(user_id AS {s})) AS src, concat('func:part/', CAST(event_id % 100 AS {s})) AS dst, 'tests' AS kind, max(value) / 100.0 AS confidence FROM events WHERE event_type <> 'view' GROUP BY 1, 2"
_COMMENTS = "SELECT CAST(conv_id AS INT) AS pr, CASE WHEN turn % 2 = 0 THEN 'inline' ELSE 'review' END AS source, concat(role, CAST(conv_id % 7 AS {s})) AS login, CASE WHEN turn % 2 = 0 THEN concat('src/', CAST(conv_id % 11 AS {s}), '.py') END AS path, text AS body, conv_id * 1000 + turn AS seq FROM conversations"

#: Tables by name, in an order in which each needs only those before it.
VIEWS = {
    "parts": _parts,
    "nodes": _nodes,
    "calls": _calls,
    "hierarchy": _hierarchy,
    "structure": _structure,
    "call_sites": lambda s: _calls(s, ""),  # with repeats
    "import_sites": lambda s: _hierarchy(s, ""),
    "file_commits": lambda s: _FILE_COMMITS.format(s=s),
    "commits": lambda s: _COMMITS.format(s=s),
    "tests": lambda s: _TESTS.format(s=s),
    "comments": lambda s: _COMMENTS.format(s=s),
}
_NEEDS = {"nodes": ("parts",), "structure": ("parts",), "file_commits": ("parts",)}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")


class Projection:
    """The projected tables of one folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._stored = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def stored(self, name: str) -> DataFrame:
        """A projected table written down, as a source graph's tables are; for what reads it more than once."""
        if name not in self._stored:
            self._stored[name] = cut(getattr(self, name))
        return self._stored[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        text, used = VIEWS[name]("STRING"), {}
        for t in (*_TABLES, *_NEEDS.get(name, ())):
            if f"{t}" in text:
                used[t] = getattr(self, t) if t in VIEWS else self.table(t)
        for t, df in used.items():
            df.createOrReplaceTempView(f"loomgraph_{t}")
        return self.spark.sql(_renamed(text, used))


def _renamed(text: str, used: dict) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 loomgraph_\2", text)


def with_views(names: str, body: str) -> str:
    """``body`` after the common table expressions of the named views, and of those they need."""
    wanted = set(names.split())
    for n in list(wanted):
        wanted |= set(_NEEDS.get(n, ()))
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]('VARCHAR')})" for n in VIEWS if n in wanted)
    rest = body.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes},\n{rest[5:]}"
    return f"WITH {ctes}\n{rest}"


def edges_of(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_churn(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Nodes with the commit count of their file."""
    path = F.coalesce("path", F.regexp_replace("file", "^file:", ""))
    return nodes.withColumn("_path", path).join(counts.select(F.col("file").alias("_path"), "commit_count"), "_path", "left").drop("_path")
