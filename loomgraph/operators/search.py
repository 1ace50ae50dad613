"""Full-text search over names and docstrings: a posting table and a boolean query language as joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from .traverse import impact

DOCSTRING = 500


def build_index(nodes: DataFrame, length: int | None = DOCSTRING) -> DataFrame:
    """(token, node_id, column, pos) of nodes with a name: all words of name and of the docstring's first ``length`` characters, or of all with None."""
    fields = (("name", F.col("name")), ("docstring", F.col("docstring") if length is None else F.substring("docstring", 1, length)))
    named = nodes.where("name is not null").select("node_id", F.explode(F.array(*(F.struct(F.lit(k).alias("column"), words(v).alias("tokens")) for k, v in fields))).alias("f"))
    return named.select("node_id", "f.column", F.posexplode("f.tokens").alias("pos", "token"))


def index_size(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes the index covers."""
    return nodes.where("name is not null").agg(F.count(F.lit(1)).alias("indexed"))


_TOKEN = re.compile(r'\s*(?:(\()|(\))|(?:(\w+)\s*:\s*)?(?:"([^"]*)"|([^\s()":*]+))(\*)?)')


def parse(query: str) -> tuple | None:
    """The query as nested tuples, or None if it isn't well formed.

    ``a b`` and ``a AND b`` meet, ``a OR b`` join, ``a NOT b`` takes away; NOT binds closest, then AND, then OR. Words in double quotes
    are a phrase, ``a*`` is a prefix, ``name:a`` looks in one column, parentheses group.
    """
    at, tokens = 0, []
    query = query.strip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        if m[1] or m[2]:
            tokens.append(m[1] or m[2])
        elif m[5] in ("AND", "OR", "NOT") and not m[3] and not m[6]:
            tokens.append(m[5])
        else:
            tokens.append(("phrase", m[4] if m[4] is not None else m[5], bool(m[6]), m[3]))
    place = 0

    def peek():
        return tokens[place] if place < len(tokens) else None

    def take():
        nonlocal place
        place += 1
        return tokens[place - 1]

    def atom():
        now = peek()
        if now == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ValueError
            take()
            return inner
        if not isinstance(now, tuple):
            raise ValueError
        return take()

    def without():
        left = atom()
        while peek() == "NOT":
            take()
            left = ("not", left, atom())
        return left

    def both():
        left = without()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            left = ("and", left, without())
        return left

    def either():
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    try:
        tree = either()
    except ValueError:
        return None
    return tree if place == len(tokens) else None


def _fold(text: str) -> list[str]:
    from ..functions.text import MARKED, PLAIN

    return [w for w in re.split(r"[\W_]+", text.lower().translate(str.maketrans(MARKED, PLAIN))) if w]


def _leaves(tree: tuple) -> list[tuple]:
    return [tree] if tree[0] == "phrase" else [*_leaves(tree[1]), *_leaves(tree[2])]


def _truth(tree: tuple, flags: dict[tuple, Column]) -> Column:
    if tree[0] == "phrase":
        return flags[tree]
    left, right = _truth(tree[1], flags), _truth(tree[2], flags)
    return left | right if tree[0] == "or" else left & right if tree[0] == "and" else left & ~right


def match(postings: DataFrame, query: str) -> DataFrame:
    """(node_id) of the nodes that the query finds; none for a query that isn't well formed.

    One pass over the postings of the query's words, however many these are: each node's fields become flags, one for each word or
    phrase, and the query is an expression of them. A phrase is found where its words' places, moved back, meet.
    """
    tree = parse(query)
    if tree is None:
        return postings.where(F.lit(False)).select("node_id")
    leaves, asked, sums = list(dict.fromkeys(_leaves(tree))), [], []
    for k, (_, text, prefix, column) in enumerate(leaves):
        terms = _fold(text)
        here = F.lit(True) if column is None else F.col("column") == column
        hits = [here & (F.col("token").startswith(t) if prefix and j == len(terms) - 1 else F.col("token") == t) for j, t in enumerate(terms)]
        asked += hits
        if len(hits) <= 1:
            sums.append(F.bool_or(hits[0] if hits else F.lit(False)).alias(f"leaf_{k}"))
            continue
        starts = [F.collect_set(F.when(hit, F.col("pos") - j)) for j, hit in enumerate(hits)]
        meet = starts[0]
        for s in starts[1:]:
            meet = F.array_intersect(meet, s)
        sums.append((F.size(meet) > 0).alias(f"leaf_{k}"))
    if not asked:
        return postings.where(F.lit(False)).select("node_id")
    wanted = asked[0]
    for a in asked[1:]:
        wanted = wanted | a
    fields = postings.where(wanted).groupBy("node_id", "column").agg(*sums)
    flags = {leaf: F.bool_or(f"leaf_{k}") for k, leaf in enumerate(leaves)}
    return fields.groupBy("node_id").agg(_truth(tree, flags).alias("found")).where("found").select("node_id")


def save_index(postings: DataFrame, path: str) -> None:
    """Postings in ranges of their token, sorted, so that a query reads the files and row groups of its words only."""
    postings.repartitionByRange("token", "node_id").sortWithinPartitions("token", "node_id").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def probe_index(nodes: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: nodes with a name and a word in it that the index misses, and indexed nodes that are gone."""
    named = nodes.where("name is not null").select("node_id", words(F.col("name")).alias("w")).where("size(w) > 0").select("node_id")
    indexed = postings.select("node_id").distinct()
    both = named.select("node_id", F.lit(True).alias("named")).distinct().join(indexed.withColumn("indexed", F.lit(True)), "node_id", "full_outer")
    gone = both.where("named is null").join(nodes.where("name is not null").select("node_id"), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("stale"))
    return both.agg(F.count_if(F.col("indexed").isNull()).alias("missing")).join(gone, F.lit(True), "left")  # one row each


def search(nodes: DataFrame, postings: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return nodes.join(match(postings, query), "node_id", "left_semi").orderBy("node_id").limit(limit)


def substring(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes other than files whose name or docstring holds the text, whatever its case."""
    q = text.lower()
    holds = F.lower(F.coalesce("name", F.lit(""))).contains(q) | F.lower(F.coalesce("docstring", F.lit(""))).contains(q)
    return nodes.where((F.col("kind") != "file") & holds).orderBy("node_id").limit(limit)


def trace_error(nodes: DataFrame, postings: DataFrame, message: str, path: str) -> DataFrame:
    """The symbol that a diagnostic is about: of the five first hits of its first word, the first in a file of that path."""
    first = (message.split() or [""])[0]
    return search(nodes, postings, first, 5).where(F.coalesce("file", F.lit("")).contains(path)).orderBy("node_id").limit(1)


def view_filter(shown: DataFrame, text: str) -> DataFrame:
    """Shown nodes with ``matches``: whether label or path, in any case, or layer holds the text; all of them for a blank one."""
    q = text.lower().strip()
    holds = F.lower(F.coalesce("label", F.lit(""))).contains(q) | F.lower(F.coalesce("path", F.lit(""))).contains(q) | F.coalesce("layer", F.lit("")).contains(q)
    return shown.withColumn("matches", holds)


def error_impact(nodes: DataFrame, edges: DataFrame, postings: DataFrame, message: str, path: str, depth: int = 3) -> DataFrame:
    """(symbol, node_id, kind, file, depth): the symbol that a diagnostic is about, and what a change of it would affect; no symbol, no rows."""
    found = trace_error(nodes, postings, message, path).select("node_id").first()
    symbol = found.node_id if found else ""
    return impact(edges, nodes, symbol, depth).select(F.lit(symbol).alias("symbol"), "node_id", "kind", "file", "depth")
