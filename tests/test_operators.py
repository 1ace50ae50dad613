"""Operators on small graphs with exact rows."""

import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import text
from loomgraph.operators import diff, health, incremental, lookup, pack, rank, resolve, search, stats, themes, traverse

EDGE = "src string, dst string, kind string"


def col(df, c):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("b", "a", "calls"), ("c", "b", "calls"), ("a", "c", "calls"), ("t", "a", "tests"), ("f1", "f2", "imports"), ("f2", "f3", "imports"), ("f3", "f1", "imports")], EDGE)


def test_callers_on_a_cycle(edges):
    assert {(r.node_id, r.depth) for r in traverse.callers(edges, "a", 1).collect()} == {("b", 1)}
    assert {(r.node_id, r.depth) for r in traverse.callers(edges, "a", 5).collect()} == {("b", 1), ("c", 2), ("a", 3)}


def test_dependencies_are_one_step_short_unless_inclusive(edges):
    assert traverse.file_dependencies(edges, "f1", 1).count() == 0
    assert col(traverse.file_dependencies(edges, "f1", 2), "node_id") == ["f2"]
    assert col(traverse.file_dependencies(edges, "f1", 2, inclusive=True), "node_id") == ["f2", "f3"]
    assert col(traverse.file_dependencies(edges, "f1", 9), "node_id") == ["f2", "f3"]


def test_impact_grows_with_depth(spark, edges):
    nodes = spark.createDataFrame([("a", "function", "x"), ("t", "test", None)], "node_id string, kind string, file string")
    sizes = [traverse.impact(edges, nodes, "a", d).count() for d in (1, 2, 3)]
    assert sizes == [2, 3, 4]
    row = traverse.impact_summary(traverse.impact(edges, nodes, "a", 3)).first()
    assert (row.affected, row.affected_files, row.affected_tests, row.blast_radius) == (4, 1, 1, 4)


def test_pagerank_mass_and_order(spark):
    ranks = {r.node_id: r.pagerank for r in rank.pagerank(spark.createDataFrame([("b", "a"), ("c", "a"), ("b", "c")], "src string, dst string")).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-6)
    assert max(ranks, key=ranks.get) == "a"
    assert rank.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_rank_edges_fall_back_to_structure(spark):
    rows = [("f", "g", "defines"), ("f", "h", "imports"), ("x", "y", "tests")]
    assert rank.rank_edges(spark.createDataFrame(rows, EDGE)).count() == 2
    assert rank.rank_edges(spark.createDataFrame([*rows, ("g", "h", "calls")], EDGE)).count() == 1


def test_resolution_rules(spark):
    functions = spark.createDataFrame(
        [("func:m::A.helper", "helper", "A.helper", "file:m"), ("func:m::A.driver", "driver", "A.driver", "file:m"), ("func:m::B.helper", "helper", "B.helper", "file:m"), ("func:m::B.run", "run", "B.run", "file:m"), ("func:n::helper", "helper", "helper", "file:n"), ("func:n::go", "go", "go", "file:n")],
        "node_id string, name string, qualified_name string, file string",
    )
    calls = spark.createDataFrame(
        [("func:m::A.driver", "func:?::helper", "calls", True), ("func:m::B.run", "func:?::helper", "calls", True), ("func:n::go", "func:?::helper", "calls", False), ("func:n::go", "func:?::run", "calls", False), ("func:n::go", "func:?::go", "calls", False), ("func:n::go", "func:?::missing", "calls", False), ("func:m::A.driver", "func:?::helper", "tests", False)],
        "src string, dst string, kind string, self_call boolean",
    ).withColumn("resolved", F.lit(False))
    got = {(r.src, r.dst, r.rule) for r in resolve.resolve_calls(calls, functions).where("kind = 'calls'").collect()}
    assert got == {("func:m::A.driver", "func:m::A.helper", "own"), ("func:m::B.run", "func:m::B.helper", "own"), ("func:n::go", "func:n::helper", "same_file"), ("func:n::go", "func:m::B.run", "unique")}
    again = resolve.resolve_calls(resolve.resolve_calls(calls, functions).drop("rule"), functions)
    assert {(r.src, r.dst) for r in again.where("kind = 'calls'").collect()} == {x[:2] for x in got}


def test_merge_edges_keeps_self_calls(spark):
    rows = spark.createDataFrame([("a", "b", "calls", 3, True), ("a", "b", "calls", 9, False)], "src string, dst string, kind string, line int, self_call boolean")
    assert [tuple(r) for r in resolve.merge_edges(rows).collect()] == [("a", "b", "calls", 9, True)]


@pytest.mark.parametrize(
    ("query", "want"),
    [("upsert", ["1", "2"]), ("upsert node", ["1"]), ('"upsert node"', ["1"]), ("node OR graph", ["1", "3"]), ("upsert NOT node", ["2"]), ("gra*", ["3"]), ("name:big", []), ("name:upsert*", ["1", "2"]), ("upsert_node", ["1"]), ("(upsert", []), ("ecole", ["3"]), ("", [])],
)
def test_full_text(spark, query, want):
    nodes = spark.createDataFrame([("1", "upsert_node", None), ("2", "upsert", "big"), ("3", "graph", "École big"), ("4", None, "upsert")], "node_id string, name string, docstring string")
    assert col(search.match(search.build_index(nodes), query), "node_id") == want


def test_definition_cascade(spark):
    nodes = spark.createDataFrame([("1", "run", "function", None), ("2", "runner", "class", None), ("3", "other", "function", "runner of")], "node_id string, name string, kind string, docstring string")
    index = search.build_index(nodes)
    assert col(lookup.find_definition(nodes, index, "run"), "node_id") == ["1"]
    assert col(lookup.find_definition(nodes, index, "RU"), "node_id") == ["1", "2"]
    assert col(lookup.find_definition(nodes, index, "of"), "node_id") == ["3"]
    assert lookup.resolve_symbol(nodes, index, "nothing").first().node_id == "nothing"


@pytest.mark.parametrize(("name", "style"), [("", "unknown"), ("MAX_N", "UPPER_SNAKE"), ("Dog", "PascalCase"), ("do_it", "snake_case"), ("doIt", "camelCase"), ("__x__", "dunder"), ("_x", "private"), ("1x", "other"), ("AB", "UPPER_SNAKE")])
def test_naming(spark, name, style):
    assert spark.range(1).select(text.naming_style(F.lit(name)).alias("s")).first().s == style


@pytest.mark.parametrize(("path", "layer"), [("tests/a.py", "test"), ("src/model/a.py", "data"), ("models/a.py", "unknown"), ("api/x.ts", "presentation"), ("service/x", "business"), ("a/infra/x", "infrastructure"), ("config/x", "config"), ("lib/x", "utility"), ("contest_x.py", "test")])
def test_layers(spark, path, layer):
    assert spark.range(1).select(text.detect_layer(F.lit(path)).alias("s")).first().s == layer


def test_themes(spark):
    rows = [(1, "inline", "ann", "a.py", "Add types and a unit test"), (1, "review", "bob", None, "LGTM! Great work."), (2, "inline", "ann", "b.py", "this is SLOW"), (2, "inline", "bob", "c.py", None)]
    comments = spark.createDataFrame(rows, "pr int, source string, login string, path string, body string").withColumn("seq", F.monotonically_increasing_id())
    assert {(r.theme, r.n) for r in themes.theme_counts(comments).collect()} == {("type_hints", 1), ("testing", 1), ("performance", 1)}
    assert [(r.login, r.n) for r in themes.top_reviewers(comments).collect()] == [("ann", 2), ("bob", 1)]


def test_symbol_diff(spark):
    schema = "kind string, name string, qualified_name string, file string, signature string, is_async boolean, complexity int, bases array<string>, is_abstract boolean"
    f = lambda n, s="()", a=False, c=1: ("function", n, n, "f", s, a, c, None, None)
    before = [f("a"), f("b"), f("c"), f("same"), ("class", "K", None, "f", None, None, None, ["A"], False), ("type", "T", None, "f", None, None, None, None, None)]
    after = [f("b", "(x)", True, 12), f("c", c=3), f("d"), f("same"), ("class", "K", None, "f", None, None, None, ["B"], False)]
    got = {(r.name, r.change_type, r.detail) for r in diff.symbol_diff(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()}
    assert got == {("a", "removed", None), ("b", "modified", "signature changed, async changed, complexity 1→12"), ("d", "added", None), ("K", "modified", "inheritance changed"), ("T", "removed", None)}


def test_orphans_and_upserts(spark, edges):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "node_id string")
    assert {(r.src, r.dst) for r in health.orphan_edges(edges, nodes).collect()} == {("t", "a"), ("f1", "f2"), ("f2", "f3"), ("f3", "f1")}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = incremental.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, incremental.upsert(once, new, "k").collect()))


def test_budget_and_focus(spark):
    rows = spark.createDataFrame([(k, "x" * 8) for k in range(5)], "k int, t string")
    assert pack.within_budget(rows, F.col("t"), [F.col("k")], 7).count() == 3
    got = pack.focus_first(rows.withColumnRenamed("k", "n"), F.col("n") == 3, [F.col("n")], 3).orderBy("position").collect()
    assert [r.n for r in got] == [3, 0, 1]


def test_percent_halves_to_even(spark):
    assert spark.range(1).select(text.round_percent(F.lit(1), F.lit(8)).alias("p")).first().p == 12.0
    assert spark.range(1).select(text.round_percent(F.lit(0), F.lit(0)).alias("p")).first().p == 0.0


def test_pack_fits(spark):
    full = {"overview": [{"a": 1}], "todos": [{"t": "x" * 50}] * 40, "layers": [{"l": "y"}]}
    assert pack.tokens_of(pack.fit(full, "T", 100)) <= 100
    assert "&lt;b&gt;" in pack.render_html({"x": [{"v": "<b>"}]}, "T")


def test_pack_holds_themes_and_notes(spark):
    nodes = spark.createDataFrame([], schema.NODES)
    edges = spark.createDataFrame([], schema.EDGES)
    todos = spark.createDataFrame([], schema.TODOS)
    comments = spark.createDataFrame([(1, "inline", "a", "x.py", "please add test cases", 0)], "pr int, source string, login string, path string, body string, seq int")
    notes = spark.createDataFrame([(k, f"t{k}", "plan", f"n{k}") for k in range(10)], "pos int, written string, category string, body string")
    got = pack.sections(nodes, edges, todos, comments=comments, notes=notes)
    assert len(got["themes"]) >= 1 and [r["body"] for r in got["notes"]] == [f"n{k}" for k in range(9, 1, -1)]
    assert not {"themes", "notes"} & set(pack.sections(nodes, edges, todos))


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "node_id string, kind string, name string, qualified_name string, file string, path string, lang string, docstring string, complexity int, is_test boolean, line_count int")
    edges = spark.createDataFrame([], EDGE)
    assert stats.overview(nodes, edges).first().node_count == 0
    assert stats.complexity_stats(nodes).first().high == 0
    assert stats.test_stats(nodes).first().ratio_pct == 0
