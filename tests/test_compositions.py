"""What operators are composed to: updates and diffs in a repository, packs for a role, versions, settings, streams."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.functions import text
from loomgraph.operators import enrich, pack, search, stats
from loomgraph.parse.registry import parse_files, raw_tables
from loomgraph.settings import Settings
from loomgraph.sources import repository
from loomgraph.streaming import changes, refs


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Two commits: b.py goes, a.py changes, c.py comes."""
    root = tmp_path_factory.mktemp("repo")
    git(root, "init", "-q")
    (root / "a.py").write_text("import b\n\n\ndef load(x):\n    return helper(x)\n\n\ndef helper(x):\n    return x\n")
    (root / "b.py").write_text("class Old:\n    pass\n")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "first")
    git(root, "tag", "one")
    (root / "a.py").write_text("def load(x, y):\n    return helper(x)\n\n\ndef helper(x):\n    return x\n")
    (root / "b.py").unlink()
    (root / "c.py").write_text("from a import load\n\n\nclass New:\n    pass\n\n\ndef run():  # TODO: more\n    return load(1, 2)\n")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "second")
    return str(root)


@pytest.fixture(scope="module")
def graph(spark, repo):
    return session.from_repository(spark, repo)


def raw_at(spark, repo, ref, paths):
    return raw_tables(parse_files(repository.tree_at(spark, repo, ref, paths).select("path", "content")).persist())


def test_update_by_git(spark, repo, graph):
    one = repository.resolve_ref(repo, "one")
    commits = repository.commits(spark, repo).where(F.col("sha") == one)
    config = spark.createDataFrame([("last_indexed_sha", one)], "key string, value string")
    done = session.update_from_git(spark, repo, raw_at(spark, repo, "one", ["a.py", "b.py"]), commits, config)
    assert done.counters.first().asDict() == {"commits_processed": 1, "files_updated": 2, "files_deleted": 1, "errors": 0}
    assert done.config.first().value == repository.resolve_ref(repo, "HEAD")
    summaries = spark.createDataFrame([("func:c.py::run", "runs")], "node_id string, llm_summary string")
    graph, fresh = done.graph(summaries), graph
    assert {r.node_id for r in graph.nodes.collect()} == {r.node_id for r in fresh.nodes.collect()}
    edges = lambda g: {(r.src, r.dst, r.kind) for r in g.edges.collect()}
    assert edges(graph) == edges(fresh) and ("func:c.py::run", "func:a.py::load", "calls") in edges(graph)
    assert graph.nodes.where("node_id = 'func:c.py::run'").first().llm_summary == "runs"
    assert {r.check: r.problems for r in graph.doctor(repository.resolve_ref(repo, "HEAD")).collect()}["freshness"] == 0
    again = session.update_from_git(spark, repo, done.raw, done.commits, done.config)
    assert again.counters.first().files_updated == 0 and again.raw.files.count() == 2


def test_update_without_a_mark(spark, repo):
    empty = raw_at(spark, repo, "one", [])
    done = session.update_from_git(spark, repo, empty, repository.commits(spark, repo).limit(0), spark.createDataFrame([], "key string, value string"))
    assert {r.path for r in done.raw.files.collect()} == {"a.py", "c.py"} and done.commits.count() == 2


def test_diff_between_refs(spark, repo, graph):
    found, radius = session.diff_refs(spark, repo, "one", "HEAD", graph)
    told = {(r.change_type, r.kind, r.name) for r in found.collect()}
    assert told == {("modified", "function", "load"), ("removed", "class", "Old"), ("added", "class", "New"), ("added", "function", "run")}
    assert ("load", "run") in {(r.symbol, r.caller) for r in radius.collect()}


def test_compressed_packs(graph):
    whole = pack.sections(graph.nodes, graph.edges, graph.todos, graph.commits)
    kept = json.dumps(whole, default=str)
    focused = pack.compress(whole, graph.nodes, graph.edges, "a.py", "review")
    assert json.dumps(whole, default=str) == kept
    assert [s["name"] for s in focused["focus"][0]["symbols"]] == ["load", "helper"] and focused["focus"][0]["callers"] == ["run (c.py)"]
    assert len(focused["hot_paths"]) <= 5 and [r["name"] for r in focused["public_api"]] == sorted(r["name"] for r in focused["public_api"])
    assert "similar_files" in graph.compress("file:a.py", "feature")["focus"][0]
    assert pack.compress(whole, graph.nodes, graph.edges, role="nobody") == whole
    assert len(pack.compress(whole, graph.nodes, graph.edges, role="debug")["hot_paths"]) <= 10
    assert pack.tokens_of(pack.fit(whole, "t", 5)) <= 5


def test_output_policy(tmp_path):
    mine = tmp_path / "CONTEXT.md"
    assert pack.write_pack("one", str(tmp_path)) == str(mine) and pack.write_pack("two", str(tmp_path)) == str(mine)
    mine.write_text("by hand")
    assert pack.write_pack("three", str(tmp_path)).endswith("context-pack.md") and mine.read_text() == "by hand"
    assert pack.write_pack("four", str(tmp_path), "off").endswith("context-pack.md")
    assert pack.write_pack("five", str(tmp_path), "force") == str(mine) and "five" in mine.read_text()


def test_versions(spark, graph, tmp_path):
    graph, path = graph.with_config("last_indexed_sha", "x"), str(tmp_path / "graph")
    first = graph.save(path)
    loaded, seen = session.SourceGraph.reload(spark, path)
    assert seen == first and loaded.config.first().value == "x" and session.SourceGraph.reload(spark, path, seen) == (None, seen)
    assert {r.node_id for r in loaded.search("load").collect()} == {r.node_id for r in graph.search("load").collect()} != set()
    again = loaded.with_config("last_indexed_sha", "y").save(path)
    assert session.SourceGraph.reload(spark, path, seen)[1] == again
    graph.save(path)
    session.vacuum(spark, path)
    assert session.SourceGraph.load(spark, path).nodes.count() == graph.nodes.count()
    assert graph.cleared().nodes.count() == 0 and graph.cleared().config.first().value == "x"


def test_enrichment(spark, graph):
    cached = spark.createDataFrame([], "cache_key string, llm_summary string")
    told, cache = graph.enriched(cached, lambda prompts: json.dumps({str(k): f"says {k}" for k in range(1, len(prompts) + 1)}), size=2)
    assert told.nodes.where("llm_summary is not null").count() == cache.count() == 4
    later, _ = graph.enriched(cache, lambda prompts: 1 / 0)
    assert later.nodes.where("llm_summary is not null").count() == 4
    assert enrich.answers(enrich.prompts(graph.nodes, cached), lambda prompts: "no JSON").count() == 0
    failing, _ = graph.enriched(cached, lambda prompts: 1 / 0)
    assert failing.nodes.where("llm_summary is not null").count() == 0


def test_report_is_kept(graph, tmp_path):
    report = graph.conventions()
    stats.save_report(report, str(tmp_path))
    for name, part in stats.load_report(report, str(tmp_path)).items():
        assert sorted(map(str, part.collect())) == sorted(map(str, report[name].collect())), name
    assert graph.overview_report()["todo_total"].first().total == 1
    assert "2 files" in stats.summary_sentence(graph.nodes).first().summary


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("LOOMGRAPH_TOKEN_BUDGET=10\nexport LOOMGRAPH_LOG_LEVEL='DEBUG'\n# LOOMGRAPH_MAX_WORKERS=1\n")
    (tmp_path / "loomgraph.toml").write_text('token_budget = 30\nrepo_path = "/elsewhere"\nother = 1\n')
    found = Settings.from_repo(tmp_path, {"LOOMGRAPH_TOKEN_BUDGET": "20", "LOOMGRAPH_LLM_ENRICH": "true"})
    assert (found.token_budget, found.llm_enrich, found.log_level, found.max_workers) == (30, True, "DEBUG", 8)
    assert found.repo_path == tmp_path and found.folder.is_dir()


def test_exported_payloads(spark, tmp_path):
    (tmp_path / "tree.json").write_text(json.dumps({"tree": [{"path": "a.py", "type": "blob", "size": 3, "sha": "x"}, {"path": "d", "type": "tree"}]}))
    (tmp_path / "commits.json").write_text(json.dumps({"sha": "0123456789", "commit": {"message": "one\ntwo", "author": {"name": "n", "email": "e", "date": "1970-01-01T00:00:07Z"}}, "files": [{"filename": "a.py"}]}))
    (tmp_path / "compare.json").write_text(json.dumps({"files": [{"filename": "b.py", "status": "renamed", "previous_filename": "a.py"}, {"filename": "c.py", "status": "removed"}]}))
    assert [tuple(r) for r in repository.exported_tree(spark, str(tmp_path / "tree.json")).collect()] == [("a.py", 3, "x")]
    row = repository.exported_commits(spark, str(tmp_path / "commits.json")).first()
    assert (row.short_sha, row.ts, row.message, row.files_changed) == ("0123456", 7, "one", ["a.py"])
    assert [tuple(r) for r in repository.exported_compare(spark, str(tmp_path / "compare.json")).collect()] == [("R", "b.py"), ("D", "c.py")]


def test_editor_scan_and_notes(spark, tmp_path):
    (tmp_path / "third_party").mkdir()
    (tmp_path / "third_party" / "x.py").write_text("y = 1\n")
    (tmp_path / "logo.png").write_text("")
    assert [r.path for r in repository.editor_scan(spark, str(tmp_path), (".py", ".c++")).collect()] == ["third_party/x.py"]
    path = str(tmp_path / "notes.md")
    repository.append_note(path, "t", "idea", "one")
    repository.clear_notes(path)
    assert repository.read_notes(spark, path).count() == 0


def test_moves_of_a_ref(spark, repo, tmp_path):
    seen = []
    for _ in range(2):
        refs.watch(spark, repo, lambda old, new: seen.append((old, new)), str(tmp_path / "moves")).awaitTermination()
    assert seen == [("", repository.resolve_ref(repo, "HEAD"))]


def test_debounce_and_running_counts(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00.000"), ("a", "2024-01-01 00:00:00.100"), ("b", "2024-01-01 00:00:00.200")]
    spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return sorted(tuple(r) for r in spark.table(name).collect())

    assert [r[0] for r in run(changes.debounce(stream), "debounced", "append")] == ["a", "b"]
    assert run(changes.commit_counts(stream), "counts", "update") == [("a", 2), ("b", 1)]


def test_phrases_prefixes_and_marks(spark):
    nodes = spark.createDataFrame([("n1", "parse_tree", "Reads the syntax tree once"), ("n2", "Žluťoučký kůň", None), ("n3", "tree", "parse of nothing")], "node_id string, name string, docstring string")
    index = search.build_index(nodes)
    ask = lambda q: sorted(r.node_id for r in search.match(index, q).collect())
    assert ask('"syntax tree"') == ["n1"] and ask('"parse tree"') == ["n1"] and ask("zlutoucky kun") == ["n2"] and ask("syn*") == ["n1"]
    assert ask("tree NOT syntax") == ["n3"] and ask("(parse OR kun) NOT (syntax AND once)") == ["n2", "n3"] and ask("name:parse") == ["n1"]
    assert text.MARKED and len(text.MARKED) == len(text.PLAIN)
