"""More registered queries: lookups, updates, texts and the operators that others are composed of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff, enrich, health, incremental, lookup, pack, rank, resolve, search, stats, themes, traverse
from ..parse.registry import parse_files, raw_tables
from ..sources import repository
from ..storage import cut, shared_folder
from .catalogue import _ALL, _LOCATED, _all_edges, _churned, _layered, _pagerank_sql, _postings_sql, _walk_sql, query
from .projection import Projection, edges_of

# --- lookups ---------------------------------------------------------------------------------------------------------------

#: A line of source for each part, with the marks that are looked for by default.
_LINE = "CASE p_partkey % 9 WHEN 0 THEN concat('x = 1  # TODO: ', p_name) WHEN 1 THEN concat('# fixme ', p_name) WHEN 2 THEN concat('#HACK ', p_name) WHEN 3 THEN concat('# Note: ', p_name) WHEN 4 THEN concat('# XXX', ' ', p_name) WHEN 5 THEN concat('# BUG:: ', p_name) WHEN 6 THEN concat('# TODOS ', p_name) WHEN 7 THEN concat('TODO ', p_name) ELSE p_name END"
_PY_MARK = text.todo_pattern("python")
_MARKS = f"marks AS (SELECT concat('file:', path) AS node_id, path AS file, (p_partkey % 50 + 1)::INT AS line, upper(regexp_extract(l, '{_PY_MARK}', 1)) AS kind, trim(regexp_extract(l, '{_PY_MARK}', 2)) AS text FROM (SELECT *, {_LINE} AS l FROM parts) WHERE regexp_matches(l, '{_PY_MARK}'))"


def _marks(p: Projection) -> DataFrame:
    lines = p.parts.select("path", (F.col("p_partkey") % 50).alias("before"), F.expr(_LINE).alias("text"))
    found = stats.extract_todos(lines, _PY_MARK)
    return found.select(F.concat(F.lit("file:"), "path").alias("node_id"), F.col("path").alias("file"), (F.col("line") + F.col("before")).cast("int").alias("line"), "kind", "text")


@query("parts", f"WITH {_MARKS} SELECT kind, count(*) AS n FROM marks GROUP BY kind")
def todo_default_kinds(p: Projection) -> DataFrame:
    return stats.todo_by_kind(_marks(p))


@query("parts", f"WITH {_MARKS} SELECT * FROM marks WHERE kind = 'FIXME' ORDER BY file, line, node_id, text LIMIT 50")
def list_todos(p: Projection) -> DataFrame:
    return lookup.todos(_marks(p), "fixme")


@query("nodes", f"SELECT node_id, kind, name, replace(file, 'file:', '') AS file, line_start AS line, signature, substr(docstring, 1, 200) AS docstring, count(*) OVER () AS count FROM (SELECT {_LOCATED} FROM nodes WHERE name = 'AUTOMOBILE')")
def find_symbol(p: Projection) -> DataFrame:
    nodes = p.nodes
    return lookup.find_symbol(nodes, search.build_index(nodes), "AUTOMOBILE")


@query("nodes", "SELECT coalesce(min(node_id), 'AUTOMOBILE') AS node_id FROM nodes WHERE name = 'AUTOMOBILE'")
def resolve_symbol(p: Projection) -> DataFrame:
    nodes = p.nodes
    return lookup.resolve_symbol(nodes, search.build_index(nodes), "AUTOMOBILE")


_SIX = "WITH " + _pagerank_sql("calls")


@query("nodes calls", f"{_SIX}, named AS (SELECT min(name) AS name FROM nodes WHERE kind = 'function' AND name LIKE 'test%') SELECT n.node_id, n.name FROM nodes n JOIN named USING (name) LEFT JOIN pr6 r ON r.node_id = n.node_id WHERE n.kind IN ('function', 'class') ORDER BY round(coalesce(pagerank, 0), 9) DESC, n.node_id LIMIT 1")
def best_ranked(p: Projection) -> DataFrame:
    nodes = p.nodes
    ranks = rank.pagerank(p.stored("calls").select("src", "dst"), iterations=6, tolerance=None).withColumn("pagerank", F.round("pagerank", 9))
    name = nodes.where("kind = 'function' and name like 'test%'").agg(F.min("name")).first()[0]
    return lookup.best_ranked(nodes.join(ranks, "node_id", "left"), name or "").select("node_id", "name")


@query("nodes calls", f"WITH RECURSIVE {_walk_sql('calls', 'func:part/7', 2)}, w AS (SELECT node_id, min(depth)::INT AS depth FROM walk GROUP BY node_id) SELECT w.node_id, w.depth, n.kind, n.name, n.file, n.line_start FROM w LEFT JOIN nodes n USING (node_id)")
def caller_details(p: Projection) -> DataFrame:
    return traverse.caller_details(p.call_sites, p.nodes, "func:part/7", 2)


@query("hierarchy structure", "SELECT src, dst FROM hierarchy UNION ALL SELECT src, dst FROM structure WHERE kind IN ('imports', 'inherits', 'implements', 'defines')")
def rank_edges(p: Projection) -> DataFrame:
    """No calls among these, so the structural edges rank."""
    return rank.rank_edges(edges_of(p.hierarchy, p.structure))


@query(
    "",
    """WITH classes AS (SELECT concat('class:', CAST(s_suppkey AS VARCHAR)) AS node_id, concat('Nation', CAST(s_suppkey % 40 AS VARCHAR)) AS name FROM supplier WHERE s_suppkey % 3 <> 0), u AS (SELECT name, min(node_id) AS id FROM classes GROUP BY name HAVING count(*) = 1)
SELECT concat('class:c', CAST(c_custkey AS VARCHAR)) AS src, u.id AS dst FROM customer JOIN u ON u.name = concat('Nation', CAST(c_nationkey AS VARCHAR))""",
)
def resolve_inherits_strict(p: Projection) -> DataFrame:
    classes = p.table("supplier").where("s_suppkey % 3 != 0").select(F.concat(F.lit("class:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.concat(F.lit("Nation"), (F.col("s_suppkey") % 40).cast("string")).alias("name"))
    edges = p.table("customer").select(F.concat(F.lit("class:c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("class:?::Nation"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("inherits").alias("kind"), F.lit(False).alias("resolved"))
    return resolve.resolve_inherits(edges, classes, drop_ambiguous=True).select("src", "dst")


@query("nodes structure calls", f"WITH RECURSIVE links AS MATERIALIZED (SELECT * FROM calls UNION ALL SELECT * FROM structure WHERE kind = 'inherits'), {_walk_sql('links', 'func:part/7', 2)}, w AS (SELECT DISTINCT node_id FROM walk) SELECT w.node_id, coalesce(replace(n.file, 'file:', ''), '') AS file, coalesce(n.is_test, false) OR coalesce(regexp_matches(replace(n.file, 'file:', ''), '(?i)test'), false) AS is_test FROM w LEFT JOIN nodes n USING (node_id)")
def file_impact(p: Projection) -> DataFrame:
    return traverse.file_impact(edges_of(p.call_sites, p.structure), p.nodes, "func:part/7", 2)


@query("nodes calls", f"WITH texts AS (SELECT node_id, name, substr(docstring, 1, 500) AS docstring FROM nodes WHERE name IS NOT NULL), {_postings_sql()}, hit AS (SELECT n.node_id, n.file FROM (SELECT DISTINCT node_id FROM postings WHERE token = 'widget') JOIN nodes n USING (node_id) ORDER BY node_id LIMIT 5), one AS (SELECT node_id FROM hit WHERE contains(coalesce(file, ''), '.py') ORDER BY node_id LIMIT 1) SELECT o.node_id AS symbol, c.src AS node_id, n.kind, n.file, 1 AS depth FROM one o JOIN (SELECT DISTINCT src, dst FROM calls) c ON c.dst = o.node_id LEFT JOIN nodes n ON n.node_id = c.src")
def error_impact(p: Projection) -> DataFrame:
    nodes = p.nodes
    return search.error_impact(nodes, p.call_sites, search.build_index(nodes), "widget is not defined", ".py", 1)


@query("hierarchy", "SELECT DISTINCT replace(dst, 'file:', '') AS file FROM hierarchy WHERE src = 'file:order/1' ORDER BY file LIMIT 10")
def imports_of(p: Projection) -> DataFrame:
    return traverse.imported(p.hierarchy, "file:order/1")


@query("nodes", "SELECT node_id, kind FROM nodes WHERE kind IN ('class', 'type')")
def node_scan(p: Projection) -> DataFrame:
    return lookup.by_kind(p.nodes, ("class", "type")).select("node_id", "kind")


@query("nodes", "SELECT node_id, name, file FROM nodes WHERE node_id = 'class:nation/3'")
def node_by_id(p: Projection) -> DataFrame:
    return lookup.by_id(p.nodes, "class:nation/3").select("node_id", "name", "file")


@query("", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type = 'view' AND json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END) GROUP BY 1")
def edge_details(p: Projection) -> DataFrame:
    """Every third row's JSON is corrupt and skipped."""
    broken = p.table("events").select(F.col("event_type").alias("kind"), F.expr("CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END").alias("meta"))
    return lookup.edge_details(broken, "view").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- texts -----------------------------------------------------------------------------------------------------------------


@query("nodes", f"SELECT count(*) FILTER (regexp_matches(name, '{text.PRIVATE}')) AS single, count(*) FILTER (regexp_matches('_' || name, '{text.DOUBLE_PRIVATE}')) AS double FROM nodes WHERE kind = 'function'")
def private_names(p: Projection) -> DataFrame:
    name = F.col("name")
    return p.nodes.where("kind = 'function'").agg(F.count_if(text.is_private(name)).alias("single"), F.count_if(text.is_double_private(F.concat(F.lit("_"), name))).alias("double"))


@query("nodes", "SELECT node_id, CASE WHEN length(signature) > 20 THEN substr(signature, 1, 19) || '…' ELSE signature END AS inside, CASE WHEN length(signature) > 20 THEN substr(signature, 1, 20) || '...' ELSE signature END AS outside FROM nodes WHERE kind = 'function'")
def truncated(p: Projection) -> DataFrame:
    s = F.col("signature")
    return p.nodes.where("kind = 'function'").select("node_id", text.truncate(s, 20).alias("inside"), text.truncate(s, 20, "...", inside=False).alias("outside"))


@query("", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props::JSON ->> 'k') END AS k FROM events")
def reply_fields(p: Projection) -> DataFrame:
    """Replies with a fence, with one that names its language, bare ones, and some that are no JSON."""
    reply = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json\\n', props, '\\n```') WHEN 2 THEN concat('```\\n', props, '\\n```') ELSE concat('Sorry, ', props) END")
    return p.table("events").select("event_id", F.element_at(text.parse_reply(reply), F.lit("k")).alias("k"))


@query("", "SELECT o_orderkey, strftime(make_timestamp((o_orderkey * 86413 + 11)::BIGINT * 1000000), '%Y-%m-%d') AS day FROM orders")
def commit_dates(p: Projection) -> DataFrame:
    return p.table("orders").select("o_orderkey", text.date_of(F.col("o_orderkey") * 86413 + 11).alias("day"))


@query("", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM pages")
def html_escaped(p: Projection) -> DataFrame:
    return p.table("pages").select("page_id", text.html_escape(F.col("html")).alias("safe"))


@query("nodes", "SELECT node_id, concat('[', kind, '] ', coalesce(qualified_name, name), CASE WHEN signature IS NOT NULL THEN concat('\n   Signature: ', signature) ELSE '' END, '\n   File: ', file, CASE WHEN docstring IS NOT NULL THEN concat('\n   Existing doc: ', substr(docstring, 1, 120)) ELSE '\n   (no existing documentation)' END) AS prompt FROM nodes WHERE kind IN ('function', 'class')")
def prompt_entries(p: Projection) -> DataFrame:
    rows = p.nodes.where("kind in ('function', 'class')")
    return rows.select("node_id", text.prompt_entry(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("signature"), F.lit(None).cast("string"), F.col("file"), F.col("docstring")).alias("prompt"))


@query("nodes", "SELECT node_id, CASE " + " ".join(f"WHEN regexp_matches(path, '{r}') THEN '{n}'" for n, r in text.EDITOR_LAYER_RULES) + " ELSE 'unknown' END AS layer FROM nodes WHERE kind = 'file'")
def editor_layers(p: Projection) -> DataFrame:
    return p.nodes.where("kind = 'file'").select("node_id", text.detect_layer(F.col("path"), text.EDITOR_LAYER_RULES).alias("layer"))


@query("", "SELECT c_custkey, sha256('func:' || c_name || '::' || c_mktsegment) AS k FROM customer")
def symbol_ids(p: Projection) -> DataFrame:
    from ..schema import symbol_id

    return p.table("customer").select("c_custkey", F.sha2(symbol_id("func", F.col("c_name"), F.col("c_mktsegment")), 256).alias("k"))


#: A note for each order's customer: a header, lines of a body, a rule.
@query("", "SELECT (c_custkey * 10) AS pos, '2024-01-01 10:00 UTC' AS written, lower(c_mktsegment) AS category, concat(c_name, '\n', coalesce(c_mktsegment, '')) AS body FROM customer")
def session_notes(p: Projection) -> DataFrame:
    lines = p.table("customer").select(F.col("c_custkey").alias("k"), F.posexplode(F.array(F.concat(F.lit("### 2024-01-01 10:00 UTC · "), F.lower("c_mktsegment")), F.lit(""), F.col("c_name"), F.col("c_mktsegment"), F.lit(""), F.lit("---"))).alias("at", "value"))
    return repository.notes(lines.select((F.col("k") * 10 + F.col("at")).alias("pos"), "value", F.concat(F.lit("f"), (F.col("k") % 7).cast("string")).alias("file")), None)


#: Comments that use the words of the default themes.
_BODY = "CASE p_partkey % 13 WHEN 0 THEN 'please add types, mypy complains' WHEN 1 THEN 'what if this should fail? handle that error' WHEN 2 THEN 'not tested: add test with a mock' WHEN 3 THEN 'unclear, needs a docstring' WHEN 4 THEN 'better name please, this is misleading' WHEN 5 THEN 'too complex, split this' WHEN 6 THEN 'slow, use a cache; n+1 query' WHEN 7 THEN 'possible injection, and a token in the log' WHEN 8 THEN 'unused import and wrong import order' WHEN 9 THEN 'run black; trailing comma' WHEN 10 THEN p_name WHEN 11 THEN '' END"
_THEMED = "said AS (SELECT p_partkey::INT AS pr, CASE WHEN p_partkey % 2 = 0 THEN 'inline' ELSE 'review' END AS source, concat('dev', (p_partkey % 5)::VARCHAR) AS login, path, " + _BODY + " AS body FROM parts), themed AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS theme FROM said WHERE regexp_matches(body, '(?i){'|'.join(f'(?:{x})' for x in v)}')" for k, v in text.THEMES.items()) + ")"


def _said(p: Projection) -> DataFrame:
    key = F.col("p_partkey")
    return p.parts.select(key.cast("int").alias("pr"), F.when(key % 2 == 0, "inline").otherwise("review").alias("source"), F.concat(F.lit("dev"), (key % 5).cast("string")).alias("login"), "path", F.expr(_BODY).alias("body"), key.alias("seq"))


@query("parts", f"WITH {_THEMED} SELECT theme, count(*) AS n FROM themed GROUP BY theme")
def default_themes(p: Projection) -> DataFrame:
    return themes.theme_counts(_said(p))


@query("parts", f"WITH {_THEMED}, f AS (SELECT DISTINCT theme, path FROM themed WHERE source = 'inline'), k AS (SELECT theme, path, row_number() OVER (PARTITION BY theme ORDER BY path)::INT AS k FROM f) SELECT * FROM k WHERE k <= 5")
def default_theme_files(p: Projection) -> DataFrame:
    return themes.theme_files(_said(p))


# --- updates ---------------------------------------------------------------------------------------------------------------


@query("nodes", "SELECT node_id FROM nodes WHERE coalesce(file, node_id) <> 'file:region/1'")
def delete_file_rows(p: Projection) -> DataFrame:
    rows = p.nodes.withColumn("owner", F.coalesce("file", "node_id"))
    gone = p.spark.createDataFrame([("file:region/1",)], "owner string")
    return incremental.delete_keys(rows, gone, "owner").select("node_id")


@query("calls", "SELECT src, dst, kind FROM calls WHERE dst NOT IN ('func:part/7', 'func:part/8')")
def delete_edges(p: Projection) -> DataFrame:
    gone = p.spark.createDataFrame([("func:part/7",), ("func:part/8",)], "dst string")
    return incremental.delete_keys(p.calls, gone, "dst")


@query("nodes", "SELECT node_id, CASE WHEN kind = 'class' THEN concat('about ', name) WHEN kind = 'type' THEN 'old' END AS llm_summary FROM nodes")
def patched_summaries(p: Projection) -> DataFrame:
    nodes = p.nodes.withColumn("llm_summary", F.when(F.col("kind") == "type", "old"))
    new = nodes.where("kind = 'class'").select("node_id", F.concat(F.lit("about "), "name").alias("llm_summary"))
    return incremental.set_attribute(nodes, new, "llm_summary").select("node_id", "llm_summary")


@query("nodes", "SELECT node_id, concat('[', kind, '] ', coalesce(qualified_name, name)) AS llm_summary FROM nodes WHERE kind IN ('function', 'class') AND coalesce(docstring, '') = ''")
def enriched_nodes(p: Projection) -> DataFrame:
    """The service answers with the first line of each prompt; every tenth answer comes from the cache."""
    nodes = p.nodes.withColumns({"llm_summary": F.lit(None).cast("string"), "definition": F.lit(None).cast("string")})
    key = text.cache_key(F.col("node_id"), F.col("signature"), F.col("docstring"))
    told = F.concat(F.lit("["), "kind", F.lit("] "), F.coalesce("qualified_name", "name"))
    cached = lookup.enrichment_candidates(nodes).where("node_id like '%0'").select(key.alias("cache_key"), told.alias("llm_summary"))

    def ask(prompts: list[str]) -> str:
        import json

        return "```json\n" + json.dumps({str(k): x.split("\n")[0] for k, x in enumerate(prompts, 1)}) + "\n```"

    new = enrich.answers(enrich.prompts(nodes, cached), ask)
    return enrich.patched(nodes, cached, new).where("llm_summary is not null").select("node_id", "llm_summary")


@query("nodes", "SELECT node_id, kind, name FROM nodes")
def snapshot_rows(p: Projection) -> DataFrame:
    """Saved as compressed JSON and read back."""
    path = f"{shared_folder(p.spark)}/loomgraph/{p.spark.sparkContext.applicationId}/snapshot"
    nodes = p.nodes.select("node_id", "kind", "name")
    repository.save_snapshot(nodes, p.structure, path)
    return repository.load_snapshot(p.spark, path, "node_id string, kind string, name string", "src string, dst string, kind string")[0]


def _files(p: Projection, after: bool) -> DataFrame:
    """Documents as files: later, some are new, changed or gone."""
    docs = p.table("documents").where(F.col("doc_id") % 10 != (3 if after else 1))
    body = F.when(F.lit(after) & (F.col("doc_id") % 10 == 2), F.concat("text", F.lit("\n# TODO: check"))).otherwise(F.col("text"))
    return docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce(body, F.lit("")), "UTF-8").alias("content"))


@query(
    "",
    """WITH d AS (SELECT 'docs/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 10 = 2 THEN coalesce(text || chr(10) || '# TODO: check', '') ELSE coalesce(text, '') END AS text, doc_id FROM documents WHERE doc_id % 10 <> 3)
SELECT path, sha256(text) AS sha256 FROM d""",
)
def incremental_update(p: Projection) -> DataFrame:
    """Files after an update equal those of a build from scratch: changed ones are parsed again, deleted ones go, others stay."""
    from ..session import update

    commits = p.commits.select("sha", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "message").limit(0)
    config = p.spark.createDataFrame([], "key string, value string")
    raw = raw_tables(cut(parse_files(_files(p, False))))
    after = _files(p, True)
    deleted = raw.files.join(after, "path", "left_anti").select("path")
    return update(raw, commits, config, after, deleted, commits).raw.files.select("path", "sha256")


@query("", "SELECT 0::BIGINT AS commits_processed, count(*) FILTER (doc_id % 10 IN (1, 2)) AS files_updated, count(*) FILTER (doc_id % 10 = 3) AS files_deleted, 0::BIGINT AS errors FROM documents")
def update_counters(p: Projection) -> DataFrame:
    from ..session import update

    commits = p.commits.select("sha", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "message").limit(0)
    raw = raw_tables(cut(parse_files(_files(p, False))))
    after = _files(p, True)
    deleted = raw.files.join(after, "path", "left_anti").select("path")
    return update(raw, commits, p.spark.createDataFrame([], "key string, value string"), after, deleted, commits).counters


# --- packs and views -------------------------------------------------------------------------------------------------------


@query("nodes", "SELECT node_id, kind, name, coalesce(qualified_name, name) AS qualified_name, coalesce(line_start, 0) AS line_start, substr(coalesce(signature, ''), 1, 120) AS signature, coalesce(complexity, 1) AS complexity, substr(coalesce(docstring, ''), 1, 100) AS docstring FROM nodes WHERE file = 'file:region/1' AND kind IN ('function', 'class', 'type')")
def focus_symbols(p: Projection) -> DataFrame:
    return pack.focus_symbols(p.nodes, "file:region/1")


@query("nodes calls", "WITH one AS (SELECT file FROM nodes WHERE node_id = 'func:part/20') SELECT DISTINCT concat(coalesce(c.qualified_name, c.name, c.node_id), ' (', replace(c.file, 'file:', ''), ')') AS caller FROM nodes o JOIN calls e ON e.dst = o.node_id JOIN nodes c ON c.node_id = e.src WHERE o.kind = 'function' AND o.file = (SELECT file FROM one) AND NOT starts_with(o.name, '_') AND c.file <> o.file ORDER BY caller LIMIT 10")
def focus_callers(p: Projection) -> DataFrame:
    nodes = p.nodes
    file = nodes.where("node_id = 'func:part/20'").select("file").first()[0]
    return pack.focus_callers(nodes, p.calls, file)


_HOT = f"{_SIX}, churn AS (SELECT file, count(*) AS commit_count FROM file_commits GROUP BY file), scored AS (SELECT n.node_id, n.name, round(coalesce(pagerank, 0), 8) + 0.01::DOUBLE * CASE WHEN n.kind = 'file' THEN coalesce(c.commit_count, 0) ELSE 0 END AS score FROM nodes n LEFT JOIN pr6 r ON r.node_id = n.node_id LEFT JOIN churn c ON c.file = n.path WHERE n.kind IN ('function', 'file'))"


def _ranked(p: Projection) -> DataFrame:
    ranks = rank.pagerank(p.stored("calls").select("src", "dst"), iterations=6, tolerance=None).withColumn("pagerank", F.round("pagerank", 8))
    files = rank.link_counts(p.file_commits).select(F.concat(F.lit("file:"), "file").alias("node_id"), "commit_count")
    return p.nodes.join(ranks, "node_id", "left").join(files, "node_id", "left")


@query("nodes calls file_commits parts", f"{_HOT}, {_MARKS}, t AS (SELECT * FROM marks ORDER BY file, line, node_id, text LIMIT 25) SELECT 'hot' AS part, node_id FROM (SELECT * FROM scored ORDER BY score DESC, node_id LIMIT 5) UNION ALL SELECT 'todo', node_id FROM t")
def review_marks(p: Projection) -> DataFrame:
    parts = pack.role_review(cut(_ranked(p)), _marks(p))
    return parts["hot"].select(F.lit("hot").alias("part"), "node_id").unionByName(parts["todos"].select(F.lit("todo").alias("part"), "node_id"))


@query("nodes", "SELECT node_id FROM (SELECT node_id, coalesce(name, path) AS label, path, kind AS layer FROM nodes) WHERE contains(lower(coalesce(label, '')), 'gear') OR contains(lower(coalesce(path, '')), 'gear') OR contains(coalesce(layer, ''), 'gear')")
def view_filter(p: Projection) -> DataFrame:
    shown = p.nodes.select("node_id", F.coalesce("name", "path").alias("label"), "path", F.col("kind").alias("layer"))
    return search.view_filter(shown, " Gear").where("matches").select("node_id")


@query("nodes", "SELECT 0::BIGINT AS missing, 3::BIGINT AS stale")
def index_probe(p: Projection) -> DataFrame:
    """The index of all nodes, and three that are gone."""
    nodes = p.nodes
    gone = p.spark.createDataFrame([("func:gone/1", "one"), ("func:gone/2", "two"), ("func:gone/3", "three")], "node_id string, name string").withColumn("docstring", F.lit(None).cast("string"))
    index = search.build_index(nodes.select("node_id", "name", "docstring").unionByName(gone))
    return search.probe_index(nodes, index)


@query("nodes", "WITH f AS (SELECT count(*) FILTER (kind = 'file') AS f, count(*) FILTER (kind = 'function') AS g, count(*) FILTER (kind = 'class') AS c FROM nodes), l AS (SELECT string_agg(lang || '(' || n || ')', ', ' ORDER BY n DESC, lang) AS l FROM (SELECT lang, count(*) AS n FROM nodes WHERE kind = 'file' GROUP BY lang)) SELECT concat('Repository with ', f, ' files, ', g, ' functions, ', c, ' classes. Languages: ', l, '.') AS summary FROM f, l")
def summary_sentence(p: Projection) -> DataFrame:
    return stats.summary_sentence(p.nodes)


@query("nodes calls hierarchy structure parts", f"WITH {_ALL}, {_MARKS} SELECT (SELECT count(*) FROM (SELECT node_id FROM nodes UNION SELECT src FROM links UNION SELECT dst FROM links)) AS node_count, least((SELECT count(*) FROM marks), 1000) AS todo_total")
def overview_totals(p: Projection) -> DataFrame:
    nodes = p.nodes.withColumns({"pagerank": F.lit(0.0), "commit_count": F.lit(0), "layer": F.lit("")})
    report = stats.overview_report(nodes, _all_edges(p), _marks(p))
    return report["overview"].select("node_count").join(report["todo_total"].select(F.col("total").alias("todo_total")), F.lit(True), "left")  # one row each


_CLASSES = "b AS (SELECT c_custkey, c_name AS name, c_mktsegment AS base, c_custkey % 4 = 0 AS abs FROM customer WHERE c_custkey % 6 <> 1), a AS (SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 6 = 2 THEN 'other' ELSE c_mktsegment END AS base, (c_custkey % 4 = 0) <> (c_custkey % 30 = 3) AS abs FROM customer WHERE c_custkey % 6 <> 5)"


@query("", f"WITH {_CLASSES}, j AS (SELECT coalesce(a.name, b.name) AS name, 'm' || coalesce(a.c_custkey, b.c_custkey) % 5 AS file, a.name IS NULL AS gone, b.name IS NULL AS fresh, concat_ws(', ', CASE WHEN a.base <> b.base THEN 'inheritance changed' END, CASE WHEN a.abs <> b.abs THEN 'abstract flag changed' END) AS detail FROM b FULL JOIN a ON a.name = b.name AND a.c_custkey = b.c_custkey) SELECT 'class' AS kind, name, name AS qualified_name, file, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'modified' END AS change_type, CASE WHEN NOT fresh AND NOT gone THEN detail END AS detail FROM j WHERE fresh OR gone OR detail <> ''")
def class_diff(p: Projection) -> DataFrame:
    """Classes of changed files; the types beside them count in modified files only, where they never change."""
    key, rows = F.col("c_custkey"), p.table("customer")
    null = F.lit(None).cast("string")

    def symbols(kept: DataFrame, after: bool) -> DataFrame:
        base = F.when(F.lit(after) & (key % 6 == 2), "other").otherwise(F.col("c_mktsegment"))
        own = kept.select(F.lit("class").alias("kind"), F.col("c_name").alias("name"), F.col("c_name").alias("qualified_name"), F.concat(F.lit("m"), (key % 5).cast("string")).alias("file"), null.alias("signature"), F.lit(False).alias("is_async"), F.lit(1).alias("complexity"), F.array(base).alias("bases"), ((key % 4 == 0) != (F.lit(after) & (key % 30 == 3))).alias("is_abstract"))
        return own.unionByName(own.withColumns({"kind": F.lit("type"), "file": F.lit("new" if after else "old")}))

    status = p.spark.createDataFrame([*((f"m{k}", "M") for k in range(5)), ("new", "A"), ("old", "D")], "path string, status string")
    return diff.file_symbol_diff(symbols(rows.where("c_custkey % 6 <> 1"), False), symbols(rows.where("c_custkey % 6 <> 5"), True), status)


@query("nodes calls hierarchy structure", f"WITH {_ALL}, bad AS (SELECT DISTINCT src, dst, kind FROM links WHERE src NOT LIKE 'module:%' AND src NOT LIKE 'commit:%' AND dst NOT LIKE 'module:%' AND dst NOT LIKE 'commit:%' AND dst NOT LIKE '%:?::%' AND (src NOT IN (SELECT node_id FROM nodes) OR dst NOT IN (SELECT node_id FROM nodes))) SELECT 'node_keys' AS check, count(*) AS problems FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'edge_keys', count(*) FROM (SELECT src, dst, kind FROM links GROUP BY 1, 2, 3 HAVING count(*) > 1) UNION ALL SELECT 'orphan_edges', count(*) FROM bad UNION ALL SELECT 'stale_index', 0 UNION ALL SELECT 'freshness', 1")
def doctor(p: Projection) -> DataFrame:
    nodes = p.nodes
    config = p.spark.createDataFrame([("last_indexed_sha", "old")], "key string, value string")
    return health.doctor(nodes, _all_edges(p), search.build_index(nodes), config, head="new")
