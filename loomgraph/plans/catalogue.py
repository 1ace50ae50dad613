"""Registered queries over the projected tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff, health, incremental, lookup, pack, rank, resolve, search, stats, themes, traverse
from .projection import Projection, edges_of, with_churn, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(views: str, sql: str | None):
    """Register a function of a projection under its name, with its SQL over the projected ``views``."""

    def register(make: Callable[[Projection], DataFrame]) -> Callable:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Projection(spark, sf_dir))
        if sql is not None:
            ORACLE[make.__name__] = with_views(views, sql) if views else sql
        return make

    return register


# --- ranking and churn ---------------------------------------------------------------------------------------------

_CHURN = "churn AS (SELECT file, count(*) AS commit_count FROM file_commits GROUP BY file)"
STEPS = 6


def _pagerank_sql(edges: str, steps: int = STEPS) -> str:
    out = [f"""share AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM {edges}),
ends AS MATERIALIZED (SELECT src AS node_id FROM share UNION SELECT dst FROM share), total AS (SELECT count(*)::DOUBLE AS n FROM ends),
pr0 AS (SELECT node_id, 1.0::DOUBLE / n AS pagerank FROM ends, total)"""]
    for k in range(1, steps + 1):
        out.append(f"""g{k} AS MATERIALIZED (SELECT dst, sum(pagerank * share) AS given FROM pr{k - 1} JOIN share ON node_id = src GROUP BY dst),
pr{k} AS MATERIALIZED (SELECT e.node_id, 0.15::DOUBLE / n + 0.85::DOUBLE * (1 - (SELECT sum(given) FROM g{k})) / n + 0.85::DOUBLE * coalesce(given, 0) AS pagerank FROM ends e CROSS JOIN total LEFT JOIN g{k} ON dst = e.node_id)""")
    return ",\n".join(out)


@query("calls", f"WITH {_pagerank_sql('calls')} SELECT node_id, round(pagerank, 8) AS pagerank FROM pr{STEPS}")
def pagerank_k(p: Projection) -> DataFrame:
    ranks = rank.pagerank(p.stored("calls").select("src", "dst"), iterations=STEPS, tolerance=None)
    return ranks.select("node_id", F.round("pagerank", 8).alias("pagerank"))


@query("file_commits", f"WITH {_CHURN} SELECT file, commit_count FROM churn")
def churn_count(p: Projection) -> DataFrame:
    return rank.link_counts(p.file_commits)


@query("commits file_commits", "SELECT f.file, count(*) AS commit_count FROM (SELECT sha FROM commits ORDER BY ts DESC, sha LIMIT 1000) c JOIN file_commits f ON c.sha = f.sha GROUP BY f.file")
def churn_newest(p: Projection) -> DataFrame:
    files = p.file_commits.groupBy("sha").agg(F.collect_set("file").alias("files_changed"))
    newest = p.commits.orderBy(F.desc("ts"), "sha").limit(1000)
    return rank.churn(newest.join(files, "sha"), p.file_commits.select(F.col("file").alias("path")).distinct(), None)


_RANKED = "CASE WHEN n.kind = 'file' THEN n.path ELSE replace(n.file, 'file:', '') END"


@query(
    "nodes calls file_commits",
    f"""WITH {_CHURN}, {_pagerank_sql("calls")},
scored AS (SELECT n.node_id, n.kind, n.name, round(coalesce(pagerank, 0), 8) AS pagerank, CASE WHEN n.kind = 'file' THEN coalesce(c.commit_count, 0) ELSE 0 END AS commit_count
  FROM nodes n LEFT JOIN pr{STEPS} r ON r.node_id = n.node_id LEFT JOIN churn c ON c.file = {_RANKED} WHERE n.kind IN ('function', 'file'))
SELECT *, pagerank + 0.01::DOUBLE * commit_count AS score FROM scored ORDER BY score DESC, node_id LIMIT 20""",
)
def hot_paths(p: Projection) -> DataFrame:
    ranks = rank.pagerank(p.stored("calls").select("src", "dst"), iterations=STEPS, tolerance=None).withColumn("pagerank", F.round("pagerank", 8))
    files = rank.link_counts(p.file_commits).select(F.concat(F.lit("file:"), "file").alias("node_id"), "commit_count")
    return rank.hot_paths(p.nodes.join(ranks, "node_id", "left").join(files, "node_id", "left"))


@query("commits", "SELECT sha, author, ts, message FROM commits ORDER BY ts DESC, sha LIMIT 10")
def recent_commits(p: Projection) -> DataFrame:
    return p.commits.orderBy(F.desc("ts"), "sha").limit(10)


@query(
    "commits file_commits nodes",
    """WITH c AS (SELECT sha, message FROM commits ORDER BY ts DESC, sha LIMIT 10),
f AS (SELECT c.sha, c.message, file, row_number() OVER (PARTITION BY c.sha ORDER BY file) - 1 AS file_pos FROM c JOIN file_commits f ON c.sha = f.sha),
s AS (SELECT f.*, n.node_id, row_number() OVER (PARTITION BY sha ORDER BY file_pos, n.node_id) AS k FROM f LEFT JOIN nodes n ON n.file = 'file:' || f.file AND n.kind <> 'file' WHERE file_pos < 5)
SELECT c.sha, c.message, s.file_pos::INT AS file_pos, s.file, s.node_id FROM c LEFT JOIN s ON c.sha = s.sha WHERE k IS NULL OR k <= 20""",
)
def recent_changes(p: Projection) -> DataFrame:
    files = p.file_commits.groupBy("sha").agg(F.array_sort(F.collect_set("file")).alias("files_changed"))
    newest = p.commits.orderBy(F.desc("ts"), "sha").limit(10).join(files, "sha", "left")
    return diff.recent_changes(newest, p.nodes).select("sha", "message", "file_pos", "file", "node_id")


# --- traversal -----------------------------------------------------------------------------------------------------


@query("calls", "SELECT src AS node_id FROM calls WHERE dst = 'func:part/7'")
def direct_callers(p: Projection) -> DataFrame:
    return traverse.direct_callers(p.calls, "func:part/7")


@query("calls", "SELECT dst AS node_id FROM calls WHERE src = 'func:part/7'")
def direct_callees(p: Projection) -> DataFrame:
    return traverse.direct_callees(p.calls, "func:part/7")


def _walk_sql(edges: str, start: str, depth: int, reverse: bool = True) -> str:
    here, there = ("dst", "src") if reverse else ("src", "dst")
    return f"walk(node_id, depth) AS (SELECT {there}, 1 FROM {edges} WHERE {here} = '{start}' UNION SELECT e.{there}, w.depth + 1 FROM walk w JOIN {edges} e ON e.{here} = w.node_id WHERE w.depth < {depth})"


@query("calls", f"WITH RECURSIVE {_walk_sql('calls', 'func:part/7', 2)} SELECT node_id, min(depth)::INT AS depth FROM walk GROUP BY node_id")
def callers_depth2(p: Projection) -> DataFrame:
    return traverse.callers(p.call_sites, "func:part/7", 2)


@query("nodes calls hierarchy", f"WITH RECURSIVE links AS MATERIALIZED (SELECT * FROM calls UNION ALL SELECT * FROM hierarchy), {_walk_sql('links', 'func:part/7', 3)} SELECT w.node_id, any_value(n.kind) AS kind, any_value(n.file) AS file, min(w.depth)::INT AS depth FROM walk w LEFT JOIN nodes n ON w.node_id = n.node_id GROUP BY w.node_id")
def impact_analysis_d3(p: Projection) -> DataFrame:
    return traverse.impact(edges_of(p.call_sites, p.import_sites), p.nodes, "func:part/7", 3).select("node_id", "kind", "file", "depth")


@query(
    "nodes hierarchy",
    f"WITH RECURSIVE {_walk_sql('hierarchy', 'file:region/1', 3)} SELECT count(DISTINCT w.node_id) AS affected, count(DISTINCT n.file) AS affected_files, count(DISTINCT CASE WHEN n.kind = 'test' THEN w.node_id END) AS affected_tests, count(DISTINCT w.node_id) AS blast_radius FROM walk w LEFT JOIN nodes n ON w.node_id = n.node_id",
)
def impact_summary_dag(p: Projection) -> DataFrame:
    return traverse.impact_summary(traverse.impact(p.import_sites, p.nodes, "file:region/1", 3))


@query("hierarchy", f"WITH RECURSIVE {_walk_sql('hierarchy', 'file:order/1', 2, False)} SELECT DISTINCT node_id FROM walk")
def file_dependencies(p: Projection) -> DataFrame:
    return traverse.file_dependencies(p.import_sites, "file:order/1", 3)


@query("hierarchy", f"WITH RECURSIVE {_walk_sql('hierarchy', 'file:order/1', 3, False)} SELECT DISTINCT node_id FROM walk")
def file_dependencies_inclusive(p: Projection) -> DataFrame:
    return traverse.file_dependencies(p.import_sites, "file:order/1", 3, inclusive=True)


@query(
    "hierarchy",
    f"""WITH RECURSIVE {_walk_sql("hierarchy", "file:order/1", 1, False)}, d AS (SELECT DISTINCT dst AS node_id FROM hierarchy WHERE src = 'file:order/1')
SELECT replace(node_id, 'file:', '') AS target, 'direct' AS how, (SELECT count(*) FROM d) AS direct_count FROM d UNION ALL SELECT DISTINCT replace(node_id, 'file:', ''), 'transitive', (SELECT count(*) FROM d) FROM walk""",
)
def direct_and_transitive_deps(p: Projection) -> DataFrame:
    return traverse.dependencies(p.import_sites, "file:order/1", 2)


@query("hierarchy", "SELECT DISTINCT replace(src, 'file:', '') AS file FROM hierarchy WHERE dst = 'file:nation/3' ORDER BY file LIMIT 10")
def imported_by(p: Projection) -> DataFrame:
    return traverse.importers(p.hierarchy, "file:nation/3")


# --- resolution ----------------------------------------------------------------------------------------------------

_OPEN = """functions AS (SELECT concat('func:', brand, '::', owner, '.', name) AS node_id, name, concat(owner, '.', name) AS qualified_name, concat('file:', brand) AS file
  FROM (SELECT DISTINCT replace(p_brand, '#', '') AS brand, p_type AS owner, concat(replace(p_name, ' ', '_'), '#', CAST(p_size AS {s})) AS name FROM part) x),
open_calls AS (SELECT DISTINCT concat('func:', replace(a.p_brand, '#', ''), '::', a.p_type, '.', replace(a.p_name, ' ', '_'), '#', CAST(a.p_size AS {s})) AS src,
  concat('func:?::', replace(b.p_name, ' ', '_'), '#', CAST(b.p_size AS {s})) AS dst, (b.p_partkey % 3 = 0) AS self_call
  FROM (SELECT *, unnest([(p_partkey * 7 + 3) % (SELECT count(*) FROM part), p_partkey + 1]) AS callee FROM part) a JOIN part b ON b.p_partkey = a.callee)"""


@query(
    "",
    f"""WITH {_OPEN.format(s="VARCHAR")},
u AS (SELECT name, min(node_id) AS id FROM functions GROUP BY name HAVING count(*) = 1), s AS (SELECT name, file, min(node_id) AS id FROM functions GROUP BY name, file HAVING count(*) = 1),
c AS (SELECT o.src, o.self_call, substr(o.dst, 9) AS callee, f.file, regexp_extract(o.src, '^(func:[^:]*::)', 1) || regexp_extract(f.qualified_name, '^(.*)\\.[^.]*$', 1) || '.' || substr(o.dst, 9) AS own FROM open_calls o LEFT JOIN functions f ON o.src = f.node_id),
r AS (SELECT c.src, CASE WHEN c.self_call AND w.node_id IS NOT NULL AND w.node_id <> c.src THEN w.node_id WHEN u.id IS NOT NULL THEN u.id ELSE s.id END AS dst,
  CASE WHEN c.self_call AND w.node_id IS NOT NULL AND w.node_id <> c.src THEN 'own' WHEN u.id IS NOT NULL THEN 'unique' ELSE 'same_file' END AS rule
  FROM c LEFT JOIN functions w ON w.node_id = c.own LEFT JOIN u ON u.name = c.callee LEFT JOIN s ON s.name = c.callee AND s.file = c.file)
SELECT src, dst, rule FROM r WHERE dst IS NOT NULL AND dst <> src""",
)
def resolve_calls(p: Projection) -> DataFrame:
    part = p.table("part")
    brand, name = F.replace("p_brand", F.lit("#"), F.lit("")), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("#"), F.col("p_size").cast("string"))
    symbol = part.select("p_partkey", brand.alias("brand"), F.col("p_type").alias("owner"), name.alias("name"))
    node = F.concat(F.lit("func:"), "brand", F.lit("::"), "owner", F.lit("."), "name")
    functions = symbol.select("brand", "owner", "name").distinct().select(node.alias("node_id"), "name", F.concat("owner", F.lit("."), "name").alias("qualified_name"), F.concat(F.lit("file:"), "brand").alias("file"))
    targets = F.array((F.col("p_partkey") * 7 + 3) % F.lit(part.count()), F.col("p_partkey") + 1)
    callers = symbol.select(node.alias("src"), F.explode(targets).alias("callee_key"))
    callees = symbol.select(F.col("p_partkey").alias("callee_key"), F.concat(F.lit("func:?::"), "name").alias("dst"), (F.col("p_partkey") % 3 == 0).alias("self_call"))
    calls = callers.join(callees, "callee_key").select("src", "dst", F.lit("calls").alias("kind"), "self_call", F.lit(False).alias("resolved")).distinct()
    return resolve.resolve_calls(calls, functions).select("src", "dst", "rule")


@query(
    "",
    """WITH classes AS (SELECT concat('class:', CAST(s_suppkey AS VARCHAR)) AS node_id, concat('Nation', CAST(s_nationkey AS VARCHAR)) AS name FROM supplier), u AS (SELECT name, min(node_id) AS id FROM classes GROUP BY name HAVING count(*) = 1)
SELECT DISTINCT concat('class:c', CAST(c_custkey AS VARCHAR)) AS src, coalesce(u.id, concat('class:?::Nation', CAST(c_nationkey AS VARCHAR))) AS dst, u.id IS NOT NULL AS resolved FROM customer LEFT JOIN u ON u.name = concat('Nation', CAST(c_nationkey AS VARCHAR))""",
)
def resolve_inherits(p: Projection) -> DataFrame:
    classes = p.table("supplier").select(F.concat(F.lit("class:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.concat(F.lit("Nation"), F.col("s_nationkey").cast("string")).alias("name"))
    edges = p.table("customer").select(F.concat(F.lit("class:c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("class:?::Nation"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("inherits").alias("kind"), F.lit(False).alias("resolved"))
    return resolve.resolve_inherits(edges, classes).select("src", "dst", "resolved").distinct()


# --- lookup and search ---------------------------------------------------------------------------------------------

_LOCATED = "node_id, kind, coalesce(name, '') AS name, coalesce(file, path, '') AS file, coalesce(line_start, 0) AS line_start, signature, docstring"


@query("nodes", f"SELECT {_LOCATED} FROM nodes WHERE name = 'red_widget' AND kind = 'function'")
def symbol_exact(p: Projection) -> DataFrame:
    return lookup.locate(lookup.by_name(p.nodes, "red_widget", "function"))


@query("nodes", "SELECT node_id, name FROM nodes WHERE name ILIKE 'red_%' ORDER BY node_id LIMIT 20")
def symbol_prefix(p: Projection) -> DataFrame:
    return lookup.by_prefix(p.nodes, "red_").select("node_id", "name")


def _postings_sql() -> str:
    fold = f"translate(lower(%s), '{text.MARKED}', '{text.PLAIN}')"
    words = f"[x FOR x IN regexp_split_to_array({fold}, '[^\\p{{L}}\\p{{N}}]+') IF x <> '']"
    column = lambda name, value: f"SELECT node_id, '{name}' AS col, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT node_id, {words % value} AS w FROM texts)"
    return f"postings AS MATERIALIZED ({column('name', 'name')} UNION ALL {column('docstring', "coalesce(docstring, '')")})"


def _hits(term: str, column: str | None = None) -> str:
    return f"SELECT DISTINCT node_id FROM postings WHERE {term}" + (f" AND col = '{column}'" if column else "")


_DOC_TEXTS = "texts AS (SELECT concat('doc:', CAST(doc_id AS VARCHAR)) AS node_id, source AS name, text AS docstring FROM documents WHERE source IS NOT NULL)"


def _document_nodes(p: Projection) -> DataFrame:
    return p.table("documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), F.col("source").alias("name"), F.col("text").alias("docstring"))


def _full_text(name: str, ask: str, sql: str) -> None:
    def run(p: Projection) -> DataFrame:
        return search.match(search.build_index(_document_nodes(p), length=None), ask).select("node_id")

    run.__name__ = name
    query("", f"WITH {_DOC_TEXTS}, {_postings_sql()} {sql}")(run)


_full_text("fts_and", "the that AND en", f"{_hits("token = 'the'")} INTERSECT {_hits("token = 'that'")} INTERSECT {_hits("token = 'en'")}")
_full_text("fts_or", "thion OR letre", f"{_hits("token = 'thion'")} UNION {_hits("token = 'letre'")}")
_full_text("fts_not", "de NOT les", f"{_hits("token = 'de'")} EXCEPT {_hits("token = 'les'")}")
_full_text("fts_prefix", "name:src1*", _hits("starts_with(token, 'src1')", "name"))
_full_text("fts_phrase", '"of the"', "SELECT DISTINCT a.node_id FROM postings a JOIN postings b ON a.node_id = b.node_id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the'")
_full_text("fts_grouped", "(elan OR ouer) AND NOT_A_WORD OR éau", f"({_hits("token = 'elan'")} UNION {_hits("token = 'ouer'")}) INTERSECT (SELECT DISTINCT a.node_id FROM postings a JOIN postings b USING (node_id, col) JOIN postings c USING (node_id, col) WHERE a.token = 'not' AND b.token = 'a' AND c.token = 'word' AND b.pos = a.pos + 1 AND c.pos = a.pos + 2) UNION {_hits("token = 'eau'")}")


@query("nodes", f"WITH texts AS (SELECT node_id, name, substr(docstring, 1, 500) AS docstring FROM nodes WHERE name IS NOT NULL), {_postings_sql()}, hit AS (SELECT DISTINCT a.node_id FROM postings a JOIN postings b USING (node_id, col) WHERE a.token = 'widget' AND b.token = 'of' AND b.pos = a.pos + 1 ORDER BY node_id LIMIT 10), e AS (SELECT node_id, name, 1 AS priority FROM nodes WHERE name = '\"widget of\"' UNION ALL (SELECT node_id, name, 2 FROM nodes WHERE name ILIKE '\"widget of\"%' ORDER BY node_id LIMIT 10) UNION ALL SELECT n.node_id, name, 3 FROM nodes n JOIN hit USING (node_id)) SELECT * FROM e WHERE priority = (SELECT min(priority) FROM e)")
def find_definition_cascade(p: Projection) -> DataFrame:
    nodes = p.nodes
    return lookup.find_definition(nodes, search.build_index(nodes), '"widget of"').select("node_id", "name", "priority")


@query("nodes", "SELECT count(*) AS indexed FROM nodes WHERE name IS NOT NULL")
def fts_index_size(p: Projection) -> DataFrame:
    return search.index_size(p.nodes)


@query("nodes", "SELECT node_id, name FROM nodes WHERE kind <> 'file' AND (contains(lower(coalesce(name, '')), 'gear') OR contains(lower(coalesce(docstring, '')), 'gear')) ORDER BY node_id LIMIT 20")
def substring_search(p: Projection) -> DataFrame:
    return search.substring(p.nodes, "Gear").select("node_id", "name")


@query("nodes", "SELECT node_id, name FROM nodes WHERE kind IN ('function', 'class', 'type') AND NOT starts_with(coalesce(name, ''), '_') AND (kind = 'class' OR NOT contains(coalesce(qualified_name, ''), '.'))")
def public_api(p: Projection) -> DataFrame:
    return lookup.public_api(p.nodes).select("node_id", "name")


@query("nodes", "SELECT node_id, line_start FROM nodes WHERE kind IN ('function', 'class') AND file = 'file:region/2' ORDER BY line_start, node_id")
def file_symbols(p: Projection) -> DataFrame:
    return lookup.file_symbols(p.nodes, "file:region/2").select("node_id", "line_start")


@query("nodes tests", "SELECT t.src AS node_id, n.name, n.file, coalesce(t.confidence, 0) AS confidence FROM tests t LEFT JOIN nodes n ON n.node_id = t.src WHERE t.dst = 'func:part/12'")
def test_coverage(p: Projection) -> DataFrame:
    return lookup.test_coverage(p.nodes, p.tests, "func:part/12")


@query("nodes calls", "SELECT n.node_id, n.name, count(c.src) AS callers FROM nodes n LEFT JOIN calls c ON c.dst = n.node_id WHERE n.kind = 'function' GROUP BY 1, 2")
def caller_counts(p: Projection) -> DataFrame:
    return lookup.caller_counts(p.nodes, p.calls)


@query("nodes", "SELECT node_id, name FROM nodes WHERE kind IN ('function', 'class') AND coalesce(docstring, '') = ''")
def enrichment_candidates(p: Projection) -> DataFrame:
    return lookup.enrichment_candidates(p.nodes.withColumn("llm_summary", F.lit(None).cast("string"))).select("node_id", "name")


@query("nodes", "WITH k AS (SELECT node_id, sha256(node_id || '|' || coalesce(signature, '') || '|' || coalesce(docstring, '')) AS cache_key FROM nodes WHERE kind = 'function') SELECT cache_key, node_id, CAST(floor((row_number() OVER (PARTITION BY substr(cache_key, 1, 2) ORDER BY cache_key, node_id) - 1) / 20) AS BIGINT) AS batch FROM k WHERE node_id NOT LIKE '%5'")
def cache_misses(p: Projection) -> DataFrame:
    functions = p.nodes.where("kind = 'function'")
    key = text.cache_key(F.col("node_id"), F.col("signature"), F.col("docstring"))
    cached = functions.where("node_id like '%5'").select(key.alias("cache_key"))
    return lookup.batches(functions, cached, key).select("cache_key", "node_id", "batch")


# --- aggregates ----------------------------------------------------------------------------------------------------

_ALL = "links AS (SELECT * FROM calls UNION ALL SELECT * FROM hierarchy UNION ALL SELECT * FROM structure)"


def _all_edges(p: Projection) -> DataFrame:
    return edges_of(p.calls, p.hierarchy, p.structure)


@query("nodes", "SELECT k.kind, count(n.node_id) AS n FROM (VALUES ('file'), ('class'), ('function'), ('type'), ('test')) k(kind) LEFT JOIN nodes n ON n.kind = k.kind GROUP BY k.kind")
def kind_counts(p: Projection) -> DataFrame:
    return rank.kind_counts(p.nodes, ("file", "class", "function", "type", "test"))


@query(
    "nodes calls hierarchy structure",
    f"""WITH {_ALL} SELECT count(*) FILTER (kind = 'file') AS file_count, count(*) FILTER (kind = 'class') AS class_count, count(*) FILTER (kind = 'function') AS function_count, count(*) FILTER (kind = 'type') AS type_count,
count(*) FILTER (kind = 'file' AND is_test) AS test_file_count, (SELECT count(*) FROM links) AS edge_count, (SELECT count(*) FROM (SELECT node_id FROM nodes UNION SELECT src FROM links UNION SELECT dst FROM links)) AS node_count FROM nodes""",
)
def overview(p: Projection) -> DataFrame:
    return stats.overview(p.nodes, _all_edges(p))


_LAYER = "CASE " + " ".join(f"WHEN regexp_matches(path, '{rule}') THEN '{name}'" for name, rule in text.LAYER_RULES) + " ELSE 'unknown' END"


@query("nodes", f"SELECT node_id, path, {_LAYER} AS layer FROM nodes WHERE kind = 'file'")
def layer_detect(p: Projection) -> DataFrame:
    return p.nodes.where("kind = 'file'").select("node_id", "path", text.detect_layer(F.col("path")).alias("layer"))


def _layered(p: Projection) -> DataFrame:
    return p.nodes.withColumn("layer", F.when(F.col("kind") == "file", text.detect_layer(F.col("path"))))


@query("nodes", f"SELECT {_LAYER} AS layer, count(*) AS files FROM nodes WHERE kind = 'file' GROUP BY 1")
def layers(p: Projection) -> DataFrame:
    return stats.layer_sizes(_layered(p))


@query("nodes", f"SELECT layer, node_id FROM (SELECT {_LAYER} AS layer, node_id, row_number() OVER (PARTITION BY {_LAYER} ORDER BY node_id) AS k FROM nodes WHERE kind = 'file') WHERE k <= 50")
def layer_members(p: Projection) -> DataFrame:
    return stats.layers(_layered(p), 50)


_STYLE = "CASE WHEN coalesce(name, '') = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(name, '{r}') THEN '{n}'" for n, r in text.NAMING_RULES) + " ELSE 'other' END"
_NAMES = "SELECT name FROM nodes WHERE kind = 'function' AND NOT (starts_with(name, 'test_') OR starts_with(name, 'Test'))"


@query("nodes", f"SELECT {_STYLE} AS style, count(*) AS n FROM ({_NAMES}) GROUP BY 1")
def naming_styles(p: Projection) -> DataFrame:
    return stats.styles(stats.function_names(p.nodes), "name")


@query("nodes", f"SELECT style AS dominant FROM (SELECT {_STYLE} AS style, count(*) AS n FROM ({_NAMES}) GROUP BY 1) WHERE style NOT IN ('other', 'unknown') ORDER BY n DESC, style LIMIT 1")
def dominant_style(p: Projection) -> DataFrame:
    return stats.dominant(stats.styles(stats.function_names(p.nodes), "name"))


@query("nodes", "WITH s AS (SELECT split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1) AS stem FROM nodes WHERE kind = 'file') SELECT CASE WHEN contains(stem, '-') THEN 'kebab-case' WHEN contains(stem, '_') THEN 'snake_case' WHEN upper(substr(stem, 1, 1)) = substr(stem, 1, 1) AND lower(substr(stem, 1, 1)) <> substr(stem, 1, 1) THEN 'PascalCase' WHEN lower(stem) = stem AND upper(stem) <> stem THEN 'lowercase' ELSE 'camelCase' END AS style, count(*) AS n FROM s GROUP BY 1")
def file_naming(p: Projection) -> DataFrame:
    return stats.styles(p.nodes.where("kind = 'file'"), "path", text.file_naming_style(F.col("path")))


@query("nodes", "SELECT kind, count(*) AS total, count(*) FILTER (coalesce(docstring, '') <> '') AS documented, round_even(100.0::DOUBLE * count(*) FILTER (coalesce(docstring, '') <> '') / count(*), 0) AS pct FROM nodes WHERE kind IN ('function', 'class') AND is_exported GROUP BY kind")
def doc_coverage(p: Projection) -> DataFrame:
    return stats.doc_coverage(p.nodes)


def _pct(part: str) -> str:
    return f"round_even(100.0::DOUBLE * count(*) FILTER ({part}) / count(*), 0) AS {part[3:]}_pct"


@query("nodes", f"SELECT count(*) AS functions, {', '.join(f'count(*) FILTER ({f}) AS {f[3:]}_count' for f in stats.FLAGS)}, count(*) FILTER (contains(signature, 'Result')) AS result_returns, count(*) FILTER (contains(signature, 'Optional')) AS optional_returns, {', '.join(map(_pct, stats.FLAGS))} FROM nodes WHERE kind = 'function'")
def pattern_counts(p: Projection) -> DataFrame:
    return stats.pattern_counts(p.nodes)


@query("nodes", f"SELECT count(*) AS classes, count(*) FILTER (is_abstract) AS abstract_count, count(*) FILTER (is_dataclass) AS dataclass_count, {_pct('is_abstract')}, {_pct('is_dataclass')} FROM nodes WHERE kind = 'class'")
def class_patterns(p: Projection) -> DataFrame:
    return stats.class_patterns(p.nodes)


@query("nodes", "SELECT round(avg(complexity), 1) AS avg_complexity, max(complexity) AS max_complexity, min(complexity) AS min_complexity, count(*) FILTER (complexity > 10) AS high, count(*) FILTER (complexity > 5 AND complexity <= 10) AS medium FROM nodes WHERE kind = 'function'")
def complexity_stats(p: Projection) -> DataFrame:
    return stats.complexity_stats(p.nodes)


@query("nodes", "SELECT node_id, name, complexity FROM nodes WHERE kind = 'function' AND complexity > 10 ORDER BY complexity DESC, node_id LIMIT 10")
def most_complex(p: Projection) -> DataFrame:
    return stats.most_complex(p.nodes)


@query("", "SELECT split_part(split_part(split_part(url, '://', 2), '.', 1), '/', 1) AS package, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, package LIMIT 15")
def top_imports(p: Projection) -> DataFrame:
    module = F.split_part("url", F.lit("://"), F.lit(2))
    return stats.top_imports(p.table("pages").select(F.lit("imports").alias("kind"), module.alias("module")))


@query("nodes", "SELECT lang, count(*) AS files, sum(line_count)::BIGINT AS lines FROM nodes WHERE kind = 'file' GROUP BY lang ORDER BY files DESC, lang")
def language_stats(p: Projection) -> DataFrame:
    return stats.languages(p.nodes)


@query("nodes", "WITH c AS (SELECT count(*) FILTER (kind = 'file' AND is_test) AS test_files, count(*) FILTER (kind = 'file' AND NOT is_test) AS code_files, count(*) FILTER (kind = 'function' AND regexp_matches(name, '^(test_|Test)')) AS test_functions FROM nodes) SELECT *, round_even(100.0::DOUBLE * test_files / code_files, 0) AS ratio_pct FROM c")
def test_stats(p: Projection) -> DataFrame:
    return stats.test_stats(p.nodes)


_MARKS = ("LICENSE", "LICENSED", "RELEASED", "COPYRIGHT", "PERMISSION")
_MARK = text.todo_pattern(kinds=_MARKS, prefix=r"\b")
_TODO = f"""todo AS (SELECT doc_id, line::INT AS line, upper(regexp_extract(content, '{_MARK}', 1)) AS kind, trim(regexp_extract(content, '{_MARK}', 2)) AS text
  FROM (SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM documents)) WHERE regexp_matches(content, '{_MARK}'))"""


def _todos(p: Projection) -> DataFrame:
    return stats.extract_todos(p.table("documents").select("doc_id", "text"), _MARK)


@query("", f"WITH {_TODO} SELECT doc_id, line, kind, text FROM todo")
def todo_scan(p: Projection) -> DataFrame:
    return _todos(p)


@query("", f"WITH {_TODO} SELECT kind, count(*) AS n FROM todo GROUP BY kind")
def todo_by_kind(p: Projection) -> DataFrame:
    return stats.todo_by_kind(_todos(p))


@query("", f"WITH {_TODO} SELECT 'doc:' || doc_id AS file, count(*) AS n FROM todo GROUP BY 1 ORDER BY n DESC, file LIMIT 10")
def todo_hotspots(p: Projection) -> DataFrame:
    return stats.todo_hotspots(_todos(p).withColumn("file", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))))


# --- themes --------------------------------------------------------------------------------------------------------

#: The default vocabulary is for review comments; these words occur in the tables' conversations.
WORDS: dict[str, tuple[str, ...]] = {"ending": ("tion[ .,]", "ment[ .,]"), "article": ("(^| )(the|les) ", "(^| )der "), "asking": ("(^| )wh[a-z]+", "(^| )que ")}
_TAG = "tagged AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS theme FROM comments WHERE regexp_matches(body, '(?i){'|'.join(f'(?:{x})' for x in v)}')" for k, v in WORDS.items()) + ")"


@query("comments", f"WITH {_TAG} SELECT theme, count(*) AS n FROM tagged GROUP BY theme")
def theme_counts(p: Projection) -> DataFrame:
    return themes.theme_counts(p.comments, WORDS)


@query("comments", f"WITH {_TAG}, k AS (SELECT theme, row_number() OVER (PARTITION BY theme ORDER BY seq)::INT AS k, substr(trim(body), 1, 120) AS example FROM tagged) SELECT * FROM k WHERE k <= 3")
def theme_examples(p: Projection) -> DataFrame:
    return themes.theme_examples(p.comments, WORDS)


@query("comments", f"WITH {_TAG}, f AS (SELECT DISTINCT theme, path FROM tagged WHERE source = 'inline'), k AS (SELECT theme, path, row_number() OVER (PARTITION BY theme ORDER BY path)::INT AS k FROM f) SELECT * FROM k WHERE k <= 5")
def theme_files(p: Projection) -> DataFrame:
    return themes.theme_files(p.comments, WORDS)


@query("comments", "SELECT login, count(*) AS n FROM comments WHERE coalesce(body, '') <> '' GROUP BY login ORDER BY n DESC, login LIMIT 5")
def top_reviewers(p: Projection) -> DataFrame:
    return themes.top_reviewers(p.comments)


# --- diff ----------------------------------------------------------------------------------------------------------

_BEFORE = "before AS (SELECT name, signature, CAST(size AS INT) AS complexity, p_partkey % 7 = 0 AS is_async, path AS file, concat(path, '.', name) AS qn FROM parts WHERE p_partkey % 10 <> 1)"
_AFTER = "after AS (SELECT name, CASE WHEN p_partkey % 10 = 2 THEN concat(signature, '!') ELSE signature END AS signature, CAST(size + p_partkey % 5 AS INT) AS complexity, p_partkey % 7 = 0 AS is_async, path AS file, concat(path, '.', name) AS qn FROM parts WHERE p_partkey % 10 <> 3)"
_CHANGES = f"""{_BEFORE}, {_AFTER}, both_sides AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.qn, b.qn) AS qualified_name, coalesce(a.file, b.file) AS file, b.qn IS NULL AS is_new, a.qn IS NULL AS is_gone,
  concat_ws(', ', CASE WHEN a.signature <> b.signature THEN 'signature changed' END, CASE WHEN abs(a.complexity - b.complexity) >= 3 THEN 'complexity ' || b.complexity || '→' || a.complexity END) AS detail FROM before b FULL JOIN after a ON a.qn = b.qn AND a.file = b.file),
changes AS (SELECT 'function' AS kind, name, qualified_name, file, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'modified' END AS change_type, CASE WHEN NOT is_new AND NOT is_gone THEN detail END AS detail FROM both_sides WHERE is_new OR is_gone OR detail <> '')"""


def _symbols(p: Projection, after: bool) -> DataFrame:
    key = F.col("p_partkey")
    rows = p.parts.where(key % 10 != (3 if after else 1))
    signature = F.when(F.lit(after) & (key % 10 == 2), F.concat("signature", F.lit("!"))).otherwise(F.col("signature"))
    complexity = (F.col("size") + (key % 5 if after else 0)).cast("int")
    return rows.select(F.lit("function").alias("kind"), "name", F.concat("path", F.lit("."), "name").alias("qualified_name"), F.col("path").alias("file"), signature.alias("signature"), (key % 7 == 0).alias("is_async"), complexity.alias("complexity"), F.lit(None).cast("array<string>").alias("bases"), F.lit(None).cast("boolean").alias("is_abstract"))


def _changes(p: Projection) -> DataFrame:
    return diff.symbol_diff(_symbols(p, False), _symbols(p, True))


@query("parts", f"WITH {_CHANGES} SELECT * FROM changes")
def symbol_diff(p: Projection) -> DataFrame:
    return _changes(p)


@query("parts", f"WITH {_CHANGES} SELECT count(DISTINCT file) AS files_changed, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'modified') AS modified FROM changes")
def diff_summary(p: Projection) -> DataFrame:
    return diff.diff_summary(_changes(p))


_RADIUS = """symbols AS (SELECT DISTINCT name AS symbol FROM parts WHERE p_partkey % 50 = 1), named AS (SELECT coalesce(qualified_name, name) AS symbol, min(node_id) AS dst FROM nodes WHERE coalesce(qualified_name, name) IS NOT NULL GROUP BY 1),
links AS (SELECT src, dst FROM calls UNION SELECT src, dst FROM structure WHERE kind = 'defines'),
radius AS (SELECT DISTINCT s.symbol, coalesce(n.qualified_name, n.name, l.src) AS caller FROM symbols s JOIN named USING (symbol) JOIN links l USING (dst) LEFT JOIN nodes n ON n.node_id = l.src)"""


def _radius(p: Projection) -> DataFrame:
    changed = p.parts.where("p_partkey % 50 = 1").select("name", F.lit(None).cast("string").alias("qualified_name"))
    return diff.blast_radius(changed, p.nodes, edges_of(p.calls, p.structure))


@query("parts nodes calls structure", f"WITH {_RADIUS} SELECT * FROM radius WHERE caller <> symbol")
def diff_blast_radius(p: Projection) -> DataFrame:
    return _radius(p)


@query("parts nodes calls structure", f"WITH {_RADIUS} SELECT symbol, count(*) AS callers FROM radius WHERE caller <> symbol GROUP BY symbol")
def diff_affected(p: Projection) -> DataFrame:
    return diff.affected(_radius(p))


@query("", "WITH b AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), a AS (SELECT 'doc/' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' ELSE 'M' END AS status FROM b FULL JOIN a USING (path) WHERE b.path IS NULL OR a.path IS NULL OR a.h <> b.h")
def changed_files(p: Projection) -> DataFrame:
    docs = p.table("documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    before = docs.where("doc_id % 10 <> 1").select("path", F.sha2("text", 256).alias("sha256"))
    after = docs.where("doc_id % 10 <> 3").select("path", F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return diff.changed_files(before, after)


@query("", "SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 10 IN (2, 3)")
def hash_skip(p: Projection) -> DataFrame:
    docs = p.table("documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    known = docs.where("doc_id % 10 <> 3").withColumn("sha256", F.when(F.col("doc_id") % 10 == 2, "old").otherwise(F.col("sha256")))
    return incremental.changed(docs, known).select("path")


# --- packs and views -----------------------------------------------------------------------------------------------

_MODULES = f"""{_CHURN}, indeg AS (SELECT dst, count(*) AS d FROM links GROUP BY dst),
modules AS (SELECT n.node_id, n.path, n.lang, coalesce(c.commit_count, 0) + 2 * coalesce(i.d, 0) AS score FROM nodes n LEFT JOIN churn c ON c.file = n.path LEFT JOIN indeg i ON i.dst = n.node_id WHERE n.kind = 'file' ORDER BY score DESC, node_id LIMIT 60)"""


def _churned(p: Projection) -> DataFrame:
    return with_churn(p.nodes, rank.link_counts(p.file_commits))


@query("nodes calls hierarchy structure file_commits", f"WITH {_ALL}, {_MODULES}, t AS (SELECT *, greatest(1, floor(length(concat_ws(' ', path, lang, score::VARCHAR)) / 4))::INT AS tokens FROM modules), s AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, node_id ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_so_far FROM t) SELECT * FROM s WHERE tokens_so_far <= 300")
def top_modules_budget(p: Projection) -> DataFrame:
    return pack.modules_in_budget(_churned(p), _all_edges(p), 300)


@query("nodes structure", "WITH k AS (SELECT n.node_id, n.name, replace(n.file, 'file:', '') AS file, count(e.src) AS subclasses FROM nodes n LEFT JOIN structure e ON e.dst = n.node_id AND e.kind = 'inherits' WHERE n.kind = 'class' GROUP BY 1, 2, 3 ORDER BY subclasses DESC, node_id LIMIT 40), t AS (SELECT *, greatest(1, floor(length(concat_ws(' ', name, file, subclasses::VARCHAR)) / 4))::INT AS tokens FROM k), s AS (SELECT *, sum(tokens) OVER (ORDER BY subclasses DESC, node_id ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_so_far FROM t) SELECT * FROM s WHERE tokens_so_far <= 60")
def key_classes_budget(p: Projection) -> DataFrame:
    return pack.classes_in_budget(p.nodes, p.structure, 60)


@query("nodes", "WITH c AS (SELECT node_id, name, complexity, name LIKE 'test_%' AS is_focus FROM nodes WHERE kind = 'function' ORDER BY complexity DESC, node_id LIMIT 40), k AS (SELECT *, row_number() OVER (PARTITION BY is_focus ORDER BY complexity DESC, node_id) AS k, (SELECT count(*) FROM c WHERE is_focus) AS nf FROM c) SELECT node_id, name, complexity, is_focus, (CASE WHEN is_focus THEN k ELSE nf + k END)::BIGINT AS position FROM k WHERE is_focus OR k <= greatest(0, 15 - nf)")
def focus_reorder(p: Projection) -> DataFrame:
    rows = p.nodes.where("kind = 'function'").select("node_id", "name", "complexity").orderBy(F.desc("complexity"), "node_id").limit(40)
    return pack.focus_first(rows, F.col("name").startswith("test"), [F.desc("complexity"), F.asc("node_id")], 15)


@query("nodes", f"WITH f AS (SELECT node_id, {_LAYER} AS layer FROM nodes WHERE kind = 'file'), one AS (SELECT min(node_id) AS node_id FROM f WHERE layer = 'data') SELECT f.node_id, f.layer FROM f WHERE f.layer = 'data' AND f.node_id <> (SELECT node_id FROM one) ORDER BY f.node_id LIMIT 8")
def similar_files(p: Projection) -> DataFrame:
    nodes = _layered(p)
    first = nodes.where("kind = 'file' and layer = 'data'").agg(F.min("node_id")).first()[0]
    return pack.similar_files(nodes, first)


@query("nodes calls", "WITH one AS (SELECT file FROM nodes WHERE node_id = 'func:part/20') SELECT DISTINCT o.name AS \"function\", replace(c.file, 'file:', '') AS caller_file FROM nodes o JOIN calls e ON e.dst = o.node_id JOIN nodes c ON c.node_id = e.src WHERE o.kind = 'function' AND o.file = (SELECT file FROM one) AND NOT starts_with(o.name, '_') AND coalesce(c.file, '') <> '' AND c.file <> o.file")
def external_callers(p: Projection) -> DataFrame:
    nodes = p.nodes
    file = nodes.where("node_id = 'func:part/20'").select("file").first()[0]
    return pack.external_callers(nodes, p.calls, file)


@query("nodes file_commits", f"WITH {_CHURN} SELECT node_id, name, complexity * (1 + coalesce(commit_count, 0)) AS risk FROM nodes n LEFT JOIN churn c ON c.file = {_RANKED} WHERE n.kind = 'function' ORDER BY risk DESC, node_id LIMIT 10")
def role_debug(p: Projection) -> DataFrame:
    return pack.role_debug(_churned(p))


@query("nodes", "SELECT node_id, name FROM nodes WHERE kind IN ('function', 'class', 'type') AND NOT starts_with(coalesce(name, ''), '_') AND (kind = 'class' OR NOT contains(coalesce(qualified_name, ''), '.')) ORDER BY name, node_id LIMIT 30")
def role_review(p: Projection) -> DataFrame:
    marks = p.spark.createDataFrame([], "node_id string, file string, line int, kind string, text string")
    nodes = p.nodes.withColumns({"pagerank": F.lit(0.0), "commit_count": F.lit(0).cast("bigint")})
    return pack.role_review(nodes, marks)["api"].select("node_id", "name").limit(30)


@query("nodes calls hierarchy structure file_commits", f"WITH {_ALL}, {_MODULES} SELECT * FROM modules ORDER BY NOT starts_with(path, 'tests'), score DESC, node_id LIMIT 10")
def role_feature(p: Projection) -> DataFrame:
    nodes = _churned(p).withColumn("layer", F.when(F.col("kind") == "file", text.detect_layer(F.col("path"))))
    return pack.role_feature(nodes, _all_edges(p), "file:none")["modules"].limit(10)


@query("nodes structure calls", f"WITH {_pagerank_sql('calls')}, f AS (SELECT node_id, {_LAYER} AS layer, row_number() OVER (PARTITION BY {_LAYER} ORDER BY node_id) AS k FROM nodes WHERE kind = 'file'), h AS (SELECT n.node_id FROM nodes n LEFT JOIN pr{STEPS} r USING (node_id) WHERE kind IN ('function', 'file') ORDER BY round(coalesce(pagerank, 0), 8) DESC, n.node_id LIMIT 80) SELECT 'file:' || n.path AS src, e.node_id AS dst FROM f JOIN nodes n ON n.node_id = f.node_id JOIN nodes e ON e.file = f.node_id JOIN h ON h.node_id = e.node_id WHERE f.k <= 50")
def graph_view(p: Projection) -> DataFrame:
    """Without a history, so functions are the hottest."""
    ranks = rank.pagerank(p.stored("calls").select("src", "dst"), iterations=STEPS, tolerance=None).withColumn("pagerank", F.round("pagerank", 8))
    nodes = _layered(p).join(ranks, "node_id", "left").withColumn("commit_count", F.lit(0).cast("bigint"))
    return pack.graph_view(nodes, p.structure)[1]


# --- health, spans, windows ------------------------------------------------------------------------------------------


@query("nodes calls hierarchy structure", f"WITH {_ALL} SELECT DISTINCT src, dst, kind FROM links WHERE src NOT LIKE 'module:%' AND src NOT LIKE 'commit:%' AND dst NOT LIKE 'module:%' AND dst NOT LIKE 'commit:%' AND dst NOT LIKE '%:?::%' AND (src NOT IN (SELECT node_id FROM nodes) OR dst NOT IN (SELECT node_id FROM nodes))")
def orphan_edges(p: Projection) -> DataFrame:
    return health.orphan_edges(_all_edges(p), p.nodes)


@query("", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(p: Projection) -> DataFrame:
    return health.duplicate_keys(p.table("lineitem"), "l_orderkey", "l_linenumber")


_SPAN_LINES = "SELECT DISTINCT 'file:region/' || (user_id % 5) AS file, (user_id % 40)::INT AS line FROM events"


@query("nodes", f"WITH l AS ({_SPAN_LINES}) SELECT l.file, l.line, arg_min(n.node_id, (n.line_end - n.line_start, n.line_start, n.node_id)) AS node_id FROM l LEFT JOIN (SELECT * FROM nodes WHERE kind = 'class') n ON n.file = l.file AND l.line BETWEEN n.line_start AND n.line_end GROUP BY 1, 2")
def enclosing_span(p: Projection) -> DataFrame:
    lines = p.table("events").select(F.concat(F.lit("file:region/"), (F.col("user_id") % 5).cast("string")).alias("file"), (F.col("user_id") % 40).cast("int").alias("line")).distinct()
    return incremental.innermost(lines, p.nodes.where("kind = 'class'").select("file", "line_start", "line_end", "node_id"))


@query("", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def keep_latest(p: Projection) -> DataFrame:
    rows = p.table("events").select("user_id", "event_id", "ts")
    return incremental.latest(rows, F.struct("ts", "event_id"), "user_id").select("user_id", "event_id")


@query("", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 50 = 0")
def upsert_rows(p: Projection) -> DataFrame:
    old = p.table("customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new"))
    more = old.where("c_custkey % 50 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit("new").alias("c_mktsegment"))
    return incremental.upsert(old, new.unionByName(more), "c_custkey")


@query("", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def churn_window(p: Projection) -> DataFrame:
    """An extension: events by hour."""
    grouped = p.table("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n")


@query("", "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS k FROM orders) WHERE k <= 3")
def first_per_group(p: Projection) -> DataFrame:
    return incremental.first_per_group(p.table("orders"), 3, [F.desc("o_orderdate"), F.asc("o_orderkey")], "o_custkey").select("o_custkey", "o_orderkey", "k")


@query("", "WITH l AS (SELECT 'ev' || event_id AS id, length(props) AS n FROM events) SELECT id, greatest(1, floor(n / 4))::INT AS tokens, n > 8 AS is_long FROM l")
def token_estimates(p: Projection) -> DataFrame:
    return p.table("events").select(F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"), text.estimate_tokens(F.col("props")).alias("tokens"), (F.length("props") > 8).alias("is_long"))


@query("", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events WHERE json_valid(props)")
def json_attributes(p: Projection) -> DataFrame:
    return p.table("events").where(F.try_parse_json("props").isNotNull()).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))




from . import compositions  # noqa: E402, F401  registers more
