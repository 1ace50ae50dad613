"""Context packs: ranked sections within a token budget, focus and role orders, renderers."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..schema import bare_path
from . import rank, stats, themes, traverse
from .lookup import public_api, todos


def within_budget(ranked: DataFrame, text: Column, order: Sequence[Column], budget: int) -> DataFrame:
    """The longest prefix in ``order`` whose token estimates sum to at most ``budget``; give it rows that a limit bounds."""
    turn = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("tokens", estimate_tokens(text)).withColumn("tokens_so_far", F.sum("tokens").over(turn)).where(F.col("tokens_so_far") <= budget)


def modules_in_budget(nodes: DataFrame, edges: DataFrame, budget: int, top: int = 60) -> DataFrame:
    return within_budget(rank.top_modules(nodes, edges, top), F.concat_ws(" ", "path", "lang", F.col("score").cast("string")), [F.desc("score"), F.asc("node_id")], budget)


def classes_in_budget(nodes: DataFrame, edges: DataFrame, budget: int, top: int = 40) -> DataFrame:
    return within_budget(rank.key_classes(nodes, edges, top), F.concat_ws(" ", "name", "file", F.col("subclasses").cast("string")), [F.desc("subclasses"), F.asc("node_id")], budget)


def focus_first(rows: DataFrame, is_focus: Column, order: Sequence[Column], size: int) -> DataFrame:
    """Rows of the focus, then others up to ``size`` rows in all, each part in ``order``; give it rows that a limit bounds."""
    focus = F.coalesce(is_focus, F.lit(False))
    marked = rows.withColumn("is_focus", focus)
    turn = F.row_number().over(Window.partitionBy("is_focus").orderBy(*order))
    n_focus = F.count_if(F.col("is_focus")).over(Window.partitionBy())
    placed = marked.withColumn("k", turn).withColumn("n_focus", n_focus)
    kept = placed.where("is_focus").unionByName(placed.where((~F.col("is_focus")) & (F.col("k") <= F.greatest(F.lit(0), size - F.col("n_focus")))))
    return kept.withColumn("position", F.when(F.col("is_focus"), F.col("k")).otherwise(F.col("n_focus") + F.col("k"))).drop("k", "n_focus")


def similar_files(nodes: DataFrame, file: str, cap: int = 8) -> DataFrame:
    """Other files of the same layer, the first by id."""
    files = nodes.where("kind = 'file'")
    layer = files.where(F.col("node_id") == file).select("layer").limit(1)
    return files.where(F.col("node_id") != file).join(F.broadcast(layer), "layer").select("node_id", "layer").orderBy("node_id").limit(cap)  # one row


def external_callers(nodes: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """(function, caller_file): who calls the file's public functions from other files."""
    own = nodes.where((F.col("kind") == "function") & (F.col("file") == file) & ~F.col("name").startswith("_")).select(F.col("node_id").alias("dst"), F.col("name").alias("function"))
    calls = edges.where("kind = 'calls'").select("src", "dst").distinct()
    callers = nodes.select(F.col("node_id").alias("src"), F.col("file").alias("caller_file")).where((F.coalesce("caller_file", F.lit("")) != "") & (F.col("caller_file") != file))
    return calls.join(own, "dst").join(callers, "src").select("function", bare_path(F.col("caller_file")).alias("caller_file")).distinct()


def role_debug(nodes: DataFrame, top: int = 10) -> DataFrame:
    """Functions by complexity times one more than their commits."""
    risk = F.coalesce("complexity", F.lit(1)) * (1 + F.coalesce("commit_count", F.lit(0)))
    return nodes.where("kind = 'function'").select("node_id", "name", risk.alias("risk")).orderBy(F.desc("risk"), "node_id").limit(top)


def role_review(nodes: DataFrame, todo_rows: DataFrame, hot: int = 5, marks: int = 25) -> dict[str, DataFrame]:
    return {"hot": rank.hot_paths(nodes, hot), "todos": todos(todo_rows, None, marks), "api": public_api(nodes).orderBy("name", "node_id")}


def role_feature(nodes: DataFrame, edges: DataFrame, file: str, top: int = 60) -> dict[str, DataFrame]:
    modules = rank.top_modules(nodes, edges, top).withColumn("tests_first", ~F.col("path").startswith("tests")).orderBy("tests_first", F.desc("score"), "node_id").drop("tests_first")
    return {"modules": modules, "similar_files": similar_files(nodes, file)}


def graph_view(nodes: DataFrame, edges: DataFrame, per_layer: int = 50, hot: int = 80) -> tuple[DataFrame, DataFrame]:
    """(shown, links): files of each layer and the hottest functions and files, and which shown file holds which shown symbol."""
    files = stats.layers(nodes, per_layer).select("node_id", "layer", F.lit("file").alias("why"))
    top = rank.hot_paths(nodes, hot).select("node_id", F.lit(None).cast("string").alias("layer"), F.lit("hot").alias("why"))
    shown = files.unionByName(top.join(files.select("node_id"), "node_id", "left_anti"))
    held = nodes.where("kind != 'file'").select("node_id", "file").join(shown.select("node_id"), "node_id", "left_semi")
    return shown, held.join(files.select(F.col("node_id").alias("file")), "file", "left_semi").select(F.col("file").alias("src"), F.col("node_id").alias("dst"))


def focus_symbols(nodes: DataFrame, file: str) -> DataFrame:
    """A file's functions, classes and types in the order of their lines, signatures cut to 120 characters and docstrings to 100."""
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    own = nodes.where((F.col("file") == file) & F.col("kind").isin("function", "class", "type"))
    line = F.coalesce("line_start", F.lit(0)).alias("line_start")
    return own.select("node_id", "kind", "name", F.coalesce("qualified_name", "name").alias("qualified_name"), line, text("signature", 120), F.coalesce("complexity", F.lit(1)).alias("complexity"), text("docstring", 100)).orderBy("line_start", "node_id")


def focus_callers(nodes: DataFrame, edges: DataFrame, file: str, top: int = 10) -> DataFrame:
    """(caller): who calls the file's public functions from other files, as ``name (file)``, the first by name."""
    own = nodes.where((F.col("kind") == "function") & (F.col("file") == file) & ~F.coalesce("name", F.lit("")).startswith("_")).select(F.col("node_id").alias("dst"))
    into = edges.where("kind = 'calls'").join(own, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
    label = F.concat(F.coalesce("qualified_name", "name", "node_id"), F.lit(" ("), bare_path(F.col("file")), F.lit(")"))
    other = nodes.where((F.coalesce("file", F.lit("")) != "") & (F.col("file") != file))
    return other.join(into, "node_id").select(label.alias("caller")).distinct().orderBy("caller").limit(top)


def focus_context(nodes: DataFrame, edges: DataFrame, file: str) -> dict[str, DataFrame]:
    """What surrounds a file: its symbols, who imports it, what it imports, who calls into it."""
    return {"symbols": focus_symbols(nodes, file), "imported_by": traverse.importers(edges, file), "imports": traverse.imported(edges, file), "callers": focus_callers(nodes, edges, file)}


ROLES = ("general", "debug", "review", "feature")
#: Rows that a focused section shows in all, those of the focus first and never fewer.
FOCUS_SIZES = {"hot_paths": 10, "public_api": 15, "classes": 10, "todos": 10}


def compress(pack: dict[str, list[dict]], nodes: DataFrame, edges: DataFrame, focus: str | None = None, role: str = "general") -> dict[str, list[dict]]:
    """A pack for work on a file, by someone in a role; an unknown role is general, and ``pack`` itself stays as it is.

    A focus adds what surrounds the file and puts its rows first in each section. Debugging wants hot paths by complexity times
    changes, ten of them; a review five hot paths, 25 marks and the API by name; a feature three changes, modules of tests first and files of
    the focus' layer. A pack holds few rows by its limits, so this is done to lists.
    """
    out = {k: list(v) for k, v in pack.items()}
    file = focus if focus is None or focus.startswith("file:") else f"file:{focus}"
    if file:
        bare, rows = file.removeprefix("file:"), lambda df: [r.asDict(recursive=True) for r in df.collect()]
        context = focus_context(nodes, edges, file)
        out["focus"] = [{"file": bare, "symbols": rows(context["symbols"]), **{k: [r[0] for r in context[k].collect()] for k in ("imported_by", "imports", "callers")}}]
        own = {file, *(r["node_id"] for r in out["focus"][0]["symbols"])}
        for name, size in FOCUS_SIZES.items():
            first = [r for r in out.get(name, []) if r.get("node_id") in own or r.get("file") in (file, bare) or (name == "todos" and bare in (r.get("file") or ""))]
            if name in out:
                out[name] = first + [r for r in out[name] if r not in first][: max(0, size - len(first))]
    if role == "debug" and "hot_paths" in out:
        out["hot_paths"] = sorted(out["hot_paths"], key=lambda r: -(r.get("complexity") or 1) * (1 + (r.get("commit_count") or 0)))[:10]
    elif role == "review":
        for name, size in (("hot_paths", 5), ("todos", 25)):
            out |= {name: out[name][:size]} if name in out else {}
        out["public_api"] = sorted(out.get("public_api", []), key=lambda r: r.get("name") or "")
    elif role == "feature":
        out |= {"recent_changes": out["recent_changes"][:3]} if "recent_changes" in out else {}
        out["modules"] = sorted(out.get("modules", []), key=lambda r: not (r.get("path") or "").startswith("tests"))
        if file:
            out["focus"][0]["similar_files"] = [r.node_id for r in similar_files(nodes, file).collect()]
    return out


#: What a section of a pack shows at most, and how much of the budget must be left for it.
LIMITS = {"hot_paths": 15, "recent_changes": 5, "public_api": 30, "todos": 20, "modules": 60, "classes": 40, "themes": 6, "notes": 8}
GATES = {"modules": 1000, "classes": 500, "todos": 200, "themes": 400, "notes": 300}


def sections(nodes: DataFrame, edges: DataFrame, todo_rows: DataFrame, commits: DataFrame | None = None, budget: int = 8000, comments: DataFrame | None = None, notes: DataFrame | None = None) -> dict[str, list[dict]]:
    """The rows of a pack, section by section, each a small query; lower tiers come only while their gate's tokens are left.

    Themes come from review ``comments``, notes from ``notes`` (pos, written, category, body), newest first, where these are given.
    """
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  each is bounded by a limit
    signature = F.substring("signature", 1, 80).alias("signature")
    pack = {
        "overview": rows(stats.overview(nodes, edges)),
        "layers": rows(stats.layer_sizes(nodes).orderBy("layer")),
        "hot_paths": rows(rank.hot_paths(nodes, LIMITS["hot_paths"])),
        "public_api": rows(public_api(nodes).select("node_id", "name", "file", signature).orderBy("node_id").limit(LIMITS["public_api"])),
    }
    if commits is not None:
        pack["recent_changes"] = rows(commits.orderBy(F.desc("ts"), "sha").select("sha", "message", "ts").limit(LIMITS["recent_changes"]))
    lower = {
        "modules": lambda left: modules_in_budget(nodes, edges, left // 2),
        "classes": lambda left: classes_in_budget(nodes, edges, left // 2),
        "todos": lambda left: todos(todo_rows, None, LIMITS["todos"]),
    }
    if comments is not None:
        lower["themes"] = lambda left: themes.theme_counts(comments).limit(LIMITS["themes"])
    if notes is not None:
        lower["notes"] = lambda left: notes.orderBy(F.desc("pos")).select("written", "category", "body").limit(LIMITS["notes"])
    for name, make in lower.items():
        left = budget - tokens_of(pack)
        if left > GATES[name]:
            found = rows(make(left))
            if found or name not in ("themes", "notes"):
                pack[name] = found
    return pack


def tokens_of(value: object) -> int:
    return max(1, len(value if isinstance(value, str) else json.dumps(value, default=str)) // 4)


#: Sections that give way, first to last, when the rendered text is over budget.
TRIM = ("notes", "themes", "todos", "classes", "modules", "recent_changes", "public_api", "hot_paths", "layers")


def render_markdown(pack: dict[str, list[dict]], title: str) -> str:
    out = [f"# {title}", ""]
    for name, rows in pack.items():
        out += [f"## {name.replace('_', ' ').capitalize()}", "", *(f"- {', '.join(f'{k}: {v}' for k, v in r.items() if v is not None)}" for r in rows), ""]
    return "\n".join(out)


def render_html(pack: dict[str, list[dict]], title: str) -> str:
    parts = [f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in pack.items():
        items = "".join(f"<li>{html.escape(', '.join(f'{k}: {v}' for k, v in r.items() if v is not None))}</li>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><ul>{items}</ul>")
    return "".join(parts)


def render_json(pack: dict[str, list[dict]]) -> str:
    return json.dumps(pack, default=str, ensure_ascii=False, indent=1)


def fit(pack: dict[str, list[dict]], title: str, budget: int) -> str:
    """Markdown within ``budget`` tokens: sections are halved, then dropped, in the order of TRIM, until it fits; at last the text is cut."""
    pack = dict(pack)
    for name in TRIM:
        for keep in (lambda n: n // 2, lambda n: 0):
            text = render_markdown(pack, title)
            if tokens_of(text) <= budget or name not in pack:
                break
            pack[name] = pack[name][: keep(len(pack[name]))]
            if not pack[name]:
                del pack[name]
    text = render_markdown(pack, title)
    return text if tokens_of(text) <= budget else text[: max(0, 4 * budget - 1)] + "…"


#: Stands in every pack that is written, so that a file written by hand is told from one of ours.
MARKER = "Generated by loomgraph"


def write_pack(text: str, root: str, mode: str = "auto", name: str = "CONTEXT.md", fallback: str = ".loomgraph/context-pack.md") -> str:
    """Write a pack under ``root``; the path it went to.

    ``auto`` writes ``name`` unless somebody else wrote that, ``force`` always, ``off`` never; the fallback takes it otherwise.
    """
    target, other = Path(root) / name, Path(root) / fallback
    ours = not target.exists() or MARKER in target.read_text(encoding="utf-8", errors="ignore")
    chosen = target if mode == "force" or (mode == "auto" and ours) else other
    chosen.parent.mkdir(parents=True, exist_ok=True)
    chosen.write_text(f"{text}\n\n<!-- {MARKER} -->\n", encoding="utf-8")
    return str(chosen)
