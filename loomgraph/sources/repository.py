"""Source trees, Git history, notes and snapshots as DataFrames."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a scan leaves out.
SKIP_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".tox", "vendor", "third_party", ".mypy_cache", ".pytest_cache", "coverage", ".coverage", "htmlcov", ".loomgraph",
)
SKIP_SUFFIXES = (
    ".min.js", ".min.css", ".lock", ".sum", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".zip", ".tar", ".gz", ".whl", ".egg",
    ".pyc", ".pyo", ".so", ".dylib", ".dll", ".db", ".db-shm", ".db-wal", ".sqlite", ".sqlite3", ".bin", ".dat", ".pkl", ".parquet",
)
MAX_SIZE = 512 * 1024
EDITOR_SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".tox", "vendor", ".mypy_cache", ".pytest_cache", ".loomgraph")


def kept_files(files: DataFrame, root: str, skip_dirs: Sequence[str] = SKIP_DIRS, skip_suffixes: Sequence[str] = SKIP_SUFFIXES, max_size: int | None = MAX_SIZE) -> DataFrame:
    """(path, content, length) below ``root``; ``files`` has path, length and content. Any part of a path can be left out."""
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    relative = F.regexp_replace("path", rf"^(file:)?/*{base.lstrip('/')}/", "")
    found = files.select(relative.alias("path"), "content", "length")
    found = found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip_dirs))))
    suffix = "(?i)(" + "|".join(s.replace(".", r"\.") for s in skip_suffixes) + ")$"
    found = found.where(~F.col("path").rlike(suffix))
    return found if max_size is None else found.where(F.col("length") <= max_size)


def scan(spark: SparkSession, root: str, **rules) -> DataFrame:
    """The files of a source tree. Contents are read for those only that the rules keep, as length is pushed to the listing."""
    return kept_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, **rules)


def editor_scan(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """As an editor scans: fewer folders are left out, no size and no suffix, and only files that a parser knows."""
    found = scan(spark, root, skip_dirs=EDITOR_SKIP_DIRS, skip_suffixes=("\0",), max_size=None)
    return found.where(F.col("path").rlike("(?i)(" + "|".join(e.replace(".", r"\.").replace("+", r"\+") for e in extensions) + ")$"))


def text_of(content: str = "content"):
    return F.decode(F.col(content), F.lit("UTF-8"))


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


_LOG = ("--no-renames", "--name-only", "--format=%x1e%H%x1f%h%x1f%an%x1f%ae%x1f%at%x1f%s%x1f")


def commits(spark: SparkSession, repo: str, since: str | None = None, limit: int = 50) -> DataFrame:
    """The newest ``limit`` commits, all of their files with them; one call of git reads the whole log."""
    log = _git(repo, "log", f"-{limit}", *_LOG, *([f"{since}..HEAD"] if since else []))
    rows = []
    for entry in log.split("\x1e")[1:]:
        sha, short, author, email, at, message, files = entry.split("\x1f")
        rows.append((sha, short, author, email, int(at), message, [f for f in files.splitlines() if f]))
    return spark.createDataFrame(rows, "sha string, short_sha string, author string, author_email string, ts bigint, message string, files_changed array<string>")


def changed_files(spark: SparkSession, repo: str, old: str, new: str = "HEAD") -> DataFrame:
    """(status, path) between two refs; a renamed file has its new path."""
    rows = [(x.split("\t")[0][0], x.split("\t")[-1]) for x in _git(repo, "diff", "--name-status", "-M", old, new).splitlines() if x]
    return spark.createDataFrame(rows, "status string, path string")


def file_at(repo: str, ref: str, path: str) -> bytes | None:
    done = subprocess.run(["git", "-C", repo, "show", f"{ref}:{path}"], capture_output=True)
    return done.stdout if done.returncode == 0 else None


def resolve_ref(repo: str, ref: str = "HEAD") -> str:
    return _git(repo, "rev-parse", ref).strip()


def tree_at(spark: SparkSession, repo: str, ref: str, paths: Sequence[str]) -> DataFrame:
    """(path, content, length) of named files at a ref, those that exist."""
    rows = [(p, c, len(c)) for p in paths if (c := file_at(repo, ref, p)) is not None]
    return spark.createDataFrame([(p, bytearray(c), n) for p, c, n in rows], "path string, content binary, length bigint")


_REVIEW = "number int, merged_at string, title string, comments array<struct<body:string,path:string,user:struct<login:string>>>, reviews array<struct<body:string,user:struct<login:string>>>"


def review_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments of merged pull requests from exported JSON lines, inline ones before reviews, in the order of the files' rows."""
    merged = spark.read.schema(_REVIEW).json(path).where("merged_at is not null")
    inline = merged.select(F.col("number").alias("pr"), F.posexplode("comments").alias("k", "c")).select("pr", F.lit("inline").alias("source"), "c.user.login", "c.path", "c.body", (F.col("pr").cast("long") * 100_000 + F.col("k")).alias("seq"))
    review = merged.select(F.col("number").alias("pr"), F.posexplode("reviews").alias("k", "c")).select("pr", F.lit("review").alias("source"), "c.user.login", F.lit(None).cast("string").alias("path"), "c.body", (F.col("pr").cast("long") * 100_000 + 50_000 + F.col("k")).alias("seq"))
    return inline.unionByName(review)


def notes(lines: DataFrame, newest: int | None = 10) -> DataFrame:
    """(pos, written, category, body) of notes under ``### time · category`` headers, the latest first; ``lines`` has pos, value and, of several, file.

    A running count of headers within a file numbers the notes; lines before the first belong to none. A rule below a note is not part of it.
    """
    header = r"^###\s+(.+?)\s+·\s+(\S+)\s*$"
    keyed = lines if "file" in lines.columns else lines.withColumn("file", F.lit(""))
    marked = keyed.withColumn("head", F.col("value").rlike(header))
    numbered = marked.withColumn("note", F.sum(F.col("head").cast("int")).over(Window.partitionBy("file").orderBy("pos"))).where("note > 0")
    body = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "value"))))
    held = numbered.groupBy("file", "note").agg(F.min("pos").alias("pos"), F.max(F.when(F.col("head"), F.col("value"))).alias("header"), body.alias("l"))
    said = F.regexp_replace(F.regexp_replace(F.concat_ws("\n", F.col("l.value")), r"^\s+|\s+$", ""), r"(^|\s+)---$", "")
    told = held.orderBy("file", F.desc("pos")).select("pos", F.regexp_extract("header", header, 1).alias("written"), F.regexp_extract("header", header, 2).alias("category"), said.alias("body"))
    return told if newest is None else told.limit(newest)


def read_notes(spark: SparkSession, path: str, newest: int | None = 10) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return notes(whole, newest)


def append_note(path: str, written: str, category: str, body: str) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"### {written} · {category}\n{body.strip()}\n\n")


def clear_notes(path: str) -> None:
    """Leave an empty file."""
    open(path, "w", encoding="utf-8").close()


_TREE = "tree array<struct<path:string,type:string,size:bigint,sha:string>>"
_COMMIT = "sha string, commit struct<message:string,author:struct<name:string,email:string,date:timestamp>>, files array<struct<filename:string>>"
_COMPARE = "files array<struct<filename:string,status:string,previous_filename:string>>"


def exported_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha) of the files in exported tree listings."""
    return spark.read.schema(_TREE).json(path, multiLine=True).select(F.explode("tree").alias("t")).where("t.type = 'blob'").select("t.path", F.col("t.size").alias("size_bytes"), "t.sha")


def exported_commits(spark: SparkSession, path: str) -> DataFrame:
    """Exported commits, in the columns of :func:`commits`."""
    read = spark.read.schema(_COMMIT).json(path)
    return read.select("sha", F.substring("sha", 1, 7).alias("short_sha"), F.col("commit.author.name").alias("author"), F.col("commit.author.email").alias("author_email"), F.unix_seconds("commit.author.date").alias("ts"), F.substring_index("commit.message", "\n", 1).alias("message"), F.col("files.filename").alias("files_changed"))


def exported_compare(spark: SparkSession, path: str) -> DataFrame:
    """(status, path) of an exported comparison, in the letters of :func:`changed_files`."""
    letter = F.when(F.col("f.status") == "added", "A").when(F.col("f.status") == "removed", "D").when(F.col("f.status") == "renamed", "R").otherwise("M")
    return spark.read.schema(_COMPARE).json(path, multiLine=True).select(F.explode("files").alias("f")).select(letter.alias("status"), F.col("f.filename").alias("path"))


def save_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as compressed JSON lines."""
    nodes.write.mode("overwrite").option("compression", "gzip").json(f"{path}/nodes")
    edges.write.mode("overwrite").option("compression", "gzip").json(f"{path}/links")


def load_snapshot(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(nodes).json(f"{path}/nodes"), spark.read.schema(edges).json(f"{path}/links")
