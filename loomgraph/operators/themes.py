"""Recurring themes of review comments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import THEMES, match_themes

EXAMPLE = 120


def tagged(comments: DataFrame, themes: Mapping[str, Sequence[str]] = THEMES) -> DataFrame:
    """Comments with text, one row for each theme they touch. ``comments``: pr, source, login, path, body, seq."""
    said = comments.where("coalesce(body, '') != ''")
    return said.withColumn("theme", F.explode(match_themes(F.col("body"), themes)))


def theme_counts(comments: DataFrame, themes: Mapping[str, Sequence[str]] = THEMES) -> DataFrame:
    return tagged(comments, themes).groupBy("theme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "theme")


def theme_examples(comments: DataFrame, themes: Mapping[str, Sequence[str]] = THEMES, first: int = 3) -> DataFrame:
    """(theme, k, example): the first comments of each theme by seq, cut to 120 characters."""
    turn = F.row_number().over(Window.partitionBy("theme").orderBy("seq"))
    return tagged(comments, themes).withColumn("k", turn).where(F.col("k") <= first).select("theme", "k", F.substring(F.trim("body"), 1, EXAMPLE).alias("example"))


def theme_files(comments: DataFrame, themes: Mapping[str, Sequence[str]] = THEMES, first: int = 5) -> DataFrame:
    """(theme, k, path): the first distinct files by name; only inline comments have files."""
    files = tagged(comments, themes).where("source = 'inline' and coalesce(path, '') != ''").select("theme", "path").distinct()
    return files.withColumn("k", F.row_number().over(Window.partitionBy("theme").orderBy("path"))).where(F.col("k") <= first)


def top_reviewers(comments: DataFrame, top: int = 5) -> DataFrame:
    said = comments.where("coalesce(body, '') != '' and coalesce(login, '') != ''")
    return said.groupBy("login").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "login").limit(top)
