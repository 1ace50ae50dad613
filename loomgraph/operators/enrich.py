"""Summaries from an outside service: candidates, prompts, batches, cached answers and the patch of the nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, parse_reply, prompt_entry
from .incremental import set_attribute
from .lookup import batches, enrichment_candidates

#: Given the prompt entries of a batch, numbered from 1, the service answers with a JSON object from number to summary.
Ask = Callable[[list[str]], str]


def prompts(nodes: DataFrame, cached: DataFrame, size: int = 20, documented_too: bool = False) -> DataFrame:
    """(part, batch, node_id, cache_key, prompt) of the candidates that no cached answer serves, in batches of ``size``."""
    asked = batches(enrichment_candidates(nodes, documented_too), cached, cache_key(F.col("node_id"), F.col("signature"), F.col("docstring")), size)
    entry = prompt_entry(*(F.col(c) for c in ("kind", "name", "qualified_name", "signature", "definition", "file", "docstring")))
    return asked.select("part", "batch", "node_id", "cache_key", entry.alias("prompt"))


def answers(asked: DataFrame, ask: Ask) -> DataFrame:
    """(node_id, cache_key, llm_summary) of the answered prompts; a batch whose call fails or whose reply is no JSON gives none.

    One call for each batch, which is a row of its own.
    """

    listed = asked.groupBy("part", "batch").agg(F.sort_array(F.collect_list(F.struct("cache_key", "node_id", "prompt"))).alias("rows"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows in frame["rows"]:
                try:
                    reply = ask([r["prompt"] for r in rows])
                except Exception:  # noqa: BLE001  the service may be anybody's
                    reply = None
                yield pd.DataFrame([(r["node_id"], r["cache_key"], str(k), reply) for k, r in enumerate(rows, 1)], columns=["node_id", "cache_key", "number", "reply"])

    replied = listed.mapInPandas(call, "node_id string, cache_key string, number string, reply string")
    return replied.select("node_id", "cache_key", F.element_at(parse_reply(F.col("reply")), F.col("number")).alias("llm_summary")).where("llm_summary is not null")


def patched(nodes: DataFrame, cached: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with the summaries of ``new`` and of cached answers (cache_key, llm_summary) to candidates."""
    key = cache_key(F.col("node_id"), F.col("signature"), F.col("docstring"))
    known = enrichment_candidates(nodes, True).select("node_id", key.alias("cache_key")).join(cached, "cache_key").select("node_id", "llm_summary")
    return set_attribute(nodes, new.select("node_id", "llm_summary").unionByName(known).groupBy("node_id").agg(F.max("llm_summary").alias("llm_summary")), "llm_summary")
