"""Mixing sources to target weights: budgets flow down a tree, shortages go to siblings first, leaves give prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LEVELS = ("domain", "lang", "source")


def water_fill(nodes: DataFrame, parent: Sequence[str], given: str, cap: str, weight: str, out: str) -> DataFrame:
    """Split the amount ``given`` among the rows of each ``parent`` in proportion to ``weight``, none above its ``cap``.

    What a full row can't take goes to its siblings in proportion to their weights; if all are full, the rest stays
    with the parent. In closed form: sorted by cap / weight, a row is full iff the water level at its turn reaches that
    ratio; the level of the first row that isn't full, the highest of those, holds for all that aren't. A weight of zero or null takes nothing.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    ratio = F.when(w > 0, F.col(cap) / w)
    by = [F.col(p) for p in parent]
    order = Window.partitionBy(*by).orderBy(F.col("_ratio").asc_nulls_last(), *[F.col(c) for c in nodes.columns if c in LEVELS])
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    rated = nodes.withColumn("_w", w).withColumn("_ratio", ratio).withColumn("_cap", F.when(w > 0, F.col(cap)).otherwise(0.0))
    sums = rated.withColumn("_before", F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0))).withColumn("_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(so_far), F.lit(0.0)))
    level = F.when(F.col("_left") > 0, (F.col(given) - F.col("_before")) / F.col("_left"))
    opened = sums.withColumn("_level", F.when((F.col("_w") > 0) & (level < F.col("_ratio")), level))
    final = opened.withColumn("_final", F.max("_level").over(whole))
    share = F.when(F.col("_w") == 0, 0.0).when(F.col("_final").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.greatest(F.col("_final"), F.lit(0.0)) * F.col("_w")))
    return final.withColumn(out, share).drop("_w", "_ratio", "_cap", "_before", "_left", "_level", "_final")


def _weigh(caps: DataFrame, k: int, table: DataFrame | None) -> DataFrame:
    """``caps`` with w{k}, the weight of each leaf's node on level ``k``, never null."""
    own = f"w{k}"
    if table is None:
        return caps.withColumn(own, F.lit(1.0))
    path, parent = list(LEVELS[: k + 1]), list(LEVELS[:k])
    last = F.col(LEVELS[k])
    listed = table.where(last.isNotNull()).select(*path, F.col("weight").cast("double").alias(own), F.lit(True).alias("_listed"))
    others = table.where(last.isNull()).select(*parent, F.col("weight").cast("double").alias("_others"))
    unlisted = caps.select(*path).distinct().join(listed, path, "left_anti").groupBy(*parent).agg(F.count(F.lit(1)).alias("_missing"))
    read = caps.join(listed, path, "left")
    if parent:
        read = read.join(others, parent, "left").join(unlisted, parent, "left")
    else:
        read = read.withColumn("_others", F.lit(others.agg(F.max("_others")).first()[0]).cast("double")).withColumn("_missing", F.lit(unlisted.first()[0]))
    weight = F.when(F.col("_listed").isNull(), F.col("_others") / F.greatest("_missing", F.lit(1))).otherwise(F.col(own))
    return read.withColumn(own, F.coalesce(weight, F.lit(0.0))).drop("_listed", "_others", "_missing")


def budgets(leaves: DataFrame, total: Column, epochs: int, weights: Sequence[DataFrame | None] = (None, None, None)) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the budget of each, in tokens.

    ``weights``: for each level a frame (its path columns, weight) or None for equal weights among siblings. A row whose last path
    column is null holds the weight that all siblings without a row share alike; without such a row they have weight 0. ``total`` is
    computed from the sum ``tokens``, and is what all leaves can give at most. A leaf can give its tokens ``epochs`` times, or
    nothing if a weight on its path is 0: what nothing can take below a node goes to the node's siblings.
    """
    caps = leaves
    for k, table in enumerate(weights):
        caps = _weigh(caps, k, table)
    open_ = (F.col("w0") > 0) & (F.col("w1") > 0) & (F.col("w2") > 0)
    caps = caps.withColumn("cap", F.when(open_, F.col("tokens").cast("double") * epochs).otherwise(0.0))
    sums = caps.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("tokens"), F.coalesce(F.sum("cap"), F.lit(0.0)).alias("_caps"))
    root = sums.select(F.least(total, "_caps")).first()[0]
    level, parent = None, []
    for k in range(len(LEVELS)):
        path = [*parent, LEVELS[k]]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w{k}").alias("weight"), F.lit(root).alias("given"))
        nodes = nodes if level is None else nodes.drop("given").join(level, parent)
        level = water_fill(nodes, parent, "given", "cap", "weight", "share").select(*path, F.col("share").alias("given"))
        parent = path
    return caps.join(level.withColumnRenamed("given", "budget"), list(LEVELS)).select(*LEVELS, "tokens", "budget")


def mix(documents: DataFrame, tokens: Column, domain: Column, fraction: float = 1.0, epochs: int = 2, seed: int = 0, weights: Sequence[DataFrame | None] = (None, None, None), id_column: str = "doc_id") -> DataFrame:
    """The chosen documents (doc_id, domain, lang, source, epoch, tokens, take_tokens, start): ``fraction`` of all tokens, split by weight.

    Each leaf of the domain-language-source tree lists its documents once an epoch, each epoch in an order of its own that
    ``seed`` sets, and gives the prefix that its budget reaches; take_tokens is less than tokens in the last document only.
    A null lang or source is a node named ``(none)``. Documents without tokens are never chosen. Repeated rows count as
    often as they come; ties in the order don't change what repeated rows give. Other columns don't matter.

    The tree's sums are small; the order is a hash, so a leaf is cut into 4096 ranges of it, which are summed, then
    walked through in tasks of their own: no leaf is gathered in one task.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    read = documents.select(F.col(f"`{id_column}`").alias("doc_id"), name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), tokens.cast("long").alias("tokens"))
    counted = materialise(read.where("tokens > 0"), "mix-tokens")
    leaves = materialise(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    total = F.lit(float(fraction)) * F.col("tokens")
    budget = materialise(budgets(leaves, total, epochs, weights), "mix-budgets")
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    spread = counted.withColumn("epoch", F.explode(F.array(*[F.lit(k) for k in range(epochs)]))).withColumn("turn", turn).withColumn("part", F.substring("turn", 1, 3))
    sums = spread.groupBy(*LEVELS, "epoch", "part").agg(F.sum("tokens").alias("part_tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)))
    reached = ahead.join(budget.select(*LEVELS, F.floor("budget").cast("long").alias("budget")), list(LEVELS)).where("ahead < budget")
    within = Window.partitionBy(*LEVELS, "epoch", "part").orderBy("turn", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    walked = spread.join(reached.drop("part_tokens"), [*LEVELS, "epoch", "part"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    chosen = walked.where("start < budget")
    return chosen.select("doc_id", *LEVELS, "epoch", "tokens", F.least("tokens", F.col("budget") - F.col("start")).alias("take_tokens"), "start")
