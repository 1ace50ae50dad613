"""Connected components: by alternating large-star and small-star steps in DataFrame operations, or in a task where they fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialise, release, to_batch

#: So many edges between long nodes one task may hold, 16 bytes each.
IN_A_TASK = 2_000_000


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges``; component is the smallest node that links reach.

    ``edges`` has two columns of one orderable type; direction, repeats, self-loops and rows with a null do not matter.
    Empty edges give no rows. Each step is written to the shared folder, so no lineage grows and only two numbers
    come to the driver. A node with very many neighbours is reduced by a partial minimum before the shuffle, and
    its join is an ordinary shuffled one, which adaptive execution splits.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    plain = edges.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).where(a.isNotNull() & b.isNotNull())
    loops = materialise(plain.distinct(), "component-edges")
    current = loops.where("src != dst")
    last, before = None, _digest(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.where("src != dst").distinct()
        down = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(down, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src != dst")
        step = materialise(small.unionByName(down.select("src", F.col("low").alias("dst"))).distinct(), "component-step")
        if last is not None:
            release(last)
        last, now = step, _digest(step)
        current = step
        if now == before:
            break
        before = now
    roots = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    nodes = loops.select(F.col("src").alias("node")).unionByName(loops.select(F.col("dst").alias("node"))).distinct()
    joined = nodes.join(roots, "node", "left")
    return joined.select("node", F.coalesce("component", "node").alias("component"))


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` rows that each reaches by edges between rows ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components_of_ids(edges: DataFrame) -> DataFrame:
    """Like :func:`connected_components` for long nodes; up to IN_A_TASK edges, which are counted, are joined in one task."""
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    read = materialise(edges.select(a.alias("src"), b.alias("dst")).where(a.isNotNull() & b.isNotNull()), "id-edges")
    if read.count() > IN_A_TASK:
        return connected_components(read)
    schema = "node long, component long"
    arrow = arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.array([f.column(0).to_numpy(), f.column(1).to_numpy()]) for f in frames]
        ends = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
        nodes, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        found = nodes[least_reached(at[0], at[1], len(nodes))]
        for k in range(0, len(nodes), 100_000):
            yield to_batch(list(zip(nodes[k : k + 100_000].tolist(), found[k : k + 100_000].tolist(), strict=True)), arrow)

    return read.coalesce(1).mapInArrow(run, schema)
