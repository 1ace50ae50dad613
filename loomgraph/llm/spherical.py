"""Embedding near-dedup by spherical-cap filters: structured product codes list-decoded to all exceeding directions, join, verify."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialise, release, tidy, to_batch
from .components import components_of_ids, least_reached

#: Rows of a filter that one task compares with each other or with as many others.
BLOCK = 1024


#: Share of the pairs at the threshold of which a filter has to hold both, and how many random pairs that share is computed with.
RECALL, PAIRS = 0.99, 4000


def _caps(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles from 0 to pi, and the share of the sphere that is within each of a direction."""
    angle = np.linspace(0, np.pi, 200_001)
    if dim < 2:
        return angle, np.where(angle < np.pi, 0.5, 1.0)
    with np.errstate(divide="ignore"):
        density = np.exp((dim - 2) * np.log(np.sin(angle))) if dim > 2 else np.ones_like(angle)
    within = np.concatenate([[0.0], np.cumsum(density[1:] + density[:-1])])
    return angle, within / within[-1]


def cap_share(dim: int, cut: float) -> float:
    """Share of random unit vectors whose inner product with a direction reaches ``cut``, exactly, not by a Gaussian."""
    angle, within = _caps(dim)
    return float(np.interp(np.arccos(cut), angle, within))


def _pairs(dim: int, cosine: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and one for each at that cosine."""
    x, y = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim < 2:
        return x, x
    y -= (y * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


@dataclass(frozen=True)
class Plan:
    """What fixes the codes of vectors of one length: computed once, in the driver, so that all tasks have the same."""

    dim: int
    cut: float  # a direction counts if its inner product with the unit vector reaches it
    size: int  # codewords of each half
    rotations: int

    @classmethod
    def make(cls, dim: int, per_filter: float, hits: float, rows: int, threshold: float = 0.9, target: float = RECALL, seed: int = 12) -> Plan:
        """Caps so large that each holds ``per_filter`` of ``rows`` random vectors, so many that each vector has ``hits`` a rotation,
        and so many rotations that a share ``target`` of the pairs at the ``threshold`` has a filter in common.

        Rotations are independent, so what one of them misses, it misses to the power of their number. What one finds is counted on
        random pairs under codes of their own, less three standard errors. Caps that are too small to hold such a pair are doubled.
        """
        threshold = min(max(threshold, -0.999), 1 - 1e-9)
        angle, within = _caps(dim)
        share = min(0.02, max(per_filter, 1.0) / max(rows, 1))
        cut = min(float(np.cos(np.interp(share, within, angle))), 0.75, 0.77 * sqrt((1 + threshold) / 2))
        while True:
            share = cap_share(dim, cut)
            size = max(2, ceil(sqrt(hits / share)))
            rng, found, batch = np.random.default_rng(seed), 0, 500
            for k in range(PAIRS // batch):  # other codes each time: the share is an average over codes
                codes = Codes.make(cls(dim, cut, size, 1), seed=seed + 1 + k)
                x, y = _pairs(dim, threshold, batch, rng)
                (a, f), (b, g) = codes.decode(x), codes.decode(y)
                found += len(np.unique(np.intersect1d(a * size**2 + f, b * size**2 + g) // size**2))
            hit = found / PAIRS
            hit -= 3 * sqrt(hit * (1 - hit) / PAIRS)
            if hit > 0.02:
                return cls(dim, cut, size, max(2, ceil(log(1 - target) / log(1 - min(hit, 1 - 1e-9)))))
            cut = float(np.cos(np.interp(min(2 * share, 0.999), within, angle)))


@dataclass
class Codes:
    """Filter directions: under each of several random rotations, all sums of a codeword for either half of the coordinates."""

    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # rotation, codewords of the first half, of the second, as rows
    cut: float

    @classmethod
    def make(cls, plan: Plan, seed: int = 11) -> Codes:
        rng = np.random.default_rng(seed)
        parts, dim = [], plan.dim
        for _ in range(plan.rotations):
            rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            halves = []
            for n in (dim - dim // 2, dim // 2):
                code = rng.normal(size=(plan.size if n else 1, n))
                halves.append(code * np.sqrt(n / dim) / np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-12))
            parts.append((rotation, *halves))
        return cls(parts, plan.cut)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), by row, for all filters that each unit vector exceeds.

        With the second half's scores in falling order, a codeword of the first half goes with a prefix of them; those that
        no codeword of the second half lifts to the cut are left out at once.
        """
        rows, filters, base = [], [], 0
        for rotation, first, second in self.parts:
            turned, n = unit @ rotation, len(unit)
            left, right = turned[:, : first.shape[1]] @ first.T, turned[:, first.shape[1] :] @ second.T
            order = np.argsort(-right, axis=1)
            falling = np.take_along_axis(right, order, axis=1)
            row, half = np.nonzero(left + falling[:, :1] >= self.cut)
            need = self.cut - left[row, half]
            ends = np.array([np.searchsorted(-falling[r], -x, "right") for r, x in zip(row, need, strict=True)], np.int64)
            inner = np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)
            owner = np.repeat(row, ends)
            rows.append(owner)
            filters.append(base + np.repeat(half, ends) * len(second) + order[owner, inner])
            base += len(first) * len(second)
        owner, found = np.concatenate(rows), np.concatenate(filters)
        by_row = np.argsort(owner, kind="stable")
        return owner[by_row], found[by_row].astype(np.int64)


def _unit(values: list) -> np.ndarray | None:
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        return None
    x = x / max(np.abs(x).max(), 1e-300)
    length = np.linalg.norm(x)
    return x / length if length else None


def _spread(vectors: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(node, sketch, scale, error, filters): each component in a byte, its unit, how far the sketch is from the vector, and the filters that hold it."""
    schema = "node long, sketch binary, scale double, error double, filters array<long>"
    arrow = arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        codes: dict[int, Codes] = {}
        for frame in frames:
            for start in range(0, frame.num_rows, 512):
                ids, units = frame.column(0)[start : start + 512].to_pylist(), frame.column(1)[start : start + 512].to_pylist()
                by_dim: dict[int, list] = {}
                for node, data in zip(ids, units, strict=True):
                    by_dim.setdefault(len(data) // 8, []).append((node, data))
                for dim, own in by_dim.items():
                    if dim not in codes:
                        codes[dim] = Codes.make(plans[dim])
                    unit = np.array([np.frombuffer(d, "<f8") for _, d in own])
                    at, filters = codes[dim].decode(unit)
                    lists = np.split(filters, np.searchsorted(at, np.arange(1, len(own))))
                    salt = np.int64(dim) << np.int64(40)  # vectors of different lengths never meet
                    scale = np.abs(unit).max(axis=1) / 127
                    sketch = np.rint(unit / scale[:, None]).astype(np.int8)
                    error = np.linalg.norm(unit - sketch * scale[:, None], axis=1)
                    yield to_batch([(n, q.tobytes(), s, e, np.sort(f + salt).tolist()) for (n, _), q, s, e, f in zip(own, sketch, scale.tolist(), error.tolist(), lists, strict=True)], arrow)

    return vectors.mapInArrow(run, schema)


def _compare(nodes: np.ndarray, units: np.ndarray, filters: list[np.ndarray], copies: np.ndarray, side: np.ndarray, here: int, alone: bool, threshold: float) -> list[tuple]:
    """Rows (node, link count, smallest node reached) of one block (``alone``) or of two: pairs whose first common filter is ``here``."""
    first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    other = first if alone else second
    i, j = np.nonzero(units[first] @ units[other].T >= threshold)
    i, j = first[i], other[j]
    if alone:
        i, j = i[i < j], j[i < j]
    if len(i):
        width = max(len(f) for f in filters)
        padded = np.full((len(filters), width), -1)
        for k, f in enumerate(filters):
            padded[k, : len(f)] = f
        earlier = np.zeros(len(i), bool)
        for k in range(width):  # a common filter before this one
            own = padded[i, k]
            ask = np.flatnonzero((own >= 0) & (own < here) & ~earlier)
            if not len(ask):
                continue
            earlier[ask] = (padded[j[ask]] == own[ask, None]).any(axis=1)
        i, j = i[~earlier], j[~earlier]
    if not len(i):
        return []
    links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
    order = np.argsort(nodes, kind="stable")
    rank = np.argsort(order, kind="stable")
    label = order[least_reached(rank[i], rank[j], len(nodes))][rank]
    some = np.flatnonzero(links > 0)
    return [(int(nodes[k]), int(links[k]), int(nodes[label[k]])) for k in some]


def _dealt(each: DataFrame, held: DataFrame) -> DataFrame:
    """Each (node, filter) whose filter others share, with the columns of ``held``, in blocks: filter, low, high, side, filters, node, ...

    A filter is cut into blocks of BLOCK rows, and each pair of blocks is a group. ``filters`` are those up to this one that others share.
    """
    sizes = each.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = each.join(sizes, "filter").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("filter", "blocks"))).alias("shared"))  # what is held stays where it is
    rows = held.join(shared, "node").select(*held.columns, F.col("shared.filter").alias("every"), F.posexplode("shared").alias("at", "one"))
    rows = rows.select(*held.columns, F.slice("every", F.lit(1), F.col("at")).alias("filters"), "one.*")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("filter", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "filters", *held.columns)


def _by_block(dealt: DataFrame, schema: str, compare: Callable[[tuple, list[tuple]], list[tuple]]) -> DataFrame:
    """What ``compare`` gives for the (filter, low, high) and the other columns' rows of each block."""
    arrow, names = arrow_schema(schema), ("filter", "low", "high")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        key, rows, found = None, [], []
        for frame in frames:
            for f, low, high, *row in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if key != (f, low, high):
                    found += compare(key, rows) if len(rows) > 1 else []
                    key, rows = (f, low, high), []
                rows.append(row)
            yield to_batch(found, arrow)
            found = []
        yield to_batch(compare(key, rows) if len(rows) > 1 else [], arrow)

    return dealt.repartition(*names).sortWithinPartitions(*names, "side", "node").mapInArrow(run, schema)


def _likely(spread: DataFrame, threshold: float) -> DataFrame:
    """The (node, filter) where a sketch says that a vector can have a link, one row for each, whatever the number of its partners.

    A sketch's inner product is off by no more than the errors of the two allow, so no pair that reaches the threshold is lost.
    """
    dealt = _dealt(spread.select("node", F.explode("filters").alias("filter")), spread.select("node", "sketch", "scale", "error")).drop("filters")

    def compare(key: tuple, rows: list[tuple]) -> list[tuple]:
        side, node, sketch, scale, error = zip(*rows, strict=True)
        side, scale, error = np.array(side), np.array(scale, np.float32), np.array(error, np.float32)
        near = np.frombuffer(b"".join(sketch), np.int8).reshape(len(rows), -1).astype(np.float32) * scale[:, None]
        alone = key[1] == key[2]
        first, second = np.flatnonzero(side == 0), np.arange(len(rows)) if alone else np.flatnonzero(side == 1)
        slack = error[first, None] + error[second] + error[first, None] * error[second] + 1e-5
        hit = near[first] @ near[second].T >= threshold - slack
        if alone:
            np.fill_diagonal(hit, False)
        some = np.union1d(first[hit.any(axis=1)], second[hit.any(axis=0)])
        return [(node[k], key[0]) for k in some]

    return _by_block(dealt, "node long, filter long", compare).distinct()


def _join(likely: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, links, least) of every block that holds a link; the link counts of different blocks add up.

    ``likely``: (node, filter). Two vectors with a link are likely in each filter that both are in, so a pair counts in the first of them.
    """

    def compare(key: tuple, rows: list[tuple]) -> list[tuple]:
        side, filters, node, unit, copies = zip(*rows, strict=True)
        units = np.frombuffer(b"".join(unit), "<f8").reshape(len(rows), -1)
        return _compare(np.array(node), units, [np.array(f) for f in filters], np.array(copies, float), np.array(side), key[0], key[1] == key[2], threshold)

    return _by_block(_dealt(likely, nodes.select("node", "unit", "copies")), "node long, links long, least long", compare)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, per_filter: float = 24.0, hits: float = 8.0, id_column: str = "vec_id", column: str = "embedding", exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two vectors are linked if their cosine, in double precision, is at least ``threshold`` and a filter holds both; all links found
    are verified. A component is what links reach, its id the smallest vec_id. Equal unit vectors are one node that counts as many.
    Vectors that are null, empty, zero or hold a null or a non-finite component link with nothing, nor do vectors of
    different lengths; a null id is a row whose component is null. No rows give no rows; other columns don't matter.

    The caps shrink as the table grows, so that a filter holds about ``per_filter`` unrelated vectors at any size. A filter
    that holds more is cut into blocks, and each pair of blocks is a group of its own. Sketches of a byte for each component go
    there first, and vectors only where a sketch finds a possible link; links are counted in the first filter that two vectors share,
    and never become rows. The number of rotations is such that of random pairs
    at the threshold, ``RECALL`` or more share a filter, whatever the number of vectors and of their components. ``exact`` finds
    every link: all vectors of a length are one filter, whose pairs of blocks, a square of their number, are compared; for proof.
    """
    schema = "vec_id long, unit binary"
    arrow = arrow_schema(schema)

    def normalise(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            units = map(_unit, frame.column(1).to_pylist())
            yield to_batch([(k, None if u is None else u.astype("<f8").tobytes()) for k, u in zip(frame.column(0).to_pylist(), units, strict=True)], arrow)

    read = vectors.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{column}`").cast("array<double>"))
    units = materialise(read.mapInArrow(normalise, schema), "units")
    nodes = units.where("unit is not null and vec_id is not null").groupBy("unit").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes, "vectors")
    if exact:
        return _told(units, nodes, materialise(_join(nodes.select("node", F.length("unit").cast("long").alias("filter")), nodes, threshold), "vector-links"))
    dims = nodes.groupBy((F.length("unit") / 8).cast("int").alias("dim")).count().collect()
    plans = {r.dim: Plan.make(r.dim, per_filter, hits, r["count"], threshold) for r in dims}
    spread = materialise(_spread(nodes.select("node", "unit"), plans), "filters")
    likely = materialise(_likely(spread, threshold), "likely-filters")
    release(spread)
    found = materialise(_join(likely, nodes, threshold), "vector-links")
    release(likely)
    return _told(units, nodes, found)


def _told(units: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The result's rows, from links counted by block."""
    label = components_of_ids(found.select("node", "least"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.join(links, "node", "left").join(label, "node", "left").select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    known = units.where("unit is not null and vec_id is not null").join(told, "unit").select("vec_id", "n_links", "component_id")
    alone = units.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
