"""MinHash near-dedup by ProbMinHash: element arrivals with early termination, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, arrow_schema, having, materialise, mix, release, tidy, to_batch
from .components import components_of_ids

_WORDS = WordHashes()
_GOLDEN, _STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)
#: Shingles whose arrivals are drawn together.
ELEMENTS = 400_000
#: So many documents are compared with one in a task.
FAN = 512


def shingles(text: str, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of all runs of ``n`` lower-cased words; of all words together if there are fewer; empty without words."""
    words = text.lower().encode("utf-8", "replace").split()
    h = _WORDS.of(words)
    n = min(n, len(h))
    if not n:
        return np.empty(0, np.uint64), np.empty(0)
    run = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        run = run * _STEP + h[k : len(h) - n + 1 + k]
    found, counts = np.unique(mix(run), return_counts=True)
    return found, counts.astype(float)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets: the chance that ProbMinHash picks the same element of both.

    Sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d). Sorted by b_e / a_e, the inner sums are
    prefix sums of a and suffix sums of b. For equal weights it is the plain Jaccard similarity.
    """
    keys = np.union1d(a[0], b[0])
    v, w = np.zeros(len(keys)), np.zeros(len(keys))
    v[np.searchsorted(keys, a[0])] = a[1]
    w[np.searchsorted(keys, b[0])] = b[1]
    if not len(keys):
        return 1.0
    with np.errstate(divide="ignore"):
        ratio = w / v
    order = np.argsort(ratio, kind="stable")
    v, w, ratio = v[order], w[order], ratio[order]
    low, high = np.cumsum(v), w.sum() - np.cumsum(w)
    both = np.flatnonzero((v > 0) & (w > 0))
    return float((1 / (low[both] / v[both] + high[both] / w[both])).sum())


class Sets:
    """Several weighted sets, laid end to end, to be compared with one at a time."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.array([len(x[0]) for x in sets], np.int64)
        self.owner, self.sizes = np.repeat(np.arange(len(sets)), sizes), sizes
        self.keys, self.weights = np.concatenate([x[0] for x in sets]), np.concatenate([x[1] for x in sets])
        self.totals = np.bincount(self.owner, self.weights, len(sets))
        self.plain = bool((self.weights == 1).all())

    def similarities(self, one: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """:func:`similarity` of ``one`` with each set, from the common elements alone; no set is empty."""
        at = np.minimum(np.searchsorted(one[0], self.keys), len(one[0]) - 1)
        hit = np.flatnonzero(one[0][at] == self.keys)
        owner, n = self.owner[hit], len(self.sizes)
        if self.plain and (one[1] == 1).all():
            common = np.bincount(owner, minlength=n)
            return common / (self.sizes + len(one[0]) - common)
        v, w = one[1][at[hit]], self.weights[hit]
        order = np.lexsort((w / v, owner))
        owner, v, w = owner[order], v[order], w[order]
        of_v, of_w = np.bincount(owner, v, n), np.bincount(owner, w, n)
        upto_v, upto_w = np.cumsum(v), np.cumsum(w)
        low = upto_v - (np.cumsum(of_v) - of_v)[owner] + (one[1].sum() - of_v)[owner]  # of v where w / v is no larger
        high = self.totals[owner] - (upto_w - (np.cumsum(of_w) - of_w)[owner])  # of w where it is larger
        return np.bincount(owner, 1 / (low / v + high / w), n)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """For each weighted set, the elements that arrive first in each of ``m`` registers; 0 for an empty set.

    An element arrives at times of a Poisson process of its weight's rate, each time in a random register. It stops
    once its next arrival is later than the latest first arrival of its set. All draws are hashes of the element.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    element = np.concatenate([s[0] for s in sets]) if sets else np.empty(0, np.uint64)
    weight = np.concatenate([s[1] for s in sets]) if sets else np.empty(0)
    first, winner = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    at, state = np.zeros(len(element)), element.copy()
    latest = np.full(len(sets), np.inf)
    while len(element):
        state = mix(state + _GOLDEN)
        draw = ((state >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        at = at - np.log(draw) / weight
        alive = at <= latest[owner]
        owner, element, weight, at, state = owner[alive], element[alive], weight[alive], at[alive], state[alive]
        slot = owner * m + (mix(state ^ _PLACE) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        winner[slot[won]] = element[won]
        touched = np.unique(owner)
        latest[touched] = first.reshape(-1, m)[touched].max(axis=1)
    return winner.reshape(-1, m)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash for each band of each signature; it holds the band's number."""
    rows = signature.reshape(len(signature), bands, -1)
    out = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        out = mix(out * _STEP + rows[:, :, k])
    return out.view(np.int64)


def _signed(documents: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    schema = "doc_id long, same string, bands array<long>"
    arrow = arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(_WORDS)
        for frame in frames:
            ids, same = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            sets, start, held = [], 0, 0
            for k in range(frame.num_rows):
                sets.append(shingles(frame.column(2)[k].as_py(), n))
                held += len(sets[-1][0])
                if held >= ELEMENTS or k == frame.num_rows - 1 or len(sets) >= 2000:
                    found = band_hashes(signatures(sets, bands * rows), bands).tolist()
                    told = [b if len(s[0]) else None for b, s in zip(found, sets, strict=True)]
                    yield to_batch(list(zip(ids[start : k + 1], same[start : k + 1], told, strict=True)), arrow)
                    sets, start, held = [], k + 1, 0

    return documents.select("doc_id", F.md5("text").alias("same"), "text").mapInArrow(run, schema)


_SET = "shingles binary, weights binary"


def _load(shingles_: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(shingles_, "<u8")
    return keys, np.ones(len(keys)) if weights is None else np.frombuffer(weights, "<u4").astype(float)


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles, weights): the weighted sets as bytes; weights are null where all are 1."""
    schema = f"doc_id long, {_SET}"
    arrow = arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(_WORDS)
        for frame in frames:
            for start in range(0, frame.num_rows, 200):
                rows = []
                for doc_id, text in zip(*(c[start : start + 200].to_pylist() for c in frame.columns), strict=True):
                    keys, weights = shingles(text, n)
                    rows.append((doc_id, keys.astype("<u8").tobytes(), None if (weights == 1).all() else weights.astype("<u4").tobytes()))
                yield to_batch(rows, arrow)

    return texts.mapInArrow(run, schema)


def _grouped(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(first ``keys`` values, rows of the others) of runs of sorted rows, across batches."""
    now, rows = None, []
    for frame in frames:
        for row in zip(*(c.to_pylist() for c in frame.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


_LINK = "a long, b long, similarity double"


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold. One text meets about FAN others in a task."""
    counted = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("partners"))
    spread = pairs.join(counted, "b").withColumn("share", F.pmod(F.xxhash64("a"), F.ceil(F.col("partners") / FAN))).drop("partners")
    left = spread.join(sets.withColumnRenamed("doc_id", "a"), "a").select("b", "share", "a", "shingles", "weights")
    right = spread.select("b", "share").distinct().join(sets.withColumnRenamed("doc_id", "b"), "b").select("b", "share", F.lit(None).cast("long").alias("a"), "shingles", "weights")
    arrow = arrow_schema(_LINK)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for (b, _), rows in _grouped(frames, 2):
            found = Sets([_load(*r[1:]) for r in rows[1:]]).similarities(_load(*rows[0][1:]))
            yield to_batch([(rows[k + 1][0], b, float(found[k])) for k in np.flatnonzero(found >= threshold)], arrow)

    together = right.unionByName(left).repartition("b", "share").sortWithinPartitions("b", "share", F.col("a").asc_nulls_first())
    return together.mapInArrow(run, _LINK)


def _verify_cross(open_: DataFrame, bands: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the classes of each bucket: what isn't in the largest class with what is in other classes than itself.

    ``open_``: bucket, node, component, largest. Both sides are cut into blocks of FAN, each pair of blocks is a group of its
    own, and a pair of texts counts in the first band that they share; the pairs never become rows.
    """
    full = open_.withColumn("stray", F.col("component") != F.col("largest"))
    sizes = full.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("blocks"), F.ceil(F.count_if("stray") / FAN).alias("stray_blocks"))
    placed = full.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    base = ["node", "component", "largest"]
    members = placed.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stray_blocks") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), *base)
    strays = placed.where("stray").select("bucket", F.pmod(F.xxhash64("node", F.lit(1)), F.col("stray_blocks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), *base)
    held = sets.join(bands, "doc_id").withColumnRenamed("doc_id", "node")
    rows = strays.unionByName(members).join(held, "node").select("bucket", "i", "j", "side", "node", "component", "largest", "bands", "shingles", "weights")
    arrow = arrow_schema(_LINK)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _, _), rows in _grouped(frames, 3):
            first, second = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
            if not first or not second:
                continue
            nodes, classes = np.array([r[1] for r in second]), np.array([r[2] for r in second])
            both, sets_ = np.array([r[4] for r in second]), Sets([_load(*r[5:]) for r in second])
            found = []
            for _, node, component, largest, own, *data in first:
                own = np.array(own)
                earlier = (both[:, : int(np.flatnonzero(own == bucket)[0])] == own[: int(np.flatnonzero(own == bucket)[0])]).any(axis=1)
                ask = (classes != component) & ((classes == largest) | (nodes > node)) & ~earlier
                if ask.any():
                    s = sets_.similarities(_load(*data))
                    found += [(node, int(nodes[k]), float(s[k])) for k in np.flatnonzero(ask & (s >= threshold))]
            yield to_batch(found, arrow)

    keys = ("bucket", "i", "j")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(run, _LINK)


def near_duplicates(documents: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 30, rows: int = 6, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links): (doc_id, class_id, kept) for every row, and (a, b, similarity) between texts that differ.

    Documents are alike if the probability Jaccard similarity of their shingles of ``words`` words, weighted by how often
    they occur, is at least ``threshold``; a class is what links reach, class_id its smallest id, and kept marks the
    row with that id. With 30 bands of 6 rows, a pair at 0.8 shares no band once in 9000 times.

    Exact copies are one text from the start. Null texts are empty; texts without words are alike only if they are
    copies. Rows with one id are one document; a null id has the class of its copies, or null. No rows give no rows.

    Nobody compares all pairs of a bucket. First each text is compared with one member of its buckets, that it
    meets most; then with the chosen member of every bucket it shares; then, where a bucket still holds several classes,
    what is not in its largest one with the bucket's other classes. Pairs that links already connect are left out each
    time, so at the end every pair of a bucket is compared or connected.
    """
    read = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    signed = materialise(_signed(read, bands, rows, words), "signatures")
    same = signed.groupBy("same").agg(F.min("doc_id").alias("node"))
    nodes = signed.join(same, (signed["same"] == same["same"]) & (signed["doc_id"] == same["node"]), "left_semi").dropDuplicates(["doc_id"])
    buckets = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    turn = F.struct(F.xxhash64("node", "bucket").alias("turn"), F.col("node").alias("pivot"))
    chosen = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(turn)["pivot"].alias("pivot")).where("n > 1").drop("n")
    met = materialise(buckets.join(chosen, "bucket"), "buckets")
    involved = materialise(met.select(F.col("node").alias("doc_id")).distinct(), "bucket-ids")
    texts = having(read, involved, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = materialise(_sets(texts, words), "bucket-sets")

    stars = met.where("node != pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    first = stars.withColumn("k", F.row_number().over(best)).where("k = 1").select("a", "b")
    tried = materialise(first, "pairs-1")
    links = materialise(_verify(tried, sets, threshold), "links-1")

    def labels(found: DataFrame) -> DataFrame:
        return materialise(components_of_ids(found.select("a", "b")), "near-components")

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs that no links connect yet and that weren't compared before."""
        a, b = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
        known = pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
        return known.join(tried, ["a", "b"], "left_anti")

    label = labels(links)
    second = materialise(apart(stars.select("a", "b"), label), "pairs-2")
    if not second.isEmpty():
        links = links.unionByName(materialise(_verify(second, sets, threshold), "links-2"))
        tried, label = tried.unionByName(second), labels(links)

    placed = met.join(label, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "component"))["component"].alias("largest")).where("classes > 1")
    open_ = materialise(placed.join(several.drop("classes"), "bucket"), "open-buckets")
    if not open_.isEmpty():
        third = _verify_cross(open_, nodes.select("doc_id", "bands"), sets, threshold)
        links = links.unionByName(materialise(third, "links-3"))
        label = labels(links)

    release(open_)
    release(met)
    of_text = same.join(label, "node", "left").select("same", "node", F.coalesce("component", "node").alias("class_id"))
    of_row = signed.select("doc_id", "same").join(of_text.drop("node"), "same")
    classes = of_row.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))
    return classes, links
