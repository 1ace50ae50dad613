"""Toxicity: a factorization machine over hashed terms, which learns pairs of terms besides single ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, add_columns, arrow_schema, fit_in_task, materialise, named, tidy, to_batch
from .sampling import stratified

BITS = 22
#: A term is a word or how it begins, so that inflected forms that training didn't show are met too.
PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


def terms(word: str) -> list[int]:
    """Buckets of a lower-case word and of its beginnings."""
    return [xxhash.xxh64_intdigest(x) >> (64 - BITS) for x in [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]]


def text_terms(text: str) -> np.ndarray:
    """Sorted buckets of all terms of a whole text."""
    return np.unique(np.array([t for w in set(_WORD.findall(text.lower())) for t in terms(w)], np.uint32))


@dataclass
class Model:
    """Log odds: bias + sum of weights + sum over pairs of the inner products of factors, of the kept terms that occur."""

    kept: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    limit: int = 200_000
    seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def _of(self, word: str) -> tuple:
        if len(self.seen) >= self.limit:
            self.seen.clear()
        if not self.seen:
            self._at = {int(b): k for k, b in enumerate(self.kept)}
        at = self._at
        found = tuple(at[t] for t in terms(word) if t in at)
        self.seen[word] = found
        return found

    def odds(self, active: np.ndarray) -> float:
        if not len(active):
            return self.bias
        v = self.factors[active]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[active].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        active: set = set()
        seen = self.seen
        for word in set(_WORD.findall((text or "").lower())):
            found = seen.get(word)
            if found is None:
                found = self._of(word)
            if found:
                active.update(found)
        return float(1 / (1 + np.exp(-np.clip(self.odds(np.array(sorted(active), int)), -50, 50))))


def _differ(hits1: np.ndarray, hits0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """By how many standard errors the shares of the two classes differ."""
    both = (hits1 + hits0 + 1) / (n1 + n0 + 2)
    return np.abs((hits1 / n1 - hits0 / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0)))


def _paired(rows: list[np.ndarray], labels: np.ndarray, single: np.ndarray, n1: int, n0: int, sure: float) -> np.ndarray:
    """For each term, the strongest difference of a pair that it is in, where the pair says clearly more than either term; else 0."""
    x = np.zeros((len(rows), len(single)), np.float32)
    for k, at in enumerate(rows):
        x[k, at] = 1
    toxic, other, best = x[labels == 1], x[labels == 0], np.zeros(len(single))
    for start in range(0, len(single), 256):
        part = slice(start, start + 256)
        z = _differ((toxic[:, part].T @ toxic).astype(float), (other[:, part].T @ other).astype(float), n1, n0)
        clear = (z > sure) & (z > 1.5 * np.maximum(single[part, None], single))
        best[part] = np.where(clear, z, 0).max(axis=1, initial=0)
    return best


def _choose(samples: list[tuple[int, np.ndarray, float]], labels: np.ndarray, keep: int, pair_terms: int, least: int, sure: float) -> np.ndarray:
    """Sorted buckets of the terms that are learned, see :func:`fit`."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    of = lambda label: np.bincount(np.concatenate([s[1] for s in samples if s[0] == label]), minlength=1 << BITS).astype(np.uint32)
    hits1, hits0 = of(1), of(0)
    known = np.flatnonzero(hits1 + hits0 >= least)
    hits1, hits0 = hits1[known].astype(float), hits0[known].astype(float)
    z = _differ(hits1, hits0, n1, n0)
    often = np.sort(np.argsort(-(hits1 + hits0), kind="stable")[:pair_terms])
    rows = [np.flatnonzero(np.isin(known[often], s[1], assume_unique=True)) for s in samples]
    z[often] = np.maximum(z[often], _paired(rows, labels, z[often], n1, n0, 1.5 * sure))
    chosen = np.argsort(-z, kind="stable")[:keep]
    return np.sort(known[chosen[z[chosen] > sure]]).astype(np.uint32)


def fit(samples: list[tuple[int, np.ndarray, float]], keep: int = 4096, pair_terms: int = 2048, least: int = 3, sure: float = 4.0, dim: int = 4, epochs: int = 15, rate: float = 0.1, seed: int = 7) -> Model:
    """Train on (label 0 or 1, term buckets, weight).

    At most ``keep`` terms that ``least`` samples hold are learned: those whose shares in the two classes differ by more than ``sure``
    standard errors, and those of the ``pair_terms`` most frequent that do so in a pair only, which neither of the two shows alone.
    Then all parameters descend together by AdaGrad. Without both labels, every score is the share of label 1, or 0.5 of nothing.
    """
    labels = np.array([s[0] for s in samples], int)
    weight = np.array([s[2] for s in samples])
    share = float(weight[labels == 1].sum() / weight.sum()) if len(samples) else 0.5
    prior = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    if len(set(labels.tolist())) < 2:
        return Model(np.empty(0, np.uint32), prior, np.empty(0), np.empty((0, dim)))
    kept = _choose(samples, labels, keep, pair_terms, least, sure)
    rows = [np.flatnonzero(np.isin(kept, s[1], assume_unique=True)) for s in samples]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), dim)), prior
    gw, gv, gb = np.full(len(kept), 1.0), np.full((len(kept), dim), 1.0), 1.0
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            x = rows[k]
            vx = v[x]
            total = vx.sum(axis=0)
            odds = bias + w[x].sum() + 0.5 * (total @ total - (vx * vx).sum())
            g = weight[k] * (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - labels[k])
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if len(x):
                d = g + 1e-4 * w[x]
                gw[x] += d * d
                w[x] -= rate * 3 * d / np.sqrt(gw[x])
                d = g * (total - vx) + 1e-3 * vx
                gv[x] += d * d
                v[x] = vx - rate * d / np.sqrt(gv[x])
    return Model(kept, float(bias), w, v)


def train(documents: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", id_column: str = "doc_id", per_label: int = 2500, **options) -> Model:
    """A model from a bounded sample, about ``per_label`` whole texts of each label, of ``documents`` that ``labels`` marks.

    Rows with a null label or id are left out; a document with several labels counts as toxic if one says so; null texts are empty;
    repeated rows of an id are samples each. Without any marked row, every score is 0.5. Texts become terms where they are read,
    and the model is fitted in one task of an executor.
    """
    schema = "label int, terms binary, weight double"
    arrow = arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for frame in frames:
            rows = zip(*(c.to_pylist() for c in frame.columns), strict=True)
            yield to_batch([(label, text_terms(words).astype("<u4").tobytes(), weight) for label, words, weight in rows], arrow)

    def fitted(sample: pa.Table) -> Model:
        rows = sorted(zip(*(c.to_pylist() for c in sample.columns), strict=True))
        return fit([(label, np.frombuffer(found, "<u4"), weight) for label, found, weight in rows], **options)

    of = lambda df, name: F.col(f"`{df.columns[named(df, name)]}`")
    marked = labels.select(of(labels, id_column).alias("key"), of(labels, toxic).alias("toxic")).where("toxic is not null").groupBy("key").agg((F.max("toxic") > 0).cast("int").alias("label"))
    sample = materialise(stratified(marked, "label", per_label, F.col("key")), "label-sample")
    few = sample.count() <= BROADCAST_IDS
    read = documents.select(of(documents, id_column).alias("key"), F.coalesce(of(documents, text), F.lit("")).alias("words")).join(F.broadcast(sample) if few else sample, "key")
    return fit_in_task(read.select("label", "words", "sample_weight").mapInArrow(run, schema), fitted)


def score(documents: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``documents`` with score (0 to 1) and predicted (1 from ``threshold`` on), from whole texts alone; no shuffle.

    Null texts are empty and score what no term says. Repeated rows stay and have the same scores; a score equal to the threshold
    counts as toxic. Input columns of these names, in any case, are replaced; no rows give no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        tidy()

        def tell(texts: list[str | None]) -> list[pa.Array]:
            scores = [shared.value.score(x) for x in texts]
            return [pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())]

        return tell

    return add_columns(documents, text, "score double, predicted int", make)
