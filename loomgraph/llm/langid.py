"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD, with calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, arrow_schema, fit_in_task, named, tidy, to_batch
from .sampling import stratified

BITS = 16
_LETTER = re.compile(r"[^\W\d_]")
_PART = 1 << 22
#: ASCII that is no letter separates words.
_SEPARATE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _hashed(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.empty(0, np.int64)
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    four = three[:-1] | b[3:] << np.uint32(24)
    inner = b[1:-1] != 32
    mixed = np.concatenate([(three * np.uint32(2654435761))[inner], (four * np.uint32(2246822519) + np.uint32(97))[inner[:-1] & inner[1:]]])
    return (mixed >> np.uint32(32 - BITS)).astype(np.int64)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all 3- and 4-byte subwords of the lower-cased words with a space at either end, part by part of long texts."""
    data = b" " + text.lower().encode().translate(_SEPARATE) + b" "
    for k in range(0, max(1, len(data) - 3), _PART):
        yield _hashed(data[k : k + _PART + 3])


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Model:
    """Class scores are means over a text's subwords of ``table`` (embedding times softmax weights) plus ``bias``."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for ids in subwords(text):
            total += self.table.take(ids, axis=0).sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected); ``und`` and 0 without a letter or without any learned language."""
        if not self.labels or not has_letter(text):
            return "und", 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] < self.threshold)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7, keep: float = 0.999) -> Model:
    """Train on (label, subword buckets, their counts); a fifth is held back for temperature and rejection threshold.

    Each label's sample has about the same size, so all labels weigh alike, however many rows they have. The temperature minimises the
    held-back log loss. The threshold is at most 1/2 and leaves ``keep`` of the held-back texts that are named rightly.
    """
    labels = sorted({s[0] for s in samples})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    if len(labels) < 2 or not len(held):
        return Model(labels, np.zeros((1 << BITS, len(labels)), np.float32), np.zeros(len(labels)))
    at = {x: k for k, x in enumerate(labels)}
    embedding = rng.uniform(-1, 1, (1 << BITS, dim)) / dim
    squares = np.full(1 << BITS, 1e-8)
    weights, bias = rng.normal(0, 0.1, (dim, len(labels))), np.zeros(len(labels))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(train):
            label, ids, counts = samples[k]
            if not len(ids):
                continue
            share = counts / counts.sum(dtype=np.float64)
            hidden = share @ embedding[ids]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[at[label]] -= 1
            back = np.outer(share, weights @ p)
            weights -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            squares[ids] += (back**2).mean(axis=1)
            embedding[ids] -= step * 0.2 * back / np.sqrt(squares[ids])[:, None]
    table = embedding @ weights
    scores = np.array([(samples[k][2] @ table[samples[k][1]]) / max(samples[k][2].sum(), 1) + bias for k in held])
    truth = np.array([at[samples[k][0]] for k in held])

    def chances(t: float) -> np.ndarray:
        p = np.exp((scores - scores.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(chances(t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = chances(temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    threshold = min(0.5, float(np.quantile(right, 1 - keep))) if len(right) else 0.0
    return Model(labels, table.astype(np.float32), bias, temperature, threshold)


def train(documents: DataFrame, learn: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id", per_label: int = 600, **options) -> Model:
    """A model from a bounded sample, about ``per_label`` whole texts of each language, of the rows where ``learn`` holds.

    Rows without text or language are left out; without any rows, the model knows no language. Repeated rows of one id are sampled
    together. The sample is reduced to counts of subwords where it is read, and fitted in one task of an executor.
    """
    schema = "label string, ids binary, counts binary"
    arrow = arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for frame in frames:
            rows = []
            for label, words in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                counts = np.zeros(1 << BITS, np.int64)
                for ids in subwords(words):
                    counts += np.bincount(ids, minlength=1 << BITS)
                ids = np.flatnonzero(counts)
                rows.append((label, ids.astype("<u2").tobytes(), counts[ids].astype("<f4").tobytes()))
            yield to_batch(rows, arrow)

    def fitted(sample: pa.Table) -> Model:
        rows = sorted(zip(*(c.to_pylist() for c in sample.columns), strict=True))
        return fit([(label, np.frombuffer(ids, "<u2"), np.frombuffer(n, "<f4")) for label, ids, n in rows], **options)

    place = documents.columns
    label, words, key = (F.col(f"`{place[named(documents, c)]}`") for c in (lang, text, id_column))
    known = documents.where(learn & label.isNotNull() & words.isNotNull()).select(label.alias("label"), words.alias("words"), key.alias("key"))
    read = stratified(known, "label", per_label, F.col("key"))
    return fit_in_task(read.select("label", "words").mapInArrow(run, schema), fitted)


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with lang_pred, score and rejected, from whole texts alone; no shuffle.

    Null texts, empty ones and texts without a letter: ``und``, 0.0, rejected. Classes that tie: the first in the order of their
    names. Repeated rows stay and have the same answers. Input columns of these names, in any case, are replaced; no rows give no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        tidy()

        def tell(texts: list[str | None]) -> list[pa.Array]:
            languages, scores, rejected = zip(*map(shared.value.predict, texts), strict=True) if texts else ((), (), ())
            return [pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

        return tell

    return add_columns(documents, text, "lang_pred string, score double, rejected boolean", make)
