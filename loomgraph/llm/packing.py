"""Packing documents into sequences: bounded-space online best fit in each partition, then a merge of what is left open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialise, tidy, to_batch
from .tokens import WordTokenizer

#: A piece of a document: ids start..start+length of it lie in sequence_id from offset on. level and part say where it was placed.
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, level int, part long"
#: So many partitions' open windows meet in a task of the merge.
FAN_IN = 64
#: Bits of a sequence number below the level, and of its count within a part of a level.
PART_AND_COUNT, COUNT = 58, 24


class Packer:
    """At most ``windows`` open sequences. A document goes where it fits best; if it fits nowhere, it tops up the fullest, which is emitted."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.open: list[list] = []  # [ids held, pieces]
        self.done: list[list[tuple]] = []

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        """Place the ids of a document, or of a piece of it that starts at ``start``."""
        n, at, size = len(ids) // 4, 0, self.size
        while n - at >= size:
            self.done.append([(doc_id, start + at, size, ids[4 * at : 4 * (at + size)], total, 0)])
            at += size
        while at < n:
            rest = n - at
            fits = [w for w in self.open if w[0] + rest <= size]
            if fits:
                window, take = max(fits, key=lambda w: w[0]), rest
            elif len(self.open) < self.windows:
                window, take = [0, []], rest
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                take = size - window[0]
            window[1].append((doc_id, start + at, take, ids[4 * at : 4 * (at + take)], total, window[0]))
            window[0] += take
            at += take
            if window[0] == size:
                self.done.append(window[1])
                self.open.remove(window)

    def finish(self, last: bool) -> list[list[tuple]]:
        """Close what is open. ``last``: cut it into sequences whose lengths are powers of two, which need no padding."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        if not last:
            return [pieces] if pieces else []
        out, left = [], sum(p[2] for p in pieces)
        pieces.reverse()
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            row, held = [], 0
            while held < room:
                doc_id, start, n, ids, total, _ = pieces.pop()
                take = min(n, room - held)
                row.append((doc_id, start, take, ids[: 4 * take], total, held))
                held += take
                if take < n:
                    pieces.append((doc_id, start + take, n - take, ids[4 * take :], total, 0))
            out.append(row)
        return out


def _rows(sequences: list[list[tuple]], level: int, part: int, first: int, left: bool = False) -> list[tuple]:
    """left: these go on to the next level and have no number yet."""
    rows = []
    for k, pieces in enumerate(sequences):
        number = -1 if left else (level << PART_AND_COUNT) | (part << COUNT) | (first + k)
        rows += [(*p[:5], number, p[5], level, part) for p in pieces]
    return rows


def pack(documents: DataFrame, tokenizer: str, size: int = 4096, windows: int = 16, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (:data:`SCHEMA`) of all documents' token ids in sequences of at most ``size`` ids, a power of two.

    Each document's ids end with ``end_id``; a null text is empty and so has that id alone. Repeated rows are packed as
    often as they come; null ids stay null; other columns don't matter, and no rows give no rows. Every id lies in
    exactly one piece, and the pieces of a sequence follow each other without gaps. All sequences have ``size`` ids
    but the very last few, whose lengths are powers of two.

    Each task keeps ``windows`` open sequences; what they hold at its end, below windows * size ids, goes with that of
    ``FAN_IN`` tasks to one task, level by level, until one is left. Placed pieces are written to the shared folder once.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    arrow = arrow_schema(SCHEMA)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, packer, tokens, count = TaskContext.get().partitionId(), Packer(size, windows), WordTokenizer.get(tokenizer), 0
        tidy(tokens)
        end = np.array([end_id], "<u4").tobytes()
        for frame in frames:
            for doc_id, words in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                ids = tokens.encode(words) + end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(packer.done) >= 256:
                    yield to_batch(_rows(packer.done, 0, part, count), arrow)
                    count, packer.done = count + len(packer.done), []
        yield to_batch(_rows(packer.done, 0, part, count), arrow)
        yield to_batch(_rows(packer.finish(False), 0, part, 0, left=True), arrow)

    def merge(level: int, last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            part, packer = key[0].as_py(), Packer(size, 1)
            rows = zip(*(table.column(c).to_pylist() for c in ("part", "offset", "doc_id", "start", "ids", "doc_tokens")), strict=True)
            for _, _, doc_id, start, ids, total in sorted(rows, key=lambda x: (x[0], x[1], x[2] is None, x[2] or 0, x[3])):
                packer.add(doc_id, start, ids, total)
            rows = _rows(packer.done, level, part, 0)
            rows += _rows(packer.finish(last), level, part, len(packer.done), left=not last)
            return pa.Table.from_batches([to_batch(rows, arrow)])

        return run

    read = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    placed = materialise(read.mapInArrow(place, SCHEMA), "packed")
    out, left, level = placed.where("sequence_id >= 0"), placed.where("sequence_id < 0"), 0
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        level += 1
        last = parts < FAN_IN
        done = left.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("to").applyInArrow(merge(level, last), SCHEMA)
        done = materialise(done, f"packed-{level}")
        out = out.unionByName(done.where("sequence_id >= 0"))
        left, parts = done.where("sequence_id < 0"), None if last else parts // FAN_IN
    return out
