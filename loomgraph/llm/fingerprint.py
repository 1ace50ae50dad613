"""Canonical exact digests: Unicode normalisation, case and white-space folding, wide xxhash, bytes compared inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, having, materialise, to_batch


def canonical(text: str) -> bytes:
    """NFKC and full case folding until nothing changes, runs of white space as one space, none at the ends; UTF-8."""
    while True:
        folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
        if folded == text:
            return " ".join(text.split()).encode()
        text = folded


def digest(folded: bytes) -> str:
    """128-bit xxhash in hex."""
    return xxhash.xxh3_128_hexdigest(folded)


def settle(digests: DataFrame, pairs: list[tuple[str, str, str]], texts: Callable[[DataFrame], DataFrame], check: Callable = digest) -> DataFrame:
    """Add fingerprint columns: the digest, or digest and SHA-256 where a digest stands for differing canonical texts.

    ``pairs``: (digest column, SHA-256 column, name of the fingerprint). ``texts(repeated)`` gives the texts behind the
    digests in ``repeated``. The smallest and the largest canonical bytes of each equal bucket are compared, and the SHA-256 of all
    rows, also of those whose texts can't be found again; both combine before the shuffle, so a bucket of any size is reduced where it is read.
    """
    both = [digests.select(F.col(d).alias("digest"), F.unhex(sha).alias("sha")) for d, sha, _ in pairs]
    all_of = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    counted = all_of.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), (F.min("sha") != F.max("sha")).alias("differ"))
    repeated = materialise(counted.where("n > 1").select("digest", "differ"), "repeated-digests")
    schema = "digest string, canonical binary"
    arrow = arrow_schema(schema)

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield to_batch([(check(x), x) for x in map(canonical, frame.column(0).to_pylist())], arrow)

    folded = texts(repeated.select("digest")).mapInArrow(fold, schema)
    buckets = folded.groupBy("digest").agg(F.min("canonical").alias("a"), F.max("canonical").alias("z"))
    collided = materialise(buckets.where("a != z").select("digest").union(repeated.where("differ").select("digest")).distinct(), "collided-digests")
    some = not collided.isEmpty()
    out = digests
    for name, sha, fingerprint in pairs:
        if some:
            hit = collided.select(F.col("digest").alias(name), F.lit(True).alias("collided"))
            out = out.join(hit, name, "left").withColumn(fingerprint, F.when(F.col("collided"), F.concat_ws("-", name, sha)).otherwise(F.col(name))).drop("collided")
        else:
            out = out.withColumn(fingerprint, F.col(name))
    return out


def _read(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    return documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text: str = "text", check: Callable = digest) -> DataFrame:
    """(doc_id, n_chars, fingerprint, group_id, copies) for each row; fingerprints are equal iff canonical texts are.

    group_id is the smallest id of those that share the fingerprint, copies their number. Null texts are empty; repeated rows are
    copies of each other; other columns don't matter; no rows give no rows. ``check`` is the digest, for tests.
    """
    schema = "doc_id long, n_chars long, digest string, sha string"
    arrow = arrow_schema(schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = []
            for doc_id, words in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                folded = canonical(words)
                rows.append((doc_id, len(words), check(folded), hashlib.sha256(folded).hexdigest()))
            yield to_batch(rows, arrow)

    read = _read(documents, id_column, text)
    own = materialise(read.mapInArrow(run, schema), "digests")

    def texts(repeated: DataFrame) -> DataFrame:
        ids = materialise(own.join(repeated, "digest", "left_semi").select("doc_id").distinct(), "repeated-ids")
        return having(read, ids, "doc_id").select("text")

    marked = settle(own, [("digest", "sha", "fingerprint")], texts, check)
    groups = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    return marked.join(groups, "fingerprint").select("doc_id", "n_chars", "fingerprint", "group_id", "copies")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDIT = "doc_id long, n_chars long, next_id long, edited_sha256 string, digest string, sha string, edited_digest string, edited_sha string, near_edited double, near_next double"


def _compare(doc_id, text: str, folded: bytes, next_id, following: str, next_folded: bytes) -> tuple:
    changed = edited(text, following)
    changed_folded = canonical(changed)
    return (
        doc_id, len(text), next_id, hashlib.sha256(changed.encode()).hexdigest(), digest(folded), hashlib.sha256(folded).hexdigest(),
        digest(changed_folded), hashlib.sha256(changed_folded).hexdigest(), float(folded == changed_folded), float(folded == next_folded),
    )


def edit_sensitivity(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each document and its edited text, whose second half comes from the next document by id.

    Columns of the result: doc_id, n_chars, next_id, edited_sha256, fingerprint, edited_fingerprint, and near_edited and
    near_next, 1.0 where the canonical bytes are equal and 0.0 elsewhere. The last document is followed by the first,
    a lone one by itself; ids that tie are ordered by text, null ids come first; null texts are empty; no rows give no rows.

    Texts are shuffled once, into ranges of ids. A task hands its first and last document on, and the last of one task meets
    the first of the next by the tasks' numbers. Texts with equal digests are found again by their ids and compared byte by byte;
    edited texts next to a null or repeated id, which can't be found so, are compared by their SHA-256.
    """
    schema = f"{_EDIT}, task int, first_id long, first_text string, last_id long, last_text string"
    arrow = arrow_schema(schema)
    width = len(_EDIT.split(", "))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        for frame in frames:
            rows = []
            for doc_id, words in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                now = (doc_id, words, canonical(words))
                if last is None:
                    first = now
                else:
                    rows.append((*_compare(*last, *now), *[None] * 5))
                last = now
            yield to_batch(rows, arrow)
        if last is not None:
            yield to_batch([(*[None] * width, TaskContext.get().partitionId(), *first[:2], *last[:2])], arrow)

    def join_ends(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = zip(*(c.to_pylist() for c in frame.columns), strict=True)
            yield to_batch([_compare(k, words, canonical(words), next_id, after, canonical(after)) for k, words, next_id, after in rows], plain)

    plain = arrow_schema(_EDIT)
    read = _read(documents, id_column, text)
    names = [x.split()[0] for x in _EDIT.split(", ")]
    ranged = read.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = materialise(ranged.mapInArrow(run, schema), "edits")
    ends = found.where("task is not null")
    numbers = Window.orderBy("task")  # of the tasks' numbers alone
    numbered = ends.select("task").withColumn("next_task", F.coalesce(F.lead("task").over(numbers), F.first("task").over(numbers)))
    meeting = ends.select("task", "last_id", "last_text").join(numbered, "task").join(ends.select(F.col("task").alias("next_task"), "first_id", "first_text"), "next_task")
    joined = meeting.select("last_id", "last_text", "first_id", "first_text").mapInArrow(join_ends, _EDIT)
    out = found.where("task is null").select(*names).unionByName(joined)

    def texts(repeated: DataFrame) -> DataFrame:
        own = materialise(out.join(repeated, "digest", "left_semi").select("doc_id").distinct(), "repeated-own")
        changed = materialise(out.join(repeated.select(F.col("digest").alias("edited_digest")), "edited_digest", "left_semi").select("doc_id", "next_id").distinct(), "repeated-edited")
        ids = materialise(changed.select("doc_id").union(changed.select("next_id")).distinct(), "repeated-parts")
        parts = materialise(having(read, ids, "doc_id"), "repeated-texts")
        once = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).where("n = 1 and doc_id is not null").select("doc_id", "text")
        half, tail = F.floor(F.length("text") / 2).cast("int"), once.select(F.col("doc_id").alias("next_id"), F.col("text").alias("tail"))
        with_tail = changed.join(once, "doc_id").join(tail, "next_id")
        both = with_tail.select(F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("tail", F.lit(1), half)).alias("text"))
        return having(read, own, "doc_id").select("text").unionByName(both)

    settled = settle(out, [("digest", "sha", "fingerprint"), ("edited_digest", "edited_sha", "edited_fingerprint")], texts)
    return settled.select("doc_id", "n_chars", "next_id", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
