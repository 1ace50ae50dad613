"""A corpus from documents to packed sequences: language, toxicity, near-duplicates, mixing, packing.

What holds for all stages: no rows give no rows. Columns besides doc_id, text, lang and source pass through as they are, whatever their
names. A document is an id together with a text, null ones too: rows that agree in both are one document, others are not. Long texts are
used whole. Ties are settled by ids and hashes, so a stage gives the same rows each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, mixing, packing, probminhash, queries, toxicity
from loomgraph.llm.common import materialise

#: The share of all tokens that mixing keeps.
MIX = {"fraction": 0.8, "epochs": 1, "seed": 20}
_READ = ("doc_id", "text", "lang", "source")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns under names that clash with nothing."""
    return docs.toDF(*(c if c in _READ else f"other_{k}" for k, c in enumerate(docs.columns)))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with its names, of rows that came from ``_apart(docs)``."""
    return rows.select(*_apart(docs).columns).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what language identification rejects: null and empty texts, those without a letter, and those whose language it can't tell.

    The model learns from the rows that name a language; if none does, all are rejected. Rows that name none get the one predicted.
    Repeated rows stay.
    """
    rows = _apart(docs)
    told = langid.identify(rows, langid.train(rows, F.col("lang").isNotNull())).where(~F.col("rejected"))
    return _restored(told.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what scores 0.7 or more for toxicity, learned from every labelled row; null texts count as empty. Repeated rows stay."""
    rows = _apart(docs)
    model = toxicity.train(rows, queries.table(spark, sf_dir, "labels"))
    return _restored(toxicity.score(rows, model, threshold=0.7).where("predicted = 0"), docs)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with row_number_: the doc_id; for a null id, or one that several texts have, a number above all ids for each id and text."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    own = rows.select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    unclear = materialise(own.where("doc_id is null or low != high").select(F.col("doc_id").alias("unclear_id")), "unclear-ids")
    if unclear.isEmpty():
        return rows.withColumn("row_number_", F.col("doc_id").cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("unclear_id"))
    clear = rows.join(unclear, same, "left_anti").withColumn("row_number_", F.col("doc_id").cast("long"))
    other = rows.join(unclear, same, "left_semi").withColumn("digest_", digest)
    top = rows.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    each = other.select("doc_id", "digest_").distinct().repartitionByRange("digest_", "doc_id").sortWithinPartitions("digest_", "doc_id")
    numbers = materialise(each.select(F.col("doc_id").alias("its_id"), F.col("digest_").alias("its_digest"), (F.monotonically_increasing_id() + F.lit(top) + 1).alias("row_number_")), "row-numbers")
    found = other.join(numbers, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("digest_") == F.col("its_digest")))
    return materialise(clear.unionByName(found.drop("digest_", "its_id", "its_digest")), "numbered")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near-duplicates, that of the smallest id; rows without an id, or with one that several texts have, come last.

    Null texts count as empty ones; texts without words are alike only if they are equal.
    """
    rows = _numbered(_apart(docs))
    classes, _ = probminhash.near_duplicates(rows.select("row_number_", "text"), threshold=0.8, words=5, id_column="row_number_")
    kept = classes.where("kept").select(F.col("doc_id").alias("row_number_")).distinct()
    return _restored(rows.join(kept, "row_number_", "left_semi").dropDuplicates(["row_number_"]), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the token budgets of domains, languages and sources reach: 80 % of all tokens, nothing twice.

    The last document of a leaf, which a budget reaches in part, stays whole, so a leaf exceeds its budget by less than one document.
    Texts without tokens go. A null lang or source is a node of its own; repeated rows stay or go together.
    """
    rows = _apart(docs).withColumn("row_key_", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    chosen = mixing.mix(rows, queries.n_words(), queries.domain(), weights=queries.mix_weights(spark), **MIX, id_column="row_key_")
    return _restored(rows.join(chosen.select(F.col("doc_id").alias("row_key_")).distinct(), "row_key_", "left_semi"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, with the ids, in sequences of 4096; each row is packed, empty texts as their end alone."""
    placed = packing.pack(docs, queries.tokenizer(), size=4096, windows=16)
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language", language), ("toxicity", harmless), ("near-duplicates", distinct), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None  # SQL expresses neither the trained stages nor the tokenizer; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
