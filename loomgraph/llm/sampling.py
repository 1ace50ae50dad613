"""A bounded sample of labelled rows, by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: So many labels with their counts, 64 bytes each, may be sent to every executor; with more of them the rows are shuffled.
BROADCAST_LABELS = 100_000


def stratified(rows: DataFrame, label: str, per_label: int, key: Column) -> DataFrame:
    """About ``per_label`` rows of each value of ``label``, all if there are no more, chosen by a hash of ``key``; adds sample_weight.

    The weight is the share of its label's rows that a sampled row stands for; null labels have no rows. Rows with one key are chosen
    together. Counts combine before the shuffle, all labels count, and ``rows`` are not shuffled where the labels are counted to be few.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("sample_weight"))
    weighed = counts.withColumn("sample_weight", F.greatest(F.lit(1.0), F.col("sample_weight") / F.lit(float(per_label))))
    weighed = materialise(weighed, "label-counts")
    few = weighed.count() <= BROADCAST_LABELS
    draw = F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(weighed) if few else weighed, label).where(draw < 1.0 / F.col("sample_weight"))
