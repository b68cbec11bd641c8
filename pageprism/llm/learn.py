"""Bounded labelled samples, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of at most ``per_class`` labelled rows of each class.

    The rows with the least hashes of their id are taken, the same in every
    run. The chosen ids, at most ``2 * per_class`` of 13 bytes each, are
    broadcast, so of the texts only the sample is shuffled. Of rows that share an id the
    least text is taken, so an id that a million rows have is one text. Null labels and
    ids are left out; an id with two labels has both.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1)")
    chosen = None
    for y in (0, 1):
        some = rows.filter(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    some = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return some.select("doc_id", "text", "y")
