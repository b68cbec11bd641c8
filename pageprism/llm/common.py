"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageprism.sources.sinks import materialize

__all__ = ["by_rows", "documents", "in_arrow", "keyed", "materialize", "row_key", "table"]

#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def _bytes(size: str) -> int:
    """Bytes of a size as Spark settings have it; without a unit it is in bytes."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text only, under fixed names: other columns never reach a shuffle or a Python worker."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id of a row; of a row without one a large number made from its text."""
    other = F.xxhash64(docs[text_col].cast("string")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(docs[id_col].cast("bigint"), other)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (never null), ``text`` and the named columns of ``docs``."""
    return docs.select(row_key(docs).alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c] for c in more])


def by_rows(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], *more: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, with all their columns, that ``judge`` keeps.

    ``judge`` gets ``doc_id``, ``text`` and the columns ``more``, and returns the ``doc_id`` it keeps. Each row is judged for
    itself: one whose id is its own goes under that id; rows without an id or with one that other rows share
    (none, as a rule) are written once with numbers of their own, larger than any id.
    """
    own = docs[id_col].cast("bigint")
    shared = docs.select(own.alias("__shared")).groupBy("__shared").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR __shared IS NULL")
    shared = materialize(shared.select("__shared"), "shared-ids")
    plain = docs.join(shared, own == shared["__shared"], "left_anti").filter(own.isNotNull())
    odd = docs.join(shared, own.eqNullSafe(shared["__shared"]), "left_semi")
    odd = materialize(odd.withColumn("__row", F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62))), "shared-rows")
    columns = [F.col("text").cast("string").alias("text"), *[F.col(c) for c in more]]
    kept = judge(plain.select(own.alias("doc_id"), *columns).unionByName(odd.select(F.col("__row").alias("doc_id"), *columns)))
    kept = kept.select(F.col("doc_id").alias("__kept")).distinct()
    some = plain.join(kept, own == kept["__kept"], "left_semi")
    return some.unionByName(odd.join(kept, odd["__row"] == kept["__kept"], "left_semi").drop("__row"))


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` by workers that find this package.

    Where the package is on the driver's path alone (tests, a notebook), its
    folder is handed to the Python workers; a cluster gets it by ``--py-files``
    or an installation. Whole texts and pairs of them go to the workers in
    batches of at most ``BATCH_BYTES`` and a row, where the session allows more: a batch stands
    in memory several times, in Spark and in the worker, of every task at once.
    """
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(conf.get(bound)) <= BATCH_BYTES:
        conf.set(bound, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)
    return df.mapInArrow(run, schema)
