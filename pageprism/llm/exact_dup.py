"""Exact duplicates by a persistent digest index, in DataFrame operations only.

The index is a table with one row per known text: digest, the row that stays.
It is bucketed and sorted by the digest, so new digests meet it in a sort-merge
join that shuffles the new side alone, and what the anti-join leaves is
appended bucket by bucket. A batch is reduced to one row per digest before it
meets the index: a text that a third of all rows share is one partial row
per task.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageprism.llm.common import documents, materialize
from pageprism.sources.sinks import work_dir


def normalized(text: Column) -> Column:
    """Each run of ASCII white space as one blank; null as empty.

    Single blanks are left alone by the pattern, which spares most of the work.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


class DigestIndex:
    """Known digests in a bucketed, sorted table at ``path``.

    The number of buckets is written beside the table when it is made. A later session opens the index by its path; it
    takes that number, and one that asks for another is refused, as digests would be looked for in the wrong buckets.
    ``close`` drops the session's name for the table; files stay.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or work_dir(spark, "digests")).rstrip("/")
        self.buckets = self._settle(buckets)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def _settle(self, buckets: int | None) -> int:
        about = f"{self.path}/about"
        try:
            known = self.spark.read.schema("buckets int").json(about).first().buckets
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = buckets or 64
            self.spark.createDataFrame([(known,)], "buckets int").coalesce(1).write.json(about)
        if buckets not in (None, known):
            raise ValueError(f"the index has {known} buckets, not {buckets}")
        return known

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, firsts: DataFrame) -> None:
        """Add the rows (``digest``, ``keep_id``) whose digest is not known yet.

        New digests are dealt by the buckets' own hash, so each bucket gets one file.
        """
        new = firsts.select("digest", "keep_id").hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        # written apart first: a table is not read and appended to in one job
        new = materialize(new, "new-digests")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def compact(self, path: str) -> DigestIndex:
        """The same index with one file per bucket again, at a new path."""
        other = DigestIndex(self.spark, path, self.buckets)
        self.rows().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(other.table)
        return other


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``digest`` (sha256 of the normalized text) and ``row``, a number that tells repeated rows apart."""
    texts = documents(docs, id_col, text_col)
    found = texts.select("doc_id", F.unhex(F.sha2(normalized(F.col("text")), 256)).alias("digest"))
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "digests")


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Judge a batch against the index, and add its new texts to it.

    Per input row: ``doc_id``, ``digest``, ``keep_id`` (of the row that stays),
    ``group_size`` (rows of this batch with the text), ``kept``. A text the
    index knows loses all rows of the batch; else its row with the smallest id
    stays, one of them if rows repeat. Ids that are null come last; a text
    whose rows all lack an id has a null ``keep_id`` and keeps one row. Null
    and empty texts are one text. Other columns are not looked at. An empty
    batch gives an empty result and leaves the index as it is.
    """
    found = digests(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    batch = materialize(found.groupBy("digest").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("group_size")), "batch")
    known = index.rows().select("digest", "keep_id", F.lit(True).alias("old"))
    decided = materialize(
        batch.hint("merge").join(known, "digest", "left").select(
            "digest",
            F.when(F.col("old"), F.col("keep_id")).otherwise(F.col("least.doc_id")).alias("keep_id"),
            F.when(F.col("old").isNull(), F.col("least.row")).alias("keep_row"),
            "group_size",
        ),
        "decided",
    )
    index.append(decided.filter("keep_row IS NOT NULL"))
    return found.join(decided, "digest").select(
        "doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
    )


def deduplicate_rows(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a batch that stay, with all their columns.

    Of rows with equal id and text one stays, whichever its other columns.
    """
    kept = deduplicate(documents(docs, id_col, text_col), index).filter("kept")
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest"))
    digest = F.unhex(F.sha2(normalized(docs[text_col].cast("string")), 256))
    names = docs.columns
    rows = docs.select("*", digest.alias("__digest"))
    same = rows[id_col].cast("bigint").eqNullSafe(kept["__kept_id"]) & (rows["__digest"] == kept["__kept_digest"])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "__digest"]).select(*[rows[c] for c in names])
