"""Memory of the batches that reach Python workers."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageprism.llm.common import BATCH_BYTES, _bytes, in_arrow


def test_batches_of_long_texts_are_bounded(spark):
    """Two texts a row, 60 MB in one task: no batch is larger than the bound by more than a few rows, and no row is lost."""
    long = F.repeat(F.lit("word and more "), 1500)
    rows = spark.range(0, 1500, 1, 1).select("id", long.alias("x"), F.concat(long, F.lit("y")).alias("y"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    got = in_arrow(rows, run, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 1500
    assert max(r.size for r in got) <= BATCH_BYTES + 200_000


@pytest.mark.parametrize("given, size", [("67108864b", 1 << 26), ("8m", 8 << 20), ("64MB", 1 << 26), ("-1", -1), ("1024", 1024)])
def test_sizes_of_settings(given, size):
    assert _bytes(given) == size
